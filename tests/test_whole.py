"""Queries over all rows, where those they stand beside take a part: against plain Python on the smallest test data."""

import pyarrow.parquet as pq

from sedimenta import plans

FOLDER = "/root/testdata/sf0.001"


def test_points_up_to_the_end_of_each_document(spark):
    rows = pq.read_table(f"{FOLDER}/segments.parquet", columns=["document_version_id", "char_start", "char_end"]).to_pylist()
    spans = {}
    for r in rows:
        if r["document_version_id"] is not None:
            spans.setdefault(r["document_version_id"], []).append((r["char_start"], r["char_end"]))
    want = set()
    for k, of in spans.items():
        for at in range(0, max((b for _, b in of if b is not None), default=0), 500):
            if not any(a is not None and b is not None and a <= at < b for a, b in of):
                want.add((k, at))
    got = [(r.k, r.at) for r in plans.QUERIES["j24_all_unprotected_points"](spark, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_points_far_on_in_a_document_and_all_spans_count(spark, tmp_path):
    rows = [("v", 0, 400, 1), ("v", 600, 6200, 1), ("v", 6300, 7100, 2), ("w", 500, 501, 3), ("x", None, None, 0)]
    spark.createDataFrame(rows, "document_version_id string, char_start int, char_end int, ordinal int").write.parquet(f"{tmp_path}/segments.parquet")
    spark.createDataFrame([("v", 7600, 9001, 4)], "document_version_id string, char_start int, char_end int, ordinal int").write.mode("append").parquet(f"{tmp_path}/segments.parquet")
    got = {(r.k, r.at) for r in plans.QUERIES["j24_all_unprotected_points"](spark, str(tmp_path)).collect()}
    assert got == {("v", 500), ("v", 7500), ("w", 0)}


def test_every_event_is_calibrated(spark):
    rows = pq.read_table(f"{FOLDER}/events.parquet", columns=["event_id"]).to_pylist()
    got = [r.event_id for r in plans.QUERIES["j25_all_calibrated_scores"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(r["event_id"] for r in rows)


def test_citations_of_all_parts_are_resolved(spark):
    rows = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = sorted([(r["doc_id"], s, False) for r in rows for s in range(0, len(r["text"] or ""), 500)] + [(-1, -1, True) for _ in rows])
    assert sorted((r.doc_id, r.char_start, r.rejected) for r in plans.QUERIES["t29_all_citation_choices"](spark, FOLDER).collect()) == want
