"""Operators against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from sedimenta.functions import text as X
from sedimenta.operators import dedup, evaluation, folds, graph, knowledge, lexical, links, ranking, review, segments
from sedimenta.session import scratch


def test_text_functions(spark):
    rows = [("Ärger  mit\tMÜLLER ß",), ("",), (None,), (" 　",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(X.folded_name(F.col("t"))).collect()] == ["aerger mit mueller ss", "", None, ""]
    assert [r[0] for r in df.select(X.is_blank(F.col("t"))).collect()] == [False, True, None, True]
    stems = ["creation", "walking", "sing", "registered"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in stems], "w string").select("w", X.stem(F.col("w"))).collect()}
    assert got["walking"] == "walk" and got["sing"] == "sing" and got["registered"] == "register" and got["creation"] == "creat"


def test_literal_hits_overlap_and_escape(spark):
    df = spark.createDataFrame([(1, "aaaa a.a"), (2, None), (3, "")], "k int, text string")
    assert sorted(tuple(r) for r in lexical.literal_hits(df, "aa", "k").collect()) == [(1, 0), (1, 1), (1, 2)]
    assert [tuple(r) for r in lexical.literal_hits(df, "a.a", "k").collect()] == [(1, 5)]


def test_phrases_with_repeated_words(spark):
    df = spark.createDataFrame([(1, "no no no yes"), (2, "no yes no"), (3, "No, no! YES")], "k int, text string")
    index = lexical.freeze(df, "k", scratch(spark))
    assert {tuple(r) for r in lexical.phrase_matches(index, ["no", "no"]).collect()} == {(1, 2), (3, 1)}
    assert {tuple(r) for r in lexical.phrase_matches(index, ["no", "yes"]).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert lexical.phrase_matches(index, ["yes", "yes"]).collect() == [] and lexical.phrase_matches(index, ["absent"]).collect() == []


def test_frozen_index_reads_the_folders_of_its_terms_alone(spark):
    texts = ["a b b c", "B d", None, "", "c " * 500, "ä-ö é_x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string").selectExpr("*", "'x' AS term", "1 AS dl")
    index = lexical.freeze(df, "k", scratch(spark))
    assert {(r.k, r.term, r.dl, r.tf) for r in index.postings.collect()} == {(0, "a", 4, 1), (0, "b", 4, 2), (0, "c", 4, 1), (1, "b", 2, 1), (1, "d", 2, 1), (4, "c", 500, 500), (5, "ä", 4, 1), (5, "ö", 4, 1), (5, "é", 4, 1), (5, "x", 4, 1)}
    assert {r.term: r.bucket for r in index.postings.collect()} == {t: lexical.bucket_of(t) for t in ("a", "b", "c", "d", "ä", "ö", "é", "x")}
    assert index.statistics.collect()[0].n == 5
    plan = index.hits(["b"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket#" in plan.split("PartitionFilters")[-1]
    assert [r.k for r in lexical.bm25_search(index, ["b", "d"], 5).collect()] == [1, 0] and lexical.bm25_search(index, ["zz"], 5).collect() == []
    empty = lexical.freeze(df.limit(0), "k", scratch(spark))
    assert lexical.bm25_search(empty, ["b"], 5).collect() == []


def test_ranks_of_spread_groups_are_those_of_one_sort(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("xxxxy"), rng.randrange(50)) for i in range(2000)]
    got = {(r.k, r.rank) for r in lexical.ranked(spark.createDataFrame(rows, "k int, g string, s int").repartition(5), [F.desc("s"), "k"], ["g"]).collect()}
    want = set()
    for g in "xy":
        want |= {(r[0], n) for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])), 1)}
    assert got == want


def test_budget_packing_skips_and_goes_on(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.randrange(1, 60)) for g in "ab" for i in range(40)]
    got = {(r.g, r.i) for r in ranking.packed(spark.createDataFrame(rows, "g string, i bigint, s bigint"), "i", "s", 200, "i", "g").collect()}
    want = set()
    for g in "ab":
        used = 0
        for _, i, s in sorted(r for r in rows if r[0] == g):
            if used + s <= 200:
                used += s
                want.add((g, i))
    assert got == want


def test_batches(spark):
    assert folds.batch_numbers([5, 5, 5, 20, 1, 1, 1, 1, 1], 4, 10) == [0, 0, 1, 2, 3, 3, 3, 3, 4]
    df = spark.createDataFrame([("d", 2, 9), ("d", 0, 5), ("d", 1, 5), ("e", 0, None)], "d string, o int, n int")
    assert {tuple(r) for r in folds.batches(df, "d", "o", "n", 8, 10).collect()} == {("d", 0, 0), ("d", 1, 0), ("d", 2, 1), ("e", 0, 0)}


def test_facets_and_paging(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "d"), (3, "a")], "k int, f string")
    assert [tuple(r) for r in ranking.facet_cover(df, "k", "f", 5).orderBy("place").collect()] == [(2, 0, 3), (1, 1, 1)]
    relevant = df.withColumn("r", F.when(F.col("k") == 3, 9).otherwise(1))
    assert [r.k for r in ranking.facet_cover(relevant, "k", "f", 5, "r").orderBy("place").collect()] == [2, 3] and ranking.facet_cover(df.limit(0), "k", "f", 5).collect() == []
    first = ranking.page(df.select("k").distinct(), "k", None, 2).collect()
    assert [(r.k, r.remaining) for r in first] == [(1, 1), (2, 1)] and ranking.page(df.select("k").distinct(), "k", 3, 2).collect() == []
    cursors = [r[0] for r in df.select(ranking.page_cursor("scope", F.col("k"))).distinct().collect()]
    assert len(cursors) == 3 and all(isinstance(c, str) for c in cursors)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(3):
            own = base[:]
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(120)] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    texts += [texts[0], "", None, "short text"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    sets = {}
    for k, t in enumerate(texts):
        w = (t or "").split()
        s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        if s and s not in sets.values():
            sets[k] = s
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.left_key, r.right_key) for r in dedup.near_duplicates(df, "k").collect()} == want
    assert {r.k: r.representative for r in dedup.shingle_classes(df, "k").collect()}[75] == 0


def test_graph(spark):
    links = [("a", "b"), ("c", "a"), ("a", "a"), ("b", "d"), ("d", "e"), ("e", "a"), ("f", None)]
    df = spark.createDataFrame(links, "x string, y string")
    near = graph.adjacency(df, "x", "y")
    assert {tuple(r) for r in near.filter("node = 'a'").collect()} == {("a", "b"), ("a", "c"), ("a", "a"), ("a", "e")}
    seeds = spark.createDataFrame([("b",)], "node string")
    assert [tuple(r) for r in graph.bounded_search(near, seeds, 2, 4).collect()] == [("b", 0), ("a", 1), ("d", 1), ("c", 2)]
    assert {r.node for r in graph.closure(df, seeds, "x", "y").collect()} == {"b", "a", "c", "e", "d"}
    assert {r.node for r in graph.closure(df.limit(0), seeds, "x", "y").collect()} == {"b"}


def test_resolution(spark):
    refs = spark.createDataFrame([("r1", "m1"), ("r2", "m2"), ("r3", "m3"), ("r4", None)], "id string, ref string")
    targets = spark.createDataFrame([("t1", "m1"), ("t1", "m1"), ("t2", "m2"), ("t3", "m2"), ("t4", None)], "t string, name string")
    got = {r.id: (r.status, r.target) for r in graph.resolve(refs, targets, "ref", "name", "t").collect()}
    assert got == {"r1": ("resolved", "t1"), "r2": ("ambiguous", None), "r3": ("unresolved", None), "r4": ("unresolved", None)}


def test_hash_chain(spark):
    def made(n, broken=None):
        previous, out = review.GENESIS, []
        for i in range(n):
            h = hashlib.sha256(f"{previous}|p{i}".encode()).hexdigest()
            out.append(("c", i, f"p{i}" if i != broken else "changed", h, previous))
            previous = h
        return spark.createDataFrame(out, "c string, i int, payload string, hash string, prev string")

    breaks = lambda df: [r.i for r in review.chain_breaks(df, ["c"], "i", F.col("payload"), "hash", "prev").collect()]
    assert breaks(made(20)) == [] and breaks(made(20, 7)) == [7] and breaks(made(20).filter("i != 5")) == [6]


def test_dates_and_numbers(spark):
    surfaces = {"2026-02-03": ["2026-02-03"], "03/04/2026": ["2026-03-04", "2026-04-03"], "25/12/2026": ["2026-12-25"], "2026-02-30": [], "5 mars 2031": ["2031-03-05"], "5. März 2031": ["2031-03-05"], "4 de julio de 2031": ["2031-07-04"]}
    df = spark.createDataFrame([(s,) for s in surfaces], "s string")
    assert {r.s: [str(x) for x in r.d] for r in df.select("s", knowledge.date_readings(F.col("s"), F.lit(False)).alias("d")).collect()} == surfaces
    assert [str(x) for x in df.filter("s = '03/04/2026'").select(knowledge.date_readings(F.col("s"), F.lit(True))).collect()[0][0]] == ["2026-04-03"]
    numbers = {"1,234": ["1.234", "1234"], "12.5": ["12.5"], "1.234,56": ["1234.56"], "1,234.56": ["1234.56"], "1.234.567": ["1234567"], "42": ["42"]}
    df = spark.createDataFrame([(s,) for s in numbers], "s string")
    assert {r.s: r.d for r in df.select("s", knowledge.number_readings(F.col("s")).alias("d")).collect()} == numbers


def test_claims(spark):
    rows = [(1, "Alice approved order 7."), (2, "Alice did not approve order 7."), (3, "Ben Stone may approve order 8 if it rains."), (4, "Was order 7 approved?"), (5, "they said Alice approved order 7."), (6, None)]
    got = {r.k: tuple(r)[1:] for r in knowledge.claims(spark.createDataFrame(rows, "k int, text string"), "k").collect()}
    assert got == {1: ("Alice", "7", "positive", "asserted", None), 2: ("Alice", "7", "negative", "asserted", None), 3: ("Ben Stone", "8", "positive", "possible", "if it rains")}


def test_clauses(spark):
    rows = {
        "Alice approved order 1847.": ("Alice", "approve", "order:1847", "positive", "asserted", None, None, None),
        "Alice did not approve order 1847.": ("Alice", "approve", "order:1847", "negative", "asserted", "event", None, None),
        "Alice will approve order 1847 only after inspection.": ("Alice", "approve", "order:1847", "positive", "planned", None, "only after inspection", None),
        "Invoice INV-12 must be paid if delivery occurs.": (None, "pay", "invoice:INV-12", "positive", "required", None, "if delivery occurs", None),
        "Order 1847 may be approved.": (None, "approve", "order:1847", "positive", "possible", None, None, None),
        "Order 1847 was approved?": None,
        "Order 1847 was approved on 2026-02-30.": None,
        "Order 1847 was approved by Ben Stone on 2026-02-03.": ("Ben Stone", "approve", "order:1847", "positive", "asserted", None, None, "2026-02-03"),
        "They say that Alice approved order 1.": None,
        "nobody approved order 1.": None,
        "Ben must not sign contract C-9.": ("Ben", "sign", "contract:C-9", "negative", "prohibited", "modality", None, None),
        "Der Auftrag 7 darf nicht storniert werden.": (None, "cancel", "order:7", "negative", "prohibited", "modality", None, None),
        "Die Lieferung 8 kann nicht geliefert werden, falls es regnet.": (None, "deliver", "shipment:8", "unresolved", "unresolved", "unresolved", "falls es regnet", None),
        "Die Rechnung R-3 wurde von Jörg Müller bezahlt.": ("Jörg Müller", "pay", "invoice:R-3", "positive", "asserted", None, None, None),
    }
    df = spark.createDataFrame([*((t,) for t in rows), (None,), ("",)], "t string")
    got = {r.t: (*tuple(r)[1:8], str(r.applicable_on) if r.applicable_on else None) for r in knowledge.clause_claims(df, "t", "t").collect()}
    assert got == {t: v for t, v in rows.items() if v}


def test_statistics(spark):
    rng = random.Random(5)
    rows = [(round(rng.random(), 1), rng.random() < 0.5) for _ in range(300)]
    got = {r.score: r.rate for r in evaluation.isotonic(spark.createDataFrame(rows, "s double, ok boolean"), "s", "ok").collect()}
    blocks = []
    for s in sorted({s for s, _ in rows}):
        own = [ok for x, ok in rows if x == s]
        blocks.append([sum(own), len(own), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a, b = blocks[-2], blocks.pop()
            blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2] + b[2]]
    want = {s: round(k / n, 6) for k, n, scores in blocks for s in scores}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 2e-6 for s in want)
    low, high = spark.range(1).select(*evaluation.wilson(F.lit(8), F.lit(10))).collect()[0]
    assert abs(low - 0.4901) < 1e-3 and abs(high - 0.9433) < 1e-3
    assert spark.range(1).select(*evaluation.wilson(F.lit(0), F.lit(0))).collect()[0][0] is None
    assert tuple(evaluation.bootstrap_interval(spark.createDataFrame([("a", 1.0)], "k string, v double"), "k", "v").collect()[0]) == (None, None)


def test_spans(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 5, 8), ("k", 20, 30), ("k", 22, 25), ("j", 1, 2)], "k string, a int, b int")
    assert {tuple(r) for r in segments.merged_spans(df, "k", "a", "b").collect()} == {("k", 0, 8), ("k", 20, 30), ("j", 1, 2)}
    points = spark.createDataFrame([("k", p) for p in (0, 7, 8, 19, 24, 30)], "k string, p int")
    assert sorted(r.p for r in folds.outside(points, df, "k", "p", "a", "b").collect()) == [8, 19, 30]


def test_as_of_and_latest(spark):
    events = spark.createDataFrame([("u", 1), ("u", 5), ("u", 9), ("v", 2)], "u string, at int")
    marks = spark.createDataFrame([("u", 5, "x"), ("u", 6, "y")], "u string, at int, m string")
    assert {(r.u, r.at, r.as_of) for r in graph.as_of(events, marks, ["u"], "at", "m").collect()} == {("u", 1, None), ("u", 5, "x"), ("u", 9, "y"), ("v", 2, None)}
    assert {tuple(r) for r in graph.latest(marks, ["u"], ["at"], ["m"]).collect()} == {("u", "y")}


def test_identities(spark):
    rows = [("1", "ann", "a@x"), ("2", "ann", "a@x"), ("3", "ann", "b@x"), ("4", "bob", "a@x"), ("5", "cy", None), ("6", "cy", None), ("7", "cy", "c@x")]
    got = {tuple(r) for r in knowledge.identity_pairs(spark.createDataFrame(rows, "k string, name string, mail string"), "k", "name", ["mail"]).collect()}
    assert got == {("1", "3", "conflicting_attributes"), ("1", "4", "conflicting_attributes"), ("5", "7", "possible_identity")}


def test_spans_of_text(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from sedimenta.operators import spans

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.sampled_from(["word ", "a. ", "\n", "longerword", "? "]), max_size=80), st.integers(4, 40))
    def check(pieces, size):
        text = "".join(pieces)
        got = spans.boundary_parts(text, size)
        assert "".join(text[a:b] for a, b in got) == text and all(b - a <= size for a, b in got) and all(a < b for a, b in got[:-1])

    check()
    assert spans.boundary_parts("one two\nthree four", 12) == [(0, 8), (8, 18)]
    assert spans.locate("a  quick\nbrown fox", "quick brown") == (3, 14) and spans.locate("abc", "x") is None and spans.locate("abc", " ") is None
    assert spans.quotation_scopes('Ann Lee said: "It is done." Then „fertig“.') == [(15, 26, "Ann Lee"), (34, 40, None)]
    assert spans.folded("STRASSE é") == "strasse é" and spans.folded(None) is None
    df = spark.createDataFrame([(1, "see REF-123 and a@b.ch"), (2, None), (3, "")], "k int, text string")
    got = spans.pattern_spans(df, "k", {"id": r"REF-\d+", "mail": r"\w+@\w+\.\w+"}).collect()
    assert {tuple(r) for r in got} == {(1, "id", "REF-123", 4, 11), (1, "mail", "a@b.ch", 16, 22)}
    assert [tuple(r) for r in spans.parts(df.filter("k = 3"), "k", 9).collect()] == [(3, 0, 0)]


def test_streams_and_their_batch_twins(spark):
    from sedimenta.session import table
    from sedimenta.streaming import events

    folder = "/root/testdata/sf0.001"
    batch = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    flow = events.stream(spark, folder, "events.parquet", table(spark, folder, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = lambda df: sorted((tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    for make in (lambda df: events.windowed(df, "ts", ["event_type"], "6 hours", "3650 days", "value"), lambda df: events.sessions(df, "ts", "user_id", "3 hours", "3650 days")):
        assert rows(events.drain(make(flow), "complete")) == rows(make(batch))
    assert events.once(batch.unionByName(batch), "ts", ["event_id"], "1 day").count() == batch.count()


def test_routes_and_expansion(spark):
    from sedimenta.operators import retrieval

    rows = [("s1", "d1", 0, "red fox REF-1"), ("s2", "d1", 1, "nothing"), ("s3", "d2", 0, "blue bird"), ("s4", "d3", 0, "red bird"), ("s5", "d4", 0, "")]
    s = spark.createDataFrame(rows, "id string, document string, ordinal bigint, text string")
    links = spark.createDataFrame([("d1", "d2"), ("d2", "d1")], "node string, other string")
    index = lexical.freeze(s.select("id", "text"), "id", scratch(spark))
    concepts = spark.createDataFrame([("fox", "fox"), ("fox", "fuchs")], "concept string, surface string")
    vectors = spark.createDataFrame([("s4", [1.0, 0.0]), ("s4", [0.0, 1.0]), ("s1", [0.0, -1.0]), ("s2", [0.0, 0.0])], "id string, vector array<double>")
    asked = spark.createDataFrame([([0.0, 2.0],)], "vector array<double>")
    claims = spark.createDataFrame([("s1", "REF-1", "seen"), ("s5", "REF-1", "seen"), ("s3", "REF-2", "seen")], "id string, entity string, predicate string")
    found = retrieval.hybrid(s, index, links, concepts, vectors, asked, claims, "find REF-1", ["fox", "red"], ["red fox"], r"REF-\d+", most=1)
    by = {}
    for r in found.routes.collect():
        by.setdefault(r.route, []).append((r.pos, r.id))
    by = {k: [i for _, i in sorted(v)] for k, v in by.items()}
    assert by["lexical"] == ["s1", "s4"] and by["concept"] == by["literal"] == by["identifier"] == ["s1"] and by["dense"] == ["s4", "s1"]
    assert by["claim_context"] == ["s1", "s5"] and by["structural"] == ["s2"] and "explicit_graph" not in by and {r.node for r in found.pending.collect()} == {"d2", "d3", "d4"}
    wide = retrieval.hybrid(s, index, links, concepts, vectors, asked, claims, "find REF-1", ["fox", "red"], ["red fox"], r"REF-\d+", seeds=1)
    assert {r.id for r in wide.routes.filter("route = 'explicit_graph'").collect()} == {"s3"} and wide.pending.collect() == []
    counts = {r.route: r.n for r in retrieval.accounting(wide.routes, s, wide.pending, links.limit(0), reranked=3).collect()}
    assert counts["union"] == 5 and counts["not discovered"] == 0 and counts["unreranked"] == 2 and counts["pending"] == counts["unresolved links"] == 0
    relevance = spark.createDataFrame([("d1", 0.8), ("d2", 0.2), ("d3", 0.4)], "document string, relevance double")
    assert {r.document: (r.score, r.reason) for r in retrieval.expansion(relevance, links).collect()} == {"d1": (0.8, "own"), "d2": (0.81, "link"), "d3": (0.4, "own")}
    assert retrieval.question_terms("Who saw the Red fox?", {"who", "the"}) == ["fox", "red", "saw"]


def test_review(spark):
    log = [("a", 1, 0, "lease"), ("a", 2, 10, "submit"), ("b", 3, 0, "lease"), ("c", 4, 90, "lease"), ("d", 5, 5, "fail")]
    df = spark.createDataFrame(log, "task string, n int, s int, kind string").withColumn("at", F.timestamp_seconds("s"))
    got = {r.task: (r.state, r.attempts) for r in review.lease_states(df, "task", "at", "n", "kind", F.timestamp_seconds(F.lit(100)), 60).collect()}
    assert got == {"a": ("done", 1), "b": ("open", 1), "c": ("leased", 1), "d": ("failed", 0)}
    pairs = review.paired_schedule(spark.range(20).withColumnRenamed("id", "k"), "k", 2, "s").collect()
    assert len(pairs) == 80 and all({r.place for r in pairs if (r.k, r.repetition) == key} == {0, 1} for key in {(r.k, r.repetition) for r in pairs})
    given = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "k string")
    used = spark.createDataFrame([("x",), ("y",), ("y",), ("w",), (None,)], "k string")
    assert {tuple(r) for r in review.covered_once(given, used, "k").collect()} == {("y", 2), ("z", 0), ("w", 1)}


def test_budget_packing_tries_all_rows_of_a_group(spark):
    rows = [("a", i, 60 if i else 50) for i in range(300)] + [("a", 300, 50), ("a", 301, 1), ("b", 1, 101), ("b", 2, None), ("b", 3, 100), (None, 4, 7)]
    got = {tuple(r) for r in ranking.packed(spark.createDataFrame(rows, "g string, i bigint, s bigint"), "i", "s", 100, "i", "g").collect()}
    assert got == {("a", 0), ("a", 300), ("b", 3), (None, 4)}


def test_budget_pack_query_loses_no_document_of_a_large_source(spark, monkeypatch):
    from sedimenta.plans import ranking as plans

    rows = [(i, "s", 4000) for i in range(300)] + [(300, "s", 2000)]
    monkeypatch.setattr(plans, "_ranked", lambda s, d: s.createDataFrame(rows, "doc_id bigint, source string, n bigint"))
    assert {r.doc_id for r in plans.w9_budget_pack(spark, "").collect()} == {0, 300}


def test_related_items_whatever_their_features_weigh(spark):
    rows = [(f"d{i}", "other", "hot") for i in range(60)] + [("d0", "identifier", "REF-1"), ("d1", "identifier", "REF-1"), ("d0", "paragraph", "p"), ("d2", "paragraph", "p"), ("d0", "other", "hot"), ("d0", "identifier", None), (None, "identifier", "REF-1")]
    occurrences = spark.createDataFrame(rows, "item string, kind string, feature string").withColumn("other", F.lit("x"))
    near = graph.adjacency(spark.createDataFrame([("d0", "d3"), ("d0", "d0"), ("far", "d0")], "a string, b string"), "a", "b")
    got = {r.other: (r.tier, r.shared, r.linked) for r in graph.related(occurrences, near, spark.createDataFrame([("d0",)], "item string")).collect()}
    assert len(got) == 60 and got["d1"] == (1, 2, False) and got["d2"] == (2, 2, False) and got["d3"] == (0, 1, True) and got["far"] == (0, 0, True) and got["d9"] == (3, 1, False)
    assert {r.f for r in graph.shared_by(occurrences.select("item", F.col("feature").alias("f")), "d0", "d1", "item", "f").collect()} == {"hot", "REF-1"}


def test_interval_conflicts_against_all_pairs(spark):
    from datetime import date, timedelta

    rng = random.Random(5)
    day = lambda n: date(2031, 1, 1) + timedelta(days=n)
    rows = []
    for k in range(120):
        start = rng.randrange(200)
        rows.append((k, rng.choice(["e", "f", None]), rng.choice("+-"), day(start), rng.choice([None, day(start), day(start + rng.randrange(60))])))
    rows.append((999, "e", "+", day(5), day(1)))
    df = spark.createDataFrame(rows, "k int, e string, p string, s date, t date")
    last = lambda t: t or date(9999, 12, 31)
    want = {(a[0], b[0], max(a[3], b[3]), min(last(a[4]), last(b[4])), max(a[3], b[3]) == min(last(a[4]), last(b[4]))) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] != b[2] and 999 not in (a[0], b[0]) and max(a[3], b[3]) <= min(last(a[4]), last(b[4]))}
    got = [tuple(r) for r in graph.interval_conflicts(df, ["e"], "k", "s", "t", F.col("l.p") != F.col("r.p")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_chains_are_made_as_they_are_checked(spark):
    rows = [(u, i, f"p{i % 3}") for u in "ab" for i in range(50)]
    made = review.chained(spark.createDataFrame(rows, "u string, i int, p string"), "u", "i", "p")
    assert made.count() == 100 and review.chain_breaks(made, ["u"], "i", F.col("p"), "hash", "prev").collect() == []
    broken = made.withColumn("p", F.when(F.col("i") == 7, "other").otherwise(F.col("p")))
    assert {tuple(r) for r in review.chain_breaks(broken, ["u"], "i", F.col("p"), "hash", "prev").collect()} == {("a", 7), ("b", 7)}


def test_pages_by_rows_and_bytes(spark):
    import pytest

    df = spark.createDataFrame([(i, 10 * i) for i in range(1, 8)], "k int, n int")
    page = lambda after, limit, most: links.page(df, "k", F.col("n"), "s", after, limit, most).orderBy("k").collect()
    first = page(None, 3, 1000)
    assert [(r.k, r.total, r.remaining) for r in first] == [(1, 7, 4), (2, 7, 4), (3, 7, 4)] and links.cursor_key(first[0].next_cursor, "s") == "3"
    assert [r.k for r in page(3, 9, 95)] == [4, 5] and page(7, 3, 100) == [] and [(r.k, r.remaining) for r in page(5, 3, 20)] == [(6, -1)]
    last = page(5, 9, 1000)
    assert [(r.k, r.remaining, r.next_cursor) for r in last] == [(6, 0, None), (7, 0, None)]
    with pytest.raises(ValueError):
        links.cursor_key(first[0].next_cursor, "other")


def test_paths_and_days(spark):
    uris = ["file:///v/a%20b/c+d.txt", "file:///v/../x", "file:///v/a/..", "file:///w/a", "http://v/a", None, "file:///v//a"]
    df = spark.createDataFrame([(u,) for u in uris], "u string")
    assert [r[0] for r in df.select(X.relative_path(F.col("u"), "/v")).collect()] == ["a b/c+d.txt", None, None, None, None, None, None]
    days = spark.createDataFrame([("2031-01-01", "2031-01-01", True), ("2031-01-01", "2031-01-02", True), ("2031-01-03", "2031-01-02", True), (None, "2031-01-02", True), (None, None, False)], "a string, b string, r boolean")
    got = [r[0] for r in days.select(X.day_relation(F.col("a").cast("date"), F.col("b").cast("date"), F.col("r"))).collect()]
    assert got == ["same", "before", "after", "unknown", "not_required"]
    assert spark.range(1).select(X.canonical_json(F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"), F.lit('x"y').alias("c")))).collect()[0][0] == '{"a":1,"b":null,"c":"x\\"y"}'


def test_signatures_are_those_of_hmac(spark):
    import hmac

    texts = ["", "a|b", "Grüße " * 50, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for key in ("k", "a longer key " * 9):
        got = [r[0] for r in df.select(review.signature(F.col("t"), key)).collect()]
        assert got == [None if t is None else hmac.new(key.encode(), t.encode(), "sha256").hexdigest() for t in texts]


def test_upserts_and_compatible_words(spark):
    from sedimenta.operators import spans
    from sedimenta.sources import sinks

    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    assert {tuple(r) for r in sinks.upserted(old, new, ["k"]).collect()} == {(1, "a", "kept"), (2, "c", "updated"), (3, None, "inserted")}
    df = spark.createDataFrame([(1, "ﬁle Ａ-１ Straße\u00a0x²"), (2, ""), (3, None)], "k int, text string")
    assert {tuple(r) for r in spans.compatible_words(df, "k").collect()} == {(1, "file a 1 strasse x2"), (2, "")}


def test_discovery_and_plan_candidates(spark):
    from math import log

    from sedimenta.operators import policies

    rows = [("s1", "d1", "red fox runs"), ("s2", "d1", "nothing"), ("s3", "d2", "blue bird"), ("s4", "d3", "red bird"), ("s5", "d4", "plain"), ("s6", "d5", "plain")]
    units = spark.createDataFrame(rows, "id string, document string, text string")
    index = lexical.freeze(units.select("id", "text"), "id", scratch(spark))
    near = spark.createDataFrame([("d1", "d2"), ("d2", "d1"), ("d1", "d1")], "node string, other string")
    features = spark.createDataFrame([("d1", "REF-1"), ("d4", "REF-1"), ("d1", "REF-2"), ("d2", "REF-3")], "document string, feature string")
    got = {r.id: (r.score, r.reason, r.terms) for r in policies.discovery(index, units, near, features, ["red", "fox"]).collect()}
    w = {"red": 1 + log(6 / 3), "fox": 1 + log(6 / 2)}
    red = w["red"] / sum(w.values())
    assert set(got) == {"s1", "s3", "s4", "s5"} and got["s1"] == (1.0, "own", 2) and got["s3"] == (0.95, "link", 0) and got["s5"] == (round(0.65 + 0.35 / 2, 6), "feature", 0) and got["s4"] == (round(red, 6), "own", 1)
    found = {r.id: (r.document, r.score, r.strong) for r in policies.plan_candidates(index, units, near, ["red", "fox"], {"red fox": 3}).collect()}
    best = w["red"] / 61 + w["fox"] / 61 + 1 + 3 * (1 + log(6 / 2)) / 61
    longer = w["red"] / 62 + w["fox"] / 61 + 1 + 3 * (1 + log(6 / 2)) / 61  # the shorter text comes first for "red"
    assert found["s1"][1] in (round(best, 6), round(longer, 6)) and found["s1"][2] and found["s2"] == ("d1", 0.0, True) and abs(found["s3"][1] - 0.85 * found["s1"][1]) < 1e-5 and not found["s3"][2] and "s5" not in found
    turns = {(r.id, r.turn) for r in policies.in_turn(policies.plan_candidates(index, units, near, ["red", "fox"], {})).collect()}
    assert ("s1", 0) in turns and ("s2", 1) in turns


def test_isotonic_fit_against_the_min_max_formula(spark):
    rng = random.Random(11)
    rows = [(float(k), rng.random() < k / 60) for k in range(60) for _ in range(rng.randrange(1, 6))] + [(None, True)]
    by = {}
    for k, hit in rows[:-1]:
        n = by.setdefault(k, [0, 0])
        n[0] += hit
        n[1] += 1
    keys = sorted(by)
    mean = lambda i, j: sum(by[k][0] for k in keys[i : j + 1]) / sum(by[k][1] for k in keys[i : j + 1])
    want = {float(keys[p]): round(max(min(mean(i, j) for j in range(p, len(keys))) for i in range(p + 1)), 6) for p in range(len(keys))}
    df = spark.createDataFrame(rows, "score double, hit boolean")
    for parts in (1, 7):
        got = {r.score: r.rate for r in evaluation.isotonic(df.repartition(parts), "score", "hit").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert evaluation.isotonic(df.limit(0), "score", "hit").collect() == []
