"""Queries on lexical and dense search, fusion, diversity, budgets, paging and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.operators import lexical, ranking
from sedimenta.plans.registry import query
from sedimenta.session import scratch, table

TERMS = ["register", "crates", "inspection"]
PHRASE = ["never", "reached", "the", "desk"]

#: SQL of the word index, and of BM25 scores per term over all documents.
_INDEX = r"""
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w),
i AS (SELECT doc_id, dl, term, count(*) AS tf FROM t GROUP BY ALL)"""
_BM25 = (
    _INDEX
    + r""",
h AS (SELECT * FROM i WHERE term IN ('register', 'crates', 'inspection')),
df AS (SELECT term, count(*) AS df FROM h GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
s AS (SELECT doc_id, term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM h JOIN df USING (term), st)"""
)


def _documents(spark, d):
    return table(spark, d, "documents")


_INDEXES: dict[tuple[str, str], lexical.Index] = {}


def frozen(spark, d):
    """The index of the documents of a folder, written when it is first asked for and kept as long as the application runs."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = lexical.freeze(_documents(spark, d), "doc_id", scratch(spark))
    return _INDEXES[key]


def _scores(spark, d):
    return lexical.bm25_scores(frozen(spark, d), TERMS)


@query(f"WITH {_INDEX} SELECT (SELECT count(*) FROM w) AS n, round((SELECT avg(len(w)) FROM w), 6) AS avgdl, count(*) AS postings, count(DISTINCT term) AS terms FROM i")
def t5_frozen_index(spark, d):
    """The index of all documents, written once: how many documents, postings and terms it has, and their mean length."""
    index = frozen(spark, d)
    counts = index.postings.groupBy("term").agg(F.count("*").alias("n")).agg(F.sum("n").alias("postings"), F.count("*").alias("terms"))
    return index.statistics.select("n", F.round("avgdl", 6).alias("avgdl")).crossJoin(counts)


@query(f"WITH {_BM25} SELECT doc_id, round(sum(score), 6) AS score, count(*) AS matched FROM s GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10")
def t4_bm25_topk(spark, d):
    """The ten best documents for three terms."""
    return lexical.bm25_search(frozen(spark, d), TERMS, 10)


@query(f"WITH {_BM25} SELECT doc_id, round(sum(score), 6) AS score, count(*) AS matched FROM s GROUP BY 1")
def t6_or_bm25(spark, d):
    """Scores of all documents with any of the terms."""
    return _scores(spark, d).groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("matched"))


@query(f"WITH {_INDEX} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM i GROUP BY 1")
def a4_document_frequency(spark, d):
    """How many documents have each word, and how often."""
    return frozen(spark, d).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(r"WITH w AS (SELECT source, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS dl FROM documents WHERE text IS NOT NULL) SELECT source, count(*) AS n, round(avg(dl), 6) AS avgdl FROM w GROUP BY 1")
def t5_snapshot_stats(spark, d):
    """The statistics that ranking is frozen to, for each source."""
    return lexical.corpus_statistics(_documents(spark, d), by=["source"]).withColumn("avgdl", F.round("avgdl", 6))


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, w FROM w)
SELECT doc_id, count(*) AS hits FROM p WHERE w[p] = 'never' AND w[p + 1] = 'reached' AND w[p + 2] = 'the' AND w[p + 3] = 'desk' GROUP BY 1
""")
def t4_phrase_match(spark, d):
    """Documents with a phrase of four words."""
    return lexical.phrase_matches(frozen(spark, d), PHRASE)


@query("""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 20
""")
def t9_cosine_topk(spark, d):
    """The twenty vectors nearest to the first one."""
    vectors = table(spark, d, "embeddings")
    return ranking.cosine_search(vectors, vectors.orderBy("vec_id").limit(1).select("embedding"), "vec_id", "embedding", 20)


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT vec_id AS query_key, v AS q FROM e WHERE vec_id % 100 = 0),
s AS (SELECT query_key, vec_id, round(list_cosine_similarity(v, q), 6) AS score FROM e, q WHERE vec_id <> query_key)
SELECT query_key, vec_id, score, row_number() OVER (PARTITION BY query_key ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10
""")
def t9_vector_neighbours(spark, d):
    """For each hundredth vector its ten nearest, of all."""
    v = table(spark, d, "embeddings")
    return ranking.cosine_neighbours(v, v.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10).withColumn("rank", F.col("rank").cast("bigint"))


@query("""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT label, max(round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6)) AS score, count(*) AS windows FROM embeddings, q GROUP BY 1
""")
def l6_window_max(spark, d):
    """The best window of each group."""
    vectors = table(spark, d, "embeddings")
    q = F.col("q")
    score = F.round(ranking.dot(F.col("embedding"), q) / (ranking.norm(F.col("embedding")) * ranking.norm(q)), 6)
    asked = vectors.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return vectors.crossJoin(F.broadcast(asked)).select("label", score.alias("score")).groupBy("label").agg(F.max("score").alias("score"), F.count("*").alias("windows"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS length FROM embeddings")
def x29_vector_lengths(spark, d):
    """Lengths of all vectors."""
    return table(spark, d, "embeddings").select("vec_id", F.round(ranking.norm(F.col("embedding")), 6).alias("length"))


@query(
    f"""WITH {_BM25},
r AS (SELECT doc_id, term AS route, round(score, 9) AS score FROM s UNION ALL SELECT doc_id, 'literal', 1.0 FROM documents WHERE contains(text, 'claim register') UNION ALL SELECT doc_id, 'path', 1.0 FROM documents WHERE contains(source_path, 'claims')),
k AS (SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY route ORDER BY score DESC, doc_id)) AS rr FROM r)
SELECT doc_id, round(sum(rr), 6) AS score, count(*) AS routes FROM k GROUP BY 1"""
)
def w1_rrf_fusion(spark, d):
    """Routes of three terms, a literal and a path fused by reciprocal ranks."""
    docs = _documents(spark, d)
    terms = _scores(spark, d).select("doc_id", F.col("term").alias("route"), F.round("score", 9).alias("score"))
    literal = docs.filter(F.col("text").contains("claim register")).select("doc_id", F.lit("literal").alias("route"), F.lit(1.0).alias("score"))
    path = docs.filter(F.col("source_path").contains("claims")).select("doc_id", F.lit("path").alias("route"), F.lit(1.0).alias("score"))
    return ranking.fuse(terms.unionByName(literal).unionByName(path), "doc_id", "route", [F.desc("score"), "doc_id"])


_TOTAL = f"WITH {_BM25}, r AS (SELECT doc_id, round(sum(score), 6) AS score, count(*) AS matched FROM s GROUP BY 1), j AS (SELECT r.*, source, length(text) AS n FROM r JOIN documents USING (doc_id))"


def _ranked(spark, d):
    scores = t6_or_bm25(spark, d)
    return scores.join(_documents(spark, d).select("doc_id", "source", F.length("text").cast("bigint").alias("n")), "doc_id")


@query(f"{_TOTAL} SELECT doc_id, source, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) - 1 AS turn FROM j")
def w3_doc_diversity(spark, d):
    """Hits with their turn within their source."""
    return ranking.diversified(_ranked(spark, d), ["source"], [F.desc("score"), "doc_id"]).select("doc_id", "source", "score", "turn")


@query(
    f"""{_TOTAL}, q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) - 1 AS turn, max(score) OVER (PARTITION BY source) AS best FROM j)
SELECT doc_id, row_number() OVER (ORDER BY turn, best DESC, source, doc_id) AS place FROM q QUALIFY place <= 100"""
)
def w4_round_robin(spark, d):
    """The first hundred hits, sources in turn, the best source first."""
    turns = ranking.diversified(_ranked(spark, d), ["source"], [F.desc("score"), "doc_id"]).withColumn("best", F.max("score").over(W.partitionBy("source")))
    top = turns.orderBy("turn", F.desc("best"), "source", "doc_id").limit(100)
    return top.select("doc_id", F.row_number().over(W.orderBy("turn", F.desc("best"), "source", "doc_id")).cast("bigint").alias("place"))


@query(f"{_TOTAL}, u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM j) SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM u WHERE used <= 6000")
def w10_prefix_budget(spark, d):
    """The best hits of each source up to the first that goes over 6,000 characters."""
    return ranking.within_budget(_ranked(spark, d), F.col("n"), 6000, [F.desc("score"), "doc_id"], ["source"]).select("source", "doc_id", "used")


@query(
    f"""{_TOTAL.replace("WITH", "WITH RECURSIVE", 1)}, o AS (SELECT source, doc_id, n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM j), f AS (SELECT source, doc_id, r, CASE WHEN n <= 6000 THEN n ELSE 0 END AS used, n <= 6000 AS took FROM o WHERE r = 1
UNION ALL SELECT o.source, o.doc_id, o.r, CASE WHEN f.used + o.n <= 6000 THEN f.used + o.n ELSE f.used END, f.used + o.n <= 6000 FROM f JOIN o ON o.source = f.source AND o.r = f.r + 1) SELECT source, doc_id FROM f WHERE took"""
)
def w9_budget_pack(spark, d):
    """Of each source the documents that fit into 6,000 characters, skipping those that are too large."""
    return ranking.packed(_ranked(spark, d), "doc_id", "n", 6000, "doc_id", "source")


@query(
    f"""{_TOTAL}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS k FROM j WHERE matched = 1), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS k FROM j WHERE matched > 1)
SELECT doc_id, 3 * (k // 2) + k % 2 AS slot FROM a WHERE k < 200 UNION ALL SELECT doc_id, 3 * k + 2 FROM b WHERE k < 100"""
)
def l14_interleave(spark, d):
    """Two hits of one pool, then one of the other."""
    hits = _ranked(spark, d)

    def pool(which: str, n: int):
        best = hits.filter(which).orderBy(F.desc("score"), "doc_id").limit(n)
        return best.select("doc_id", (F.row_number().over(W.orderBy(F.desc("score"), "doc_id")) - 1).cast("bigint").alias("k"))

    return ranking.interleaved(pool("matched = 1", 200), pool("matched > 1", 100), "k").select("doc_id", "slot")


@query("""
WITH s AS (SELECT DISTINCT id, document_version_id, ordinal FROM segments WHERE document_version_id IS NOT NULL)
SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after FROM s WINDOW w AS (PARTITION BY document_version_id ORDER BY ordinal NULLS FIRST, id)
""")
def w5_structural_neighbours(spark, d):
    """The segments before and after each one."""
    s = table(spark, d, "segments").filter("document_version_id IS NOT NULL").select("id", "document_version_id", "ordinal").distinct()
    w = W.partitionBy("document_version_id").orderBy("ordinal", "id")
    return s.select("id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))


@query("""
WITH c AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, doc_id, greatest(n - 20, 0) AS omitted FROM c WHERE k <= 20
""")
def w14_capped_candidates(spark, d):
    """Twenty documents of each tag, and how many more there are."""
    by = W.partitionBy("lang")
    c = _documents(spark, d).select("lang", "doc_id", F.row_number().over(by.orderBy("doc_id")).alias("k"), F.count("*").over(by).alias("n"))
    return c.filter("k <= 20").select("lang", "doc_id", F.greatest(F.col("n") - 20, F.lit(0)).alias("omitted"))


@query("WITH r AS (SELECT event_id, user_id FROM events WHERE event_id > 500) SELECT event_id, user_id, greatest((SELECT count(*) FROM r) - 50, 0) AS remaining FROM r ORDER BY event_id LIMIT 50")
def l1_keyset_page(spark, d):
    """The page of fifty events after a key."""
    return ranking.page(table(spark, d, "events").select("event_id", "user_id"), "event_id", 500, 50)


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 25 OFFSET 100")
def l4_offset_page(spark, d):
    """The fifth page of 25 events."""
    return table(spark, d, "events").select("event_id", "user_id").orderBy("event_id").offset(100).limit(25)


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('37' || CAST(doc_id AS VARCHAR)), doc_id) <= 5")
def l9_stratified_sample(spark, d):
    """Five documents of each source, drawn by a hash."""
    return ranking.hash_sample(_documents(spark, d), "source", "doc_id", "37", 5)


@query(rf"""WITH RECURSIVE {_BM25}, r AS (SELECT DISTINCT doc_id, term AS facet FROM s), m AS (SELECT doc_id, list_sort(list(facet)) AS f, len(list(facet)) AS n FROM r GROUP BY 1),
c(place, doc_id, fresh, done) AS (SELECT -1, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS VARCHAR[]) UNION ALL SELECT * FROM (
SELECT c.place + 1, m.doc_id, CAST(len(list_filter(m.f, lambda x: NOT list_contains(c.done, x))) AS BIGINT) AS fresh, list_concat(c.done, m.f) FROM c, m WHERE c.place < 4 AND len(list_filter(m.f, lambda x: NOT list_contains(c.done, x))) > 0
ORDER BY fresh DESC, m.doc_id LIMIT 1)) SELECT doc_id, CAST(place AS BIGINT) AS place, fresh FROM c WHERE place >= 0""")
def l10_facet_cover(spark, d):
    """Documents that together have the most different words of a question, chosen one by one, with how many each adds."""
    hits = _scores(spark, d).select("doc_id", F.col("term").alias("facet"))
    return ranking.facet_cover(hits, "doc_id", "facet", 5)


@query("""WITH h AS (SELECT source, max_by(doc_id, (ingested_at, doc_id)) AS head, max(ingested_at) AS last FROM documents GROUP BY 1) SELECT source, head, last = (SELECT max(ingested_at) FROM documents) AS current FROM h""")
def l13_latest_head(spark, d):
    """The document that came in last from each source, and whether any came in later."""
    heads = _documents(spark, d).groupBy("source").agg(F.max_by("doc_id", F.struct("ingested_at", "doc_id")).alias("head"), F.max("ingested_at").alias("at"))
    return heads.crossJoin(F.broadcast(heads.agg(F.max("at").alias("last")))).select("source", "head", (F.col("at") == F.col("last")).alias("current"))


_QUESTION = "which registry has the revised schedule and the witness statement"
_WORDS = sorted(set(_QUESTION.split()) - {"which", "has", "the", "and"})
_IN = ", ".join(f"'{w}'" for w in _WORDS)


@query(
    rf"""WITH {_INDEX}, m AS (SELECT doc_id, term FROM i WHERE term IN ({_IN})), n AS (SELECT count(*) AS n FROM documents), h AS (SELECT term, count(*) AS df FROM m GROUP BY 1),
x AS (SELECT m.doc_id, count(*) AS terms, sum(1 + ln((n + 1) / (df + 1)))  AS a, sum(1.0 / df) AS rarity FROM m JOIN h USING (term), n GROUP BY 1), tot AS (SELECT sum(1 + ln((n + 1) / (df + 1))) AS w FROM h, n)
SELECT doc_id, terms, round(a / w, 6) AS relevance, round(rarity, 6) AS rarity FROM x, tot"""
)
def t16_term_coverage(spark, d):
    """How much of a question's weight each document has, and how rare the words are that it has."""
    docs = _documents(spark, d)
    m = frozen(spark, d).hits(_WORDS)
    df = lexical.document_frequency(m, "doc_id")
    n = docs.agg(F.count("*").alias("n"))
    weights = df.crossJoin(F.broadcast(n)).select("term", "df", (1 + F.log((F.col("n") + 1) / (F.col("df") + 1))).alias("w"))
    total = weights.agg(F.sum("w").alias("total"))
    x = m.join(F.broadcast(weights), "term").groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("w").alias("a"), F.sum(1.0 / F.col("df")).alias("rarity"))
    return x.crossJoin(F.broadcast(total)).select("doc_id", "terms", F.round(F.col("a") / F.col("total"), 6).alias("relevance"), F.round("rarity", 6).alias("rarity"))


@query(
    rf"""WITH {_INDEX}, m AS (SELECT doc_id, term FROM i WHERE term IN ({_IN})), h AS (SELECT term, count(*) AS df FROM m GROUP BY 1),
x AS (SELECT m.doc_id, source, count(*) AS terms, round(sum(1.0 / df), 9) AS rarity FROM m JOIN h USING (term) JOIN documents USING (doc_id) GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rarity DESC, terms DESC, doc_id) - 1 AS diversity FROM x)
SELECT doc_id, row_number() OVER (ORDER BY diversity, rarity DESC, terms DESC, doc_id) AS place FROM v QUALIFY place <= 60"""
)
def t15_reference_rank(spark, d):
    """The first sixty documents by (turn in its source, rarity, words matched)."""
    docs = _documents(spark, d)
    m = frozen(spark, d).hits(_WORDS)
    x = m.join(F.broadcast(lexical.document_frequency(m, "doc_id")), "term").groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum(1.0 / F.col("df")), 9).alias("rarity"))
    order = [F.desc("rarity"), F.desc("terms"), "doc_id"]
    v = ranking.diversified(x.join(docs.select("doc_id", "source"), "doc_id"), ["source"], order)
    top = v.orderBy("turn", *order).limit(60)
    return top.select("doc_id", F.row_number().over(W.orderBy("turn", *order)).cast("bigint").alias("place"))


@query(rf"SELECT doc_id, CAST(list_sum([{', '.join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in _WORDS)}]) AS BIGINT) AS contained FROM documents WHERE text IS NOT NULL ORDER BY contained DESC, doc_id LIMIT 12")
def t21_contained_words(spark, d):
    """The twelve documents that contain most words of a question."""
    n = sum((F.lower("text").contains(w).cast("bigint") for w in _WORDS[1:]), F.lower("text").contains(_WORDS[0]).cast("bigint"))
    return _documents(spark, d).filter("text IS NOT NULL").select("doc_id", n.alias("contained")).orderBy(F.desc("contained"), "doc_id").limit(12)


@query("""
WITH a AS (SELECT doc_id FROM documents WHERE contains(text, 'register')), b AS (SELECT doc_id FROM documents WHERE contains(text, 'ledger')), x AS (SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either,
(SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_first, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_second)
SELECT *, only_first = 0 AND only_second = 0 AS equal FROM x
""")
def u_route_sets(spark, d):
    """Union, intersection and differences of two routes, and whether they are the same set."""
    docs = _documents(spark, d)
    a, b = (docs.filter(F.contains("text", F.lit(w))).select("doc_id").distinct() for w in ("register", "ledger"))
    sides = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), "doc_id", "full")
    only = [F.count_if(F.col(x).isNotNull() & F.col(y).isNull()) for x, y in ("ab", "ba")]
    return sides.agg(F.count("*").alias("either"), F.count_if(F.col("a") & F.col("b")).alias("both"), only[0].alias("only_first"), only[1].alias("only_second"), ((only[0] == 0) & (only[1] == 0)).alias("equal"))
