"""Queries on aggregates and statistics of evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.operators import evaluation
from sedimenta.plans.registry import query
from sedimenta.session import table


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS large, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a1_state_counts(spark, d):
    """Events by type."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("large"), F.countDistinct("user_id").alias("users"))


@query("SELECT lower(trim(feature, chr(32) || chr(9))) AS feature, count(*) AS postings, count(DISTINCT member) AS members FROM postings WHERE trim(feature, chr(32) || chr(9)) <> '' GROUP BY 1")
def a2_postings_per_feature(spark, d):
    """How many postings and members each feature has."""
    f = F.lower(F.btrim("feature", F.lit(" \t")))
    return table(spark, d, "postings").select(f.alias("feature"), "member").filter("feature != ''").groupBy("feature").agg(F.count("*").alias("postings"), F.countDistinct("member").alias("members"))


@query("SELECT relation_type, status, count(*) AS n, count(DISTINCT id) AS links, count(*) FILTER (to_node IS NULL) AS open FROM explicit_links GROUP BY ALL")
def a5_links_by_kind(spark, d):
    """Links by kind and status."""
    return table(spark, d, "explicit_links").groupBy("relation_type", "status").agg(F.count("*").alias("n"), F.countDistinct("id").alias("links"), F.count_if(F.col("to_node").isNull()).alias("open"))


@query("SELECT v.id, count(DISTINCT p.id) AS passages FROM (SELECT DISTINCT id FROM document_versions) v LEFT JOIN passages p ON p.document_version_id = v.id GROUP BY 1")
def a6_passages_per_document(spark, d):
    """Passages of each version, 0 included."""
    v = table(spark, d, "document_versions").select("id").distinct()
    p = table(spark, d, "passages").select(F.col("id").alias("p"), F.col("document_version_id").alias("id"))
    return v.join(p, "id", "left").groupBy("id").agg(F.countDistinct("p").alias("passages"))


@query("""
WITH s AS (SELECT DISTINCT id, status, modality FROM segments)
SELECT modality, count(*) AS planned, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IS NULL OR status NOT IN ('ready', 'failed')) AS pending,
round(100.0::DOUBLE * count(*) FILTER (status = 'ready') / count(*), 4) AS percent FROM s GROUP BY 1
""")
def a7_coverage(spark, d):
    """How many segments of each modality are ready."""
    s = table(spark, d, "segments").select("id", "status", "modality").distinct()
    ready = F.count_if(F.col("status") == "ready")
    pending = F.count_if(F.col("status").isNull() | ~F.col("status").isin("ready", "failed"))
    return s.groupBy("modality").agg(F.count("*").alias("planned"), ready.alias("ready"), F.count_if(F.col("status") == "failed").alias("failed"), pending.alias("pending"), F.round(100.0 * ready / F.count("*"), 4).alias("percent"))


#: SQL: the declared language of each document, and the one that most of its common words are of.
_LANGUAGES = r"""
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents),
v AS (SELECT doc_id, c.lang, count(*) AS n FROM w JOIN common_words c USING (word) GROUP BY ALL),
g AS (SELECT doc_id, max_by(lang, (n, lang)) AS predicted FROM v GROUP BY 1),
l AS (SELECT d.doc_id, t.lang AS actual, g.predicted, d.source FROM documents d LEFT JOIN lang_tags t ON t.tag = d.lang LEFT JOIN g USING (doc_id))"""


def _languages(spark, d):
    docs, tags = table(spark, d, "documents"), table(spark, d, "lang_tags").select(F.col("tag").alias("lang"), F.col("lang").alias("actual"))
    from sedimenta.functions.text import words

    w = docs.select("doc_id", F.explode(words(F.col("text"))).alias("word"))
    votes = w.join(F.broadcast(table(spark, d, "common_words")), "word").groupBy("doc_id", "lang").agg(F.count("*").alias("n"))
    best = votes.groupBy("doc_id").agg(F.max_by("lang", F.struct("n", "lang")).alias("predicted"))
    return docs.select("doc_id", "lang", "source").join(F.broadcast(tags), "lang", "left").join(best, "doc_id", "left")


@query(f"""WITH {_LANGUAGES},
a AS (SELECT actual AS label, count(*) AS actual, count(*) FILTER (actual = predicted) AS tp FROM l WHERE actual IS NOT NULL GROUP BY 1), p AS (SELECT predicted AS label, count(*) AS predicted FROM l WHERE predicted IS NOT NULL GROUP BY 1)
SELECT label, coalesce(tp, 0) AS tp, coalesce(predicted, 0) - coalesce(tp, 0) AS fp, coalesce(actual, 0) - coalesce(tp, 0) AS fn, round(tp / nullif(predicted, 0), 6) AS precision, round(tp / nullif(actual, 0), 6) AS recall FROM a FULL JOIN p USING (label)""")
def a10_precision_recall(spark, d):
    """Languages by common words against the declared ones."""
    return evaluation.confusion(_languages(spark, d), "actual", "predicted")


@query(f"""WITH {_LANGUAGES} SELECT count(*) FILTER (actual = predicted) AS passed, count(*) FILTER (actual <> predicted) AS failed, count(*) FILTER (actual IS NULL OR predicted IS NULL) AS unknown, count(*) AS n,
CASE WHEN count(*) = count(actual = predicted) THEN round(avg(CAST(actual = predicted AS INT)), 6) END AS rate FROM l""")
def a11_passed_unknown(spark, d):
    """Passed, failed and unknown; the rate is null while something is unknown."""
    same = F.col("actual") == F.col("predicted")
    return _languages(spark, d).agg(
        F.count_if(same).alias("passed"), F.count_if(~same).alias("failed"), F.count_if(same.isNull()).alias("unknown"), F.count("*").alias("n"),
        F.when(F.count("*") == F.count(same), F.round(F.avg(same.cast("int")), 6)).alias("rate"),
    )


@query(f"WITH {_LANGUAGES}, x AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'dev' END AS split FROM l) SELECT coalesce(split, 'all') AS split, count(*) AS n, count(*) FILTER (actual = predicted) AS correct FROM x GROUP BY GROUPING SETS ((split), ())")
def a13_split_outcomes(spark, d):
    """Outcomes per split and over all."""
    x = _languages(spark, d).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("dev"))
    sets = x.groupingSets([["split"], []], "split").agg(F.count("*").alias("n"), F.count_if(F.col("actual") == F.col("predicted")).alias("correct"))
    return sets.select(F.coalesce("split", F.lit("all")).alias("split"), "n", "correct")


@query(f"""WITH {_LANGUAGES}, c AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (actual = predicted)::DOUBLE AS k FROM l GROUP BY 1)
SELECT source, round(greatest((k/n + 3.8416/(2*n) - 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4*n*n))) / (1 + 3.8416/n), 0), 6) AS low, round(least((k/n + 3.8416/(2*n) + 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4*n*n))) / (1 + 3.8416/n), 1), 6) AS high FROM c""")
def a14_wilson(spark, d):
    """Intervals of the share of right labels of each source."""
    c = _languages(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("actual") == F.col("predicted")).alias("k"))
    low, high = evaluation.wilson(F.col("k"), F.col("n"))
    return c.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
m AS (SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY 1) SELECT event_type, median, round(max(CASE WHEN r = ceil(n * 0.95) THEN value END), 6) AS p95, round(max(CASE WHEN r - 1 = round_even((n - 1) * 0.9, 0) THEN value END), 6) AS p90 FROM r JOIN m USING (event_type) GROUP BY ALL""")
def a15_percentiles(spark, d):
    """Median, nearest-rank 95th and index-rank 90th percentile of each type."""
    e = table(spark, d, "events").select("event_type", "value")
    median = e.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"))
    p95 = evaluation.nearest_rank(e, ["event_type"], "value", 0.95).select("event_type", F.round("value", 6).alias("p95"))
    p90 = evaluation.index_rank(e, ["event_type"], "value", 0.9).select("event_type", F.round("value", 6).alias("p90"))
    return median.join(p95, "event_type").join(p90, "event_type")


@query("""
WITH c AS (SELECT event_type, round(avg(value), 6) AS v, row_number() OVER (ORDER BY event_type) - 1 AS i FROM events GROUP BY 1), n AS (SELECT count(*) AS n FROM c),
x AS (SELECT r, CAST(('0x' || substring(sha256('37:' || r || ':' || k), 1, 12)) AS BIGINT) % n AS i FROM range(2000) a(r), n, range(100) b(k) WHERE k < n),
m AS (SELECT r, round(avg(v), 9) AS m FROM x JOIN c USING (i) GROUP BY 1), p AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS p FROM m)
SELECT max(CASE WHEN p = 49 THEN m END) AS low, max(CASE WHEN p = 1949 THEN m END) AS high FROM p
""")
def a17_bootstrap_ci(spark, d):
    """Interval of the mean over clusters, by 2,000 hash-drawn resamples."""
    c = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("v"))
    return evaluation.bootstrap_interval(c, "event_type", "v")


#: SQL and rows: a score in steps of 0.05 and whether a document's label is right.
_SCORED = rf"{_LANGUAGES}, y AS (SELECT l.doc_id, actual = predicted AS ok, round(least(coalesce(k, 0), 20) / 20.0, 2)::DOUBLE AS score FROM l LEFT JOIN (SELECT doc_id, sum(n) AS k FROM v GROUP BY 1) USING (doc_id) WHERE actual IS NOT NULL AND predicted IS NOT NULL)"


def _scored(spark, d):
    from sedimenta.functions.text import words

    w = table(spark, d, "documents").select("doc_id", F.explode(words(F.col("text"))).alias("word")).join(F.broadcast(table(spark, d, "common_words")), "word")
    k = w.groupBy("doc_id").agg(F.count("*").alias("k"))
    x = _languages(spark, d).filter("actual IS NOT NULL AND predicted IS NOT NULL").join(k, "doc_id", "left")
    return x.select("doc_id", (F.col("actual") == F.col("predicted")).alias("ok"), F.round(F.least(F.coalesce("k", F.lit(0)), F.lit(20)) / 20.0, 2).alias("score"))


@query(f"WITH {_SCORED} SELECT round(avg(pow(score - CAST(ok AS INT), 2)), 6) AS brier, count(*) AS n FROM y")
def a18_brier(spark, d):
    """The mean squared error of scores as probabilities."""
    return _scored(spark, d).agg(F.round(F.avg(F.pow(F.col("score") - F.col("ok").cast("int"), F.lit(2))), 6).alias("brier"), F.count("*").alias("n"))


@query(f"""WITH {_SCORED}, q AS (SELECT score, sum(CAST(ok AS INT))::DOUBLE AS s, count(*)::DOUBLE AS n FROM y GROUP BY 1),
r AS (SELECT a.score AS lo, b.score AS hi, sum(c.s) / sum(c.n) AS mean FROM q a JOIN q b ON a.score <= b.score JOIN q c ON c.score BETWEEN a.score AND b.score GROUP BY ALL),
m AS (SELECT x.score, r.lo, min(r.mean) AS least FROM q x JOIN r ON r.lo <= x.score AND r.hi >= x.score GROUP BY ALL) SELECT score, round(max(least), 6) AS rate FROM m GROUP BY 1""")
def a19_isotonic(spark, d):
    """The non-decreasing fit of being right by score."""
    return evaluation.isotonic(_scored(spark, d), "score", "ok")


@query(r"""WITH w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, source, array_to_string(w[5:12], ' ') AS quote FROM w WHERE len(w) >= 12),
g AS (SELECT DISTINCT doc_id AS other, source, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS quote FROM w WHERE len(w) >= 8),
f AS (SELECT DISTINCT q.doc_id FROM q JOIN g USING (source, quote) WHERE other <> doc_id)
SELECT source, count(*) AS quotes, count(f.doc_id) AS found, round(avg(CAST(f.doc_id IS NOT NULL AS INT)), 6) AS recall FROM q LEFT JOIN f USING (doc_id) GROUP BY 1""")
def a21_evidence_recall(spark, d):
    """Quotations of eight words from each document that stand in another one of its source."""
    from sedimenta.functions.text import words

    w = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "source", words(F.col("text")).alias("w"))
    run = lambda i: F.xxhash64(F.slice("w", i, F.lit(8)))
    q = w.filter(F.size("w") >= 12).select("doc_id", "source", run(F.lit(5)).alias("g"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 7), run))
    grams = w.filter(F.size("w") >= 8).select("source", F.col("doc_id").alias("other"), F.explode(runs).alias("g"))
    hits = q.join(grams, ["source", "g"]).filter("other != doc_id").select("doc_id").distinct().withColumn("found", F.lit(True))
    return q.join(hits, "doc_id", "left").groupBy("source").agg(F.count("*").alias("quotes"), F.count("found").alias("found"), F.round(F.avg(F.coalesce("found", F.lit(False)).cast("int")), 6).alias("recall"))


@query("""WITH e AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 ORDER BY 1 LIMIT 2) GROUP BY ALL),
a AS (SELECT min(event_type) AS a, max(event_type) AS b FROM e), p AS (SELECT user_id, max(v) FILTER (event_type = a) AS x, max(v) FILTER (event_type = b) AS y FROM e, a GROUP BY 1)
SELECT user_id, round(y - x, 6) AS delta, x IS NOT NULL AND y IS NOT NULL AS paired FROM p""")
def a22_paired_delta(spark, d):
    """The difference of two arms for each user that has both."""
    e = table(spark, d, "events")
    arms = [r.event_type for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    v = e.filter(F.col("event_type").isin(arms)).groupBy("user_id").pivot("event_type", arms).agg(F.avg("value"))
    return v.select("user_id", F.round(F.col(arms[1]) - F.col(arms[0]), 6).alias("delta"), (F.col(arms[0]).isNotNull() & F.col(arms[1]).isNotNull()).alias("paired"))


@query("SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS known, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS unknown, count(*) AS calls FROM events GROUP BY 1")
def a23_usage_totals(spark, d):
    """Totals with the number of unknown ones, which make them a lower bound."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(k).alias("known"), F.count_if(k.isNull()).alias("unknown"), F.count("*").alias("calls"))


@query("""WITH f AS (SELECT DISTINCT member, lower(trim(feature, chr(32) || chr(9))) AS f FROM postings WHERE member IS NOT NULL AND trim(feature, chr(32) || chr(9)) <> '')
SELECT member, count(*) AS n, greatest(count(*) - 8, 0) AS remaining, array_to_string(list_slice(list_sort(list(f)), 1, 8), ' ') AS first FROM f GROUP BY 1""")
def a25_bounded_evidence(spark, d):
    """The eight smallest features of each member, and how many more there are."""
    f = table(spark, d, "postings").select("member", F.lower(F.btrim("feature", F.lit(" \t"))).alias("f")).filter("member IS NOT NULL AND f != ''").distinct()
    return f.groupBy("member").agg(F.count("*").alias("n"), F.greatest(F.count("*") - 8, F.lit(0)).alias("remaining"), F.array_join(F.slice(F.array_sort(F.collect_list("f")), 1, 8), " ").alias("first"))


@query("SELECT user_id, min_by(event_id, (-value, event_id)) AS best, max_by(event_type, (ts, event_id)) AS latest FROM events GROUP BY 1")
def a27_extremes(spark, d):
    """The best and the latest event of each user."""
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(-F.col("value"), "event_id")).alias("best"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


@query("""WITH g AS (SELECT source_path, array_to_string(list_sort(list_distinct(list(status))), ',') AS warnings, count(*) AS gaps FROM (SELECT DISTINCT id, source_path, status FROM segments) WHERE status <> 'ready' GROUP BY 1)
SELECT source_path, warnings, gaps FROM g""")
def a31_gap_guidance(spark, d):
    """Parts that are not ready, by path."""
    s = table(spark, d, "segments").select("id", "source_path", "status").distinct().filter("status != 'ready'")
    return s.groupBy("source_path").agg(F.array_join(F.array_sort(F.collect_set("status")), ",").alias("warnings"), F.count("*").alias("gaps"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def a_pricing_summary(spark, d):
    """A wide aggregate over the largest star table."""
    li = table(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n")
    )
