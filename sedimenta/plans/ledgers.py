"""Queries on ledgers, reviews and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.operators import graph, review
from sedimenta.plans.registry import query
from sedimenta.session import table

_CHAIN = """RECURSIVE e AS (SELECT user_id, event_id, event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT user_id, event_id, payload, n, repeat('0', 64) AS prev, sha256(repeat('0', 64) || '|' || payload) AS hash FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_id, e.payload, e.n, c.hash, sha256(c.hash || '|' || e.payload) FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1),
h AS (SELECT user_id, event_id, payload, prev, CASE WHEN event_id % 97 = 0 THEN 'x' ELSE hash END AS hash FROM c)"""


@query(f"WITH {_CHAIN}, l AS (SELECT user_id, event_id, prev <> coalesce(lag(hash) OVER (PARTITION BY user_id ORDER BY event_id), repeat('0', 64)) OR hash <> sha256(prev || '|' || payload) AS wrong FROM h) SELECT user_id, event_id FROM l WHERE wrong")
def w8_hash_chain(spark, d):
    """Where chains of events are broken, of which each 97th record was tampered with after the chains were made."""
    made = review.chained(table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("payload")), "user_id", "event_id", "payload")
    tampered = made.withColumn("hash", F.when(F.col("event_id") % 97 == 0, "x").otherwise(F.col("hash")))
    return review.chain_breaks(tampered, ["user_id"], "event_id", F.col("payload"), "hash", "prev")


@query("SELECT user_id, event_type, max(event_id) AS n, arg_max(event_id, (ts, event_id)) AS latest, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY ALL")
def w12_latest_review(spark, d):
    """The last event of each user and type."""
    e = table(spark, d, "events")
    last = graph.latest(e, ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])
    n = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("n"))
    return last.join(n, ["user_id", "event_type"]).select("user_id", "event_type", "n", F.col("event_id").alias("latest"), F.round("value", 6).alias("value"))


_REVIEWS = "r AS (SELECT user_id, event_id, CASE WHEN event_id % 50 = 0 THEN -1 ELSE lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS supersedes FROM events)"


@query(f"WITH {_REVIEWS}, x AS (SELECT user_id, event_id, supersedes IS NOT DISTINCT FROM lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS ok FROM r) SELECT user_id, max(event_id) AS head, bool_and(ok) AS linear FROM x GROUP BY 1")
def w18_review_heads(spark, d):
    """The head of each chain of reviews, and whether the chain is linear."""
    w = W.partitionBy("user_id").orderBy("event_id")
    r = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 50 == 0, F.lit(-1).cast("bigint")).otherwise(F.lag("event_id").over(w)).alias("supersedes"))
    return review.heads(r, "user_id", "event_id", "event_id", "supersedes")


@query("""WITH l AS (SELECT user_id AS task, event_id, ts, CASE WHEN event_id % 5 = 0 THEN 'submit' WHEN event_id % 7 = 0 THEN 'fail' ELSE 'lease' END AS kind FROM events), now AS (SELECT max(ts) AS now FROM events),
e AS (SELECT task, arg_max(kind, (ts, event_id)) AS kind, max(ts) AS ts, count(*) FILTER (kind = 'lease') AS attempts FROM l GROUP BY 1)
SELECT task, CASE kind WHEN 'submit' THEN 'done' WHEN 'fail' THEN 'failed' ELSE CASE WHEN ts + INTERVAL 3600 SECOND > now THEN 'leased' ELSE 'open' END END AS state, attempts FROM e, now""")
def q2_lease_states(spark, d):
    """What has become of each task, from its log."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_id") % 5 == 0, "submit").when(F.col("event_id") % 7 == 0, "fail").otherwise("lease")
    log = e.select(F.col("user_id").alias("task"), "event_id", "ts", kind.alias("kind"))
    now = e.agg(F.max("ts").alias("now")).collect()[0].now
    return review.lease_states(log, "task", "ts", "event_id", "kind", F.lit(now), 3600)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) = max(CAST(json_extract(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id) AS current FROM events")
def q11_job_supersession(spark, d):
    """Which jobs are of the latest revision of their user."""
    jobs = table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return review.superseded(jobs, "user_id", "k").select("event_id", "current")


@query("""WITH r AS (SELECT s_suppkey, r AS repetition, CAST(('0x' || substring(sha256('11:' || s_suppkey || ':' || r), 1, 2)) AS BIGINT) % 2 AS flip FROM supplier, range(3) x(r))
SELECT s_suppkey, repetition, arm, CASE arm WHEN 'a' THEN flip ELSE 1 - flip END AS place FROM r, (VALUES ('a'), ('b')) v(arm)""")
def q12_paired_schedule(spark, d):
    """Both arms of each case, in an order drawn by a hash."""
    return review.paired_schedule(table(spark, d, "supplier"), "s_suppkey", 3, "11")


@query("WITH i AS (SELECT DISTINCT o_orderkey AS k FROM orders), r AS (SELECT l_orderkey AS k, max(l_linestatus) AS s FROM lineitem WHERE l_linenumber = 1 AND l_shipdate < TIMESTAMP '1995-06-17' GROUP BY 1) SELECT k AS o_orderkey, coalesce(s, 'unknown') AS status FROM i LEFT JOIN r USING (k)")
def q13_call_journal(spark, d):
    """Orders with the state of their first line, unknown where there is none."""
    results = table(spark, d, "lineitem").filter("l_linenumber = 1 AND l_shipdate < timestamp_ntz'1995-06-17 00:00:00'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("status"))
    return review.journal(table(spark, d, "orders"), results, "o_orderkey", "status")


@query("WITH g AS (SELECT DISTINCT id AS k FROM document_versions WHERE id IS NOT NULL), u AS (SELECT document_version_id AS k, count(*) AS n FROM segments WHERE document_version_id IS NOT NULL GROUP BY 1) SELECT k AS id, coalesce(n, 0) AS uses FROM g FULL JOIN u USING (k) WHERE g.k IS NULL OR n IS NULL OR n <> 1")
def q14_stage_coverage(spark, d):
    """Versions that segments don't use exactly once."""
    return review.covered_once(table(spark, d, "document_versions"), table(spark, d, "segments").select(F.col("document_version_id").alias("id")), "id")


@query("""WITH s AS (SELECT DISTINCT id, document_version_id FROM segments), l AS (SELECT DISTINCT id FROM explicit_links)
SELECT sha256('A|' || id) AS task_id, 'A' AS pass FROM s WHERE id IS NOT NULL UNION ALL SELECT sha256('A2|' || id), 'A2' FROM s WHERE id IS NOT NULL UNION ALL SELECT sha256('B|' || id), 'B' FROM l WHERE id IS NOT NULL""")
def q1_review_plan(spark, d):
    """A task for each segment and pass, and one for each link."""
    s, links = table(spark, d, "segments").select("id").distinct(), table(spark, d, "explicit_links").select("id").distinct()
    tasks = lambda df, name: df.filter("id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{name}|"), F.col("id")), 256).alias("task_id"), F.lit(name).alias("pass"))
    return tasks(s, "A").unionByName(tasks(s, "A2")).unionByName(tasks(links, "B"))
