"""Queries on links, neighbourhoods, closures and shared features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.operators import graph
from sedimenta.plans.registry import query
from sedimenta.session import table


def _links(spark, d, *kinds):
    links = table(spark, d, "explicit_links").filter("status = 'resolved'").filter(F.col("relation_type").isin(*kinds))
    return links.select(F.trim("from_node").alias("a"), F.trim("to_node").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct()


_DOC_LINKS = "SELECT DISTINCT trim(from_node) AS a, trim(to_node) AS b FROM explicit_links WHERE status = 'resolved' AND relation_type IN ('EMAIL_REPLY_REFERENCE', 'ATTACHMENT_OF') AND from_node IS NOT NULL AND to_node IS NOT NULL"


@query("""
WITH h AS (SELECT DISTINCT segment_id, message_id, in_reply_to FROM mail_headers), m AS (SELECT message_id AS r, count(DISTINCT segment_id) AS n, min(segment_id) AS t FROM h WHERE message_id IS NOT NULL GROUP BY 1)
SELECT segment_id, in_reply_to, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN n = 1 THEN t END AS target FROM h LEFT JOIN m ON h.in_reply_to = m.r WHERE in_reply_to IS NOT NULL
""")
def g3_reply_resolution(spark, d):
    """Replies and the mail they answer, if it is exactly one."""
    h = table(spark, d, "mail_headers").select("segment_id", "message_id", "in_reply_to").distinct()
    refs = h.filter("in_reply_to IS NOT NULL").select("segment_id", "in_reply_to")
    return graph.resolve(refs, h, "in_reply_to", "message_id", "segment_id").select("segment_id", "in_reply_to", "status", "target")


@query("""
WITH v AS (SELECT DISTINCT id, source_entry_id, original_blob_sha, observed_at FROM document_versions WHERE source_entry_id IS NOT NULL),
l AS (SELECT id, lag(id) OVER w AS previous, coalesce(original_blob_sha <> lag(original_blob_sha) OVER w, false) AS changed FROM v WINDOW w AS (PARTITION BY source_entry_id ORDER BY observed_at NULLS FIRST, id))
SELECT id, previous, changed FROM l WHERE previous IS NOT NULL
""")
def j21_previous_version(spark, d):
    """Each version with the one observed before it, and whether the content changed."""
    v = table(spark, d, "document_versions").filter("source_entry_id IS NOT NULL").select("id", "source_entry_id", "original_blob_sha", "observed_at").distinct()
    w = W.partitionBy("source_entry_id").orderBy("observed_at", "id")
    seen = v.select("id", F.lag("id").over(w).alias("previous"), F.coalesce(F.col("original_blob_sha") != F.lag("original_blob_sha").over(w), F.lit(False)).alias("changed"))
    return seen.filter("previous IS NOT NULL")


@query(f"""WITH l AS ({_DOC_LINKS}), n AS (SELECT a AS node, b AS other FROM l UNION ALL SELECT b, a FROM l WHERE a <> b) SELECT node, count(*) AS neighbours, min(other) AS first FROM n GROUP BY 1""")
def g7_adjacency(spark, d):
    """How many neighbours each node has, over links in both directions."""
    n = graph.adjacency(_links(spark, d, "EMAIL_REPLY_REFERENCE", "ATTACHMENT_OF"), "a", "b")
    return n.groupBy("node").agg(F.count("*").alias("neighbours"), F.min("other").alias("first"))


@query(f"""
WITH l AS ({_DOC_LINKS}), n AS (SELECT a AS node, b AS other FROM l UNION ALL SELECT b, a FROM l WHERE a <> b),
s AS (SELECT DISTINCT node FROM n ORDER BY 1 LIMIT 12), one AS (SELECT DISTINCT other AS node FROM n WHERE node IN (FROM s) AND other NOT IN (FROM s)),
two AS (SELECT DISTINCT other AS node FROM n WHERE node IN (FROM one) AND other NOT IN (FROM s) AND other NOT IN (FROM one))
SELECT node, CAST(depth AS BIGINT) AS depth FROM (SELECT node, 0 AS depth FROM s UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two) ORDER BY depth, node LIMIT 64
""")
def g6_bounded_search(spark, d):
    """What is within two steps of twelve nodes, 64 at most."""
    n = graph.adjacency(_links(spark, d, "EMAIL_REPLY_REFERENCE", "ATTACHMENT_OF"), "a", "b")
    seeds = n.select("node").distinct().orderBy("node").limit(12)
    return graph.bounded_search(n, seeds, 2, 64)


@query(f"""WITH RECURSIVE l AS ({_DOC_LINKS}), s AS (SELECT min(b) AS node FROM l UNION SELECT DISTINCT b FROM l WHERE b LIKE 'D0%'), c AS (SELECT node FROM s UNION SELECT l.a FROM c JOIN l ON l.b = c.node) SELECT node FROM c""")
def g15_closure(spark, d):
    """Everything that answers, or is attached to, chosen documents, directly or not."""
    links = _links(spark, d, "EMAIL_REPLY_REFERENCE", "ATTACHMENT_OF")
    seeds = links.agg(F.min("b").alias("node")).unionByName(links.filter("b LIKE 'D0%'").select(F.col("b").alias("node")))
    return graph.closure(links, seeds, "a", "b")


_FEATURES = "f AS (SELECT DISTINCT member AS item, lower(trim(feature, chr(32) || chr(9))) AS feature FROM postings WHERE member IS NOT NULL AND trim(feature, chr(32) || chr(9)) <> '')"


@query(f"""
WITH {_FEATURES}, k AS (SELECT feature, count(*) AS df FROM f GROUP BY 1 HAVING count(*) BETWEEN 2 AND 12)
SELECT feature, df, array_to_string(list_sort(list(item)), ' ') AS members FROM k JOIN f USING (feature) GROUP BY ALL
""")
def g18_shared_identifiers(spark, d):
    """Features that two to twelve members have, with these."""
    f = F.lower(F.btrim("feature", F.lit(" \t")))
    rows = table(spark, d, "postings").select(F.col("member"), f.alias("feature")).filter("feature != '' AND member IS NOT NULL").distinct()
    few = rows.groupBy("feature").agg(F.count("*").alias("df")).filter("df BETWEEN 2 AND 12")
    return rows.join(few, "feature").groupBy("feature", "df").agg(F.array_join(F.array_sort(F.collect_list("member")), " ").alias("members"))


@query("""
WITH a AS (SELECT l_partkey, l_suppkey, l_orderkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT n_name, count(*) AS lines, count(DISTINCT l_partkey) AS parts, count(DISTINCT o_custkey) AS customers FROM a JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1
""")
def j1_star_join(spark, d):
    """A fact table joined with its dimensions."""
    li, o = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    s, n = table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == n.n_nationkey)
    return joined.groupBy("n_name").agg(F.count("*").alias("lines"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("o_custkey").alias("customers"))


@query("""
WITH a AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem), x AS (SELECT * FROM a WHERE k % 100 = 0), s AS (SELECT x.k AS "left", y.k AS "right", count(*) AS shared FROM x JOIN a y ON x.p = y.p AND x.k <> y.k GROUP BY ALL)
SELECT * FROM s WHERE shared > 1
""")
def j6_shared_parts(spark, d):
    """For each hundredth order all others that have several parts in common with it."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    asked = rows.filter("l_orderkey % 100 = 0").select(F.col("l_orderkey").alias("left"), "l_partkey")
    pairs = asked.join(rows, "l_partkey").filter(F.col("left") != F.col("l_orderkey")).groupBy("left", F.col("l_orderkey").alias("right")).agg(F.count("*").alias("shared"))
    return pairs.filter("shared > 1")


@query("""
WITH s AS (SELECT DISTINCT document_version_id AS k, CAST(char_start AS BIGINT) AS s, CAST(char_end AS BIGINT) AS e, id FROM segments WHERE document_version_id IS NOT NULL AND char_end > char_start),
w AS (SELECT k, unnest(range(0, max(e), 1000)) AS lo FROM s GROUP BY k)
SELECT w.k AS document_version_id, lo, id FROM w JOIN s ON s.k = w.k AND s.s < lo + 1000 AND s.e > lo
""")
def j9_overlap_join(spark, d):
    """Windows of 1,000 characters and the segments they overlap."""
    from sedimenta.operators.segments import overlapping

    s = table(spark, d, "segments").filter("document_version_id IS NOT NULL AND char_end > char_start")
    s = s.select("document_version_id", F.col("char_start").cast("bigint").alias("start"), F.col("char_end").cast("bigint").alias("end"), "id").distinct()
    w = s.groupBy("document_version_id").agg(F.max("end").alias("m")).select("document_version_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1, F.lit(1000).cast("bigint"))).alias("lo"))
    return overlapping(w.withColumn("hi", F.col("lo") + 1000), s, "document_version_id", 2000).select("document_version_id", "lo", "id")


@query("""
WITH h AS (SELECT DISTINCT segment_id FROM mail_headers), s AS (SELECT DISTINCT id FROM segments)
SELECT 'missing' AS rule, count(*) AS n FROM h ANTI JOIN s ON h.segment_id = s.id UNION ALL SELECT 'unexpected', count(*) FROM s ANTI JOIN h ON h.segment_id = s.id UNION ALL SELECT 'both', count(*) FROM s SEMI JOIN h ON h.segment_id = s.id
""")
def j3_anti_joins(spark, d):
    """Headers without segment, segments without header, and both."""
    h, s = table(spark, d, "mail_headers").select(F.col("segment_id").alias("id")).distinct(), table(spark, d, "segments").select("id").distinct()
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    return count("missing", h.join(s, "id", "left_anti")).unionByName(count("unexpected", s.join(h, "id", "left_anti"))).unionByName(count("both", s.join(h, "id", "left_semi")))


@query("SELECT a.n_nationkey AS \"left\", b.n_nationkey AS \"right\" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j15_pairs_in_block(spark, d):
    """All pairs within small blocks."""
    n = table(spark, d, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("left")), n.select("n_regionkey", F.col("n_nationkey").alias("right"))
    return a.join(b, "n_regionkey").filter(F.col("left") < F.col("right")).select("left", "right")


@query("""
WITH e AS (SELECT DISTINCT o_custkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders) SELECT k, day, lead(day) OVER (PARTITION BY k ORDER BY day) AS next FROM e QUALIFY next IS NOT NULL
""")
def j22_calendar_chain(spark, d):
    """Days of a customer's orders, each with the next one."""
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct()
    return e.withColumn("next", F.lead("day").over(W.partitionBy("k").orderBy("day"))).filter("next IS NOT NULL")


@query("""
WITH t AS (SELECT min(event_type) AS t FROM events), m AS (SELECT user_id, ts, max(event_id) AS mark FROM events, t WHERE event_type = t GROUP BY ALL), e AS (SELECT * FROM events, t WHERE event_type <> t)
SELECT e.event_id, coalesce(m.mark, -1) AS as_of FROM e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.ts
""")
def j23_asof_mark(spark, d):
    """Each event with the last one of the first type that the user had before."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    t = e.agg(F.min("event_type").alias("t"))
    e = e.crossJoin(F.broadcast(t))
    marks = e.filter("event_type = t").groupBy("user_id", "ts").agg(F.max("event_id").alias("mark"))
    return graph.as_of(e.filter("event_type != t").select("event_id", "user_id", "ts"), marks, ["user_id"], "ts", "mark").select("event_id", F.coalesce("as_of", F.lit(-1)).alias("as_of"))


@query(f"""WITH l AS ({_DOC_LINKS}), n AS (SELECT DISTINCT a AS k FROM l UNION SELECT b FROM l), v AS (SELECT k FROM n ORDER BY k LIMIT 200) SELECT a, b FROM l WHERE a IN (FROM v) AND b IN (FROM v) ORDER BY a, b LIMIT 800""")
def l15_graph_view(spark, d):
    """The links among the first two hundred nodes."""
    links = _links(spark, d, "EMAIL_REPLY_REFERENCE", "ATTACHMENT_OF")
    nodes = links.select(F.col("a").alias("k")).unionByName(links.select(F.col("b").alias("k"))).distinct()
    return graph.capped_view(nodes, links, "k", "a", "b", 200).select("a", "b")


@query("""
SELECT 'dangling' AS rule, count(*) AS n FROM (SELECT DISTINCT trim(to_node) AS k FROM explicit_links WHERE status = 'resolved' AND relation_type = 'ATTACHMENT_OF') l ANTI JOIN document_versions v ON v.id = l.k WHERE k IS NOT NULL
UNION ALL SELECT 'repeated id', count(*) FROM (SELECT id FROM (SELECT DISTINCT * EXCLUDE (derivation_json) FROM explicit_links) GROUP BY 1 HAVING count(*) > 1)
""")
def g20_graph_verification(spark, d):
    """Links whose end doesn't exist, and ids with several rows."""
    links = table(spark, d, "explicit_links")
    ends = links.filter("status = 'resolved' AND relation_type = 'ATTACHMENT_OF'").select(F.trim("to_node").alias("id")).filter("id IS NOT NULL").distinct()
    dangling = ends.join(table(spark, d, "document_versions").select("id"), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("dangling").alias("rule"), "n")
    several = links.drop("derivation_json").distinct().groupBy("id").count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated id").alias("rule"), "n")
    return dangling.unionByName(several)
