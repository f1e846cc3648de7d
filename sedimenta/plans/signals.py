"""Queries on observations, flags, memberships, upserts and signed packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.operators import review, spans
from sedimenta.plans import retrieval
from sedimenta.plans.registry import query
from sedimenta.session import table
from sedimenta.sources import sinks

_KEY = "a key for tests"
_SEG = retrieval._SEG
_TERMS = ", ".join(f"'{t}'" for t in retrieval.TERMS)


@query(rf"""WITH s AS (SELECT DISTINCT id, text FROM segments WHERE modality = 'ocr' AND text IS NOT NULL AND id IS NOT NULL), w AS (SELECT id, unnest(regexp_extract_all(text, '[^\s]+')) AS word FROM s)
SELECT id, count(*) AS words, count(*) FILTER (regexp_matches(word, '[a-zäöüßéèñ][0-9]|[0-9][a-zäöüßéèñ]')) AS flagged FROM w GROUP BY 1""")
def m9_flagged_words(spark, d):
    """Words of scanned segments, and those that mix small letters and digits as misread ones do."""
    s = table(spark, d, "segments").filter("modality = 'ocr' AND text IS NOT NULL AND id IS NOT NULL").select("id", "text").distinct()
    w = s.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("word"))
    return w.groupBy("id").agg(F.count("*").alias("words"), F.count_if(F.col("word").rlike("[a-zäöüßéèñ][0-9]|[0-9][a-zäöüßéèñ]")).alias("flagged"))


@query("""WITH l AS (SELECT DISTINCT relation_type, trim(from_node) AS a, trim(to_node) AS b FROM explicit_links WHERE status = 'resolved' AND from_node IS NOT NULL AND to_node IS NOT NULL), n AS (SELECT relation_type, a, count(*) AS n FROM l GROUP BY ALL)
SELECT relation_type, CAST(sum(n) AS BIGINT) AS memberships, CAST(sum(least(n, 3)) AS BIGINT) AS shown, CAST(sum(greatest(n - 3, 0)) AS BIGINT) AS omitted, count(*) FILTER (n > 3) AS shortened FROM n GROUP BY 1""")
def a30_omitted_memberships(spark, d):
    """How many memberships a view of three for each node shows, by kind, and how many it leaves out."""
    l = table(spark, d, "explicit_links").filter("status = 'resolved' AND from_node IS NOT NULL AND to_node IS NOT NULL").select("relation_type", F.trim("from_node").alias("a"), F.trim("to_node").alias("b")).distinct()
    n = l.groupBy("relation_type", "a").agg(F.count("*").alias("n"))
    return n.groupBy("relation_type").agg(F.sum("n").alias("memberships"), F.sum(F.least("n", F.lit(3))).alias("shown"), F.sum(F.greatest(F.col("n") - 3, F.lit(0))).alias("omitted"), F.count_if(F.col("n") > 3).alias("shortened"))


@query(f"""WITH {_SEG}, x(concept, surface) AS (VALUES {retrieval._VAL((c, s) for c, names in retrieval.CONCEPTS.items() for s in names)}), o AS (SELECT concept, surface, id FROM g JOIN x ON contains(lower(text), surface))
SELECT concept, surface, count(DISTINCT id) AS segments, min(id) AS first FROM o GROUP BY ALL""")
def t20_observation_index(spark, d):
    """The segments that each wording of a concept leads to."""
    lexicon = spark.createDataFrame([(c, s) for c, names in retrieval.CONCEPTS.items() for s in names], "concept string, surface string")
    low = retrieval._segments(spark, d).select("id", F.lower("text").alias("low"))
    found = low.join(F.broadcast(lexicon), F.contains(F.col("low"), F.col("surface"))).select("concept", "surface", "id").distinct()
    return found.groupBy("concept", "surface").agg(F.count("*").alias("segments"), F.min("id").alias("first"))


@query(rf"""WITH {_SEG}, {retrieval._LNK}, m AS (SELECT id, document, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')), [{_TERMS}])) AS n FROM g), t AS (SELECT id, document FROM m WHERE n >= 2),
nb AS (SELECT DISTINCT other AS document FROM k WHERE node IN (SELECT document FROM t)) SELECT id, 'words' AS reason FROM t UNION ALL SELECT id, 'packet' FROM g SEMI JOIN nb USING (document) WHERE id NOT IN (SELECT id FROM t)""")
def g21_issue_discovery(spark, d):
    """Segments that share two words with an issue, and those of documents linked with theirs."""
    from sedimenta.functions.text import words

    s = retrieval._segments(spark, d)
    shared = F.size(F.array_intersect(words(F.col("text")), F.array(*(F.lit(t) for t in retrieval.TERMS))))
    t = s.filter(shared >= 2).select("id", "document")
    near = retrieval._links(spark, d).join(t.select(F.col("document").alias("node")).distinct(), "node", "left_semi").select(F.col("other").alias("document")).distinct()
    packet = s.join(near, "document", "left_semi").join(t.select("id"), "id", "left_anti").select("id", F.lit("packet").alias("reason"))
    return t.select("id", F.lit("words").alias("reason")).unionByName(packet)


_ROWS = "p AS (SELECT DISTINCT member, lower(trim(feature, chr(32) || chr(9))) AS feature FROM postings WHERE member IS NOT NULL AND trim(feature, chr(32) || chr(9)) <> '')"


@query(f"""WITH {_ROWS}, o AS (SELECT member, feature, 1 AS version FROM p WHERE right(member, 1) < '8'), n AS (SELECT member, feature, 2 AS version FROM p WHERE right(member, 1) >= '4')
SELECT coalesce(o.member, n.member) AS member, coalesce(o.feature, n.feature) AS feature, coalesce(n.version, o.version) AS version, CASE WHEN o.member IS NULL THEN 'inserted' WHEN n.member IS NULL THEN 'kept' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.member = n.member AND o.feature = n.feature""")
def s25_upsert(spark, d):
    """Occurrences of features after a second load, which repeats a part of the first, was merged in."""
    p = table(spark, d, "postings").select("member", F.lower(F.btrim("feature", F.lit(" \t"))).alias("feature")).filter("member IS NOT NULL AND feature != ''").distinct()
    last = F.right("member", F.lit(1))
    return sinks.upserted(p.filter(last < "8").withColumn("version", F.lit(1)), p.filter(last >= "4").withColumn("version", F.lit(2)), ["member", "feature"])


@query(f"""WITH p AS (SELECT user_id, string_agg(event_id || ':' || event_type, '|' ORDER BY event_id) AS payload FROM events GROUP BY 1), s AS (SELECT user_id, payload, sha256(unhex('{review.pad(_KEY, 0x5C)}') || unhex(sha256(unhex('{review.pad(_KEY, 0x36)}') || encode(payload)))) AS signature FROM p)
SELECT user_id, signature, user_id % 7 <> 0 AS valid FROM s""")
def q9_signed_packages(spark, d):
    """The signature of each user's package, and whether it holds for what is in it now: those of each seventh user were changed afterwards."""
    parts = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    join = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["event_id"].cast("string"), F.lit(":"), x["event_type"])), "|")
    p = table(spark, d, "events").groupBy("user_id").agg(join(parts).alias("payload")).withColumn("signature", review.signature(F.col("payload"), _KEY))
    now = p.withColumn("payload", F.when(F.col("user_id") % 7 == 0, F.concat("payload", F.lit("|0:added"))).otherwise(F.col("payload")))
    return now.select("user_id", "signature", (F.col("signature") == review.signature(F.col("payload"), _KEY)).alias("valid"))


@query()
def x7_compatible_words(spark, d):
    """The words of each text in compatibility form (NFKC), casefolded."""
    return spans.compatible_words(table(spark, d, "documents"), "doc_id")


@query("""WITH l AS (SELECT DISTINCT id, from_node, relation_type FROM explicit_links WHERE id IS NOT NULL), r AS (SELECT relation_type, id, row_number() OVER (PARTITION BY relation_type ORDER BY id) AS r, count(*) OVER (PARTITION BY relation_type) AS n FROM (SELECT relation_type, min(id) AS id FROM l GROUP BY relation_type, from_node))
SELECT relation_type, id, n - r AS remaining FROM r WHERE r = 1""")
def l12_next_review(spark, d):
    """The next task of each pass, the first by id, and how many come after it."""
    tasks = table(spark, d, "explicit_links").filter("id IS NOT NULL").groupBy("relation_type", "from_node").agg(F.min("id").alias("id"))
    return tasks.groupBy("relation_type").agg(F.min("id").alias("id"), (F.count("*") - 1).alias("remaining"))
