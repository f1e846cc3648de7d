"""Queries on dates, claims, conflicts and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions import text as X
from sedimenta.operators import graph, knowledge
from sedimenta.plans.registry import query
from sedimenta.session import table

_DATE = knowledge.DATE


@query(rf"SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_DATE}')) AS surface FROM documents")
def k1_date_mentions(spark, d):
    """Every written date."""
    return knowledge.date_mentions(table(spark, d, "documents"), "doc_id")


@query(rf"""
WITH m AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b\d{{1,2}}[/.]\d{{1,2}}[/.]\d{{4}}\b')) AS s FROM documents),
p AS (SELECT s, string_split_regex(s, '[-/.]') AS p FROM m),
r AS (SELECT s, CASE WHEN contains(s, '-') THEN [try_cast(s AS DATE)] ELSE [try_cast(p[3] || '-' || lpad(p[2], 2, '0') || '-' || lpad(p[1], 2, '0') AS DATE), CASE WHEN contains(s, '/') THEN try_cast(p[3] || '-' || lpad(p[1], 2, '0') || '-' || lpad(p[2], 2, '0') AS DATE) END] END AS r FROM p)
SELECT s AS surface, array_to_string(list_transform(list_sort(list_distinct(list_filter(r, lambda x: x IS NOT NULL))), lambda x: strftime(x, '%Y-%m-%d')), ' ') AS readings FROM r
""")
def x20_date_readings(spark, d):
    """All days each numeric date can mean; a date with points is taken day-first."""
    numeric = r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[/.]\d{1,2}[/.]\d{4}\b"
    m = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(numeric), F.lit(0))).alias("surface")).distinct()
    readings = knowledge.date_readings(F.col("surface"), F.col("surface").contains("."))
    return m.select("surface", F.array_join(F.transform(readings, lambda x: F.date_format(x, "yyyy-MM-dd")), " ").alias("readings"))


#: Claims templated from orders: who approved, or didn't, which order.
_SENTENCES = """s AS (SELECT o_orderkey AS k, CAST(o_custkey % 7 AS VARCHAR) AS c, CASE o_orderstatus WHEN 'F' THEN 'Alice approved order ' || (o_orderkey % 500) || '.' WHEN 'O' THEN 'Alice did not approve order ' || (o_orderkey % 500) || '.'
ELSE 'Ben Stone will approve order ' || (o_orderkey % 500) || ' only after inspection.' END AS t FROM orders)"""


def _sentences(spark, d):
    n = (F.col("o_orderkey") % 500).cast("string")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Alice approved order "), n, F.lit(".")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("Alice did not approve order "), n, F.lit(".")))
        .otherwise(F.concat(F.lit("Ben Stone will approve order "), n, F.lit(" only after inspection.")))
    )
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.alias("text"))


_CLAIMS = f"""{_SENTENCES}, c AS (SELECT k, CASE WHEN t LIKE 'Alice%' THEN 'Alice' ELSE 'Ben Stone' END AS actor, regexp_extract(t, 'order (\\d+)', 1) AS entity, CASE WHEN contains(t, ' not ') THEN 'negative' ELSE 'positive' END AS polarity,
CASE WHEN contains(t, 'will') THEN 'planned' ELSE 'asserted' END AS modality, CASE WHEN contains(t, 'only after') THEN 'only after inspection' END AS condition FROM s)"""


@query(f"WITH {_CLAIMS} SELECT * FROM c")
def k6_claims(spark, d):
    """Claims of sentences that are one whole clause."""
    return knowledge.claims(_sentences(spark, d), "k")


_PACK = (
    ("Ann Lee signed contract {k}.", "sign", "contract", "positive", "asserted", "en"),
    ("Invoice {k} must not be paid unless it is checked.", "pay", "invoice", "negative", "prohibited", "en"),
    ("Shipment {k} may not be delivered.", "deliver", "shipment", "unresolved", "unresolved", "en"),
    ("Anna hat den Auftrag {k} nicht genehmigt.", "approve", "order", "negative", "asserted", "de"),
    ("Die Rechnung {k} muss nicht bezahlt werden.", "pay", "invoice", "unresolved", "not_required", "de"),
    ("Was order {k} approved?", None, None, None, None, None),
)


@query(
    "WITH o AS (SELECT o_orderkey AS k, o_orderkey % 6 AS r FROM orders) SELECT k, CASE r "
    + " ".join(f"WHEN {i} THEN '{p}'" for i, (_, p, *_) in enumerate(_PACK) if p) + " END AS predicate, CASE r "
    + " ".join(f"WHEN {i} THEN '{e}:' || k" for i, (_, _, e, *_) in enumerate(_PACK) if e) + " END AS entity, CASE r "
    + " ".join(f"WHEN {i} THEN '{x[3]}'" for i, x in enumerate(_PACK) if x[3]) + " END AS polarity, CASE r "
    + " ".join(f"WHEN {i} THEN '{x[4]}'" for i, x in enumerate(_PACK) if x[4]) + " END AS modality, CASE r "
    + " ".join(f"WHEN {i} THEN '{x[5]}'" for i, x in enumerate(_PACK) if x[5]) + " END AS language FROM o WHERE r < 5"
)
def k6_rule_pack(spark, d):
    """Claims in two languages, with what stays unresolved."""
    k, text = F.col("o_orderkey").cast("string"), F.lit(None).cast("string")
    for i, (t, *_) in enumerate(_PACK):
        before, after = t.split("{k}")
        text = F.when(F.col("o_orderkey") % 6 == i, F.concat(F.lit(before), k, F.lit(after))).otherwise(text)
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.alias("text"))
    return knowledge.clause_claims(s, "k").select("k", "predicate", "entity", "polarity", "modality", "language")


@query(f"WITH {_CLAIMS} SELECT actor, entity, count(DISTINCT k) AS members, min(k) AS first FROM c WHERE modality = 'asserted' AND condition IS NULL GROUP BY ALL HAVING count(DISTINCT k) >= 2 AND count(DISTINCT polarity) >= 2")
def g9_conflict_groups(spark, d):
    """Claims about the same order that don't agree."""
    return knowledge.conflict_groups(k6_claims(spark, d).filter("modality = 'asserted' AND condition IS NULL"), ["actor", "entity"], "polarity", "k")


@query(f"WITH {_CLAIMS} SELECT entity, count(*) AS evidence, count(*) FILTER (polarity = 'positive' AND modality = 'asserted') AS supports, count(*) FILTER (polarity = 'negative') AS contradicts, count(*) FILTER (condition IS NOT NULL) AS conditional, count(DISTINCT actor) AS actors FROM c GROUP BY 1")
def k13_evidence_sets(spark, d):
    """What speaks for and against each order."""
    c = k6_claims(spark, d)
    return c.groupBy("entity").agg(
        F.count("*").alias("evidence"), F.count_if((F.col("polarity") == "positive") & (F.col("modality") == "asserted")).alias("supports"), F.count_if(F.col("polarity") == "negative").alias("contradicts"),
        F.count("condition").alias("conditional"), F.countDistinct("actor").alias("actors"),
    )


@query("""
WITH v AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS p, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(30 AS INT) END AS e FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT a.k AS "left", b.k AS "right", strftime(greatest(a.s, b.s), '%Y-%m-%d') AS overlap_start, strftime(least(coalesce(a.e, DATE '9999-12-31'), coalesce(b.e, DATE '9999-12-31')), '%Y-%m-%d') AS overlap_end, greatest(a.s, b.s) = least(coalesce(a.e, DATE '9999-12-31'), coalesce(b.e, DATE '9999-12-31')) AS boundary
FROM v a JOIN v b ON a.c = b.c AND a.k < b.k AND a.p <> b.p WHERE greatest(a.s, b.s) <= least(coalesce(a.e, DATE '9999-12-31'), coalesce(b.e, DATE '9999-12-31'))
""")
def j12_interval_conflicts(spark, d):
    """Opposite states of a customer's orders whose times overlap."""
    day = F.col("o_orderdate").cast("date")
    v = table(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "O")).select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("p"), day.alias("s"), F.when(F.col("o_orderkey") % 10 != 0, F.date_add(day, 30)).alias("e")
    )
    found = graph.interval_conflicts(v, ["c"], "k", "s", "e", F.col("l.p") != F.col("r.p"))
    return found.select("left", "right", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("overlap_start", "overlap_end")), "boundary")


@query("""
WITH v AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(30 AS INT) END AS e FROM orders)
SELECT k, CASE WHEN DATE '1996-06-15' < s THEN 'before' WHEN DATE '1996-06-15' > e THEN 'after' WHEN DATE '1996-06-15' = e THEN 'boundary_unresolved' ELSE 'within' END AS relation FROM v
""")
def x24_temporal_relation(spark, d):
    """How each order's time lies to a day."""
    day = F.col("o_orderdate").cast("date")
    end = F.when(F.col("o_orderkey") % 10 != 0, F.date_add(day, 30))
    relation = knowledge.temporal_relation(day, end, F.lit("1996-06-15").cast("date"), F.lit(None).cast("boolean"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), relation.alias("relation"))


_PEOPLE = r"""r AS (SELECT segment_id AS k, CASE WHEN contains(from_addr, '<') THEN lower(trim(string_split(from_addr, '<')[1])) END AS name, lower(trim(CASE WHEN contains(from_addr, '<') THEN regexp_extract(from_addr, '<([^>]*)>', 1) ELSE from_addr END)) AS email FROM mail_headers WHERE from_addr IS NOT NULL AND segment_id IS NOT NULL
UNION ALL SELECT segment_id || ':to', CASE WHEN contains(from_addr, '<') THEN lower(trim(string_split(from_addr, '<')[1])) END, 'office@' || split_part(lower(trim(regexp_extract(from_addr, '<([^>]*)>', 1))), '@', 2) FROM mail_headers WHERE contains(from_addr, '<') AND subject LIKE '%CASE-%'),
g AS (SELECT name, email, min(k) AS k FROM r GROUP BY ALL)"""


@query(rf"""WITH {_PEOPLE} SELECT least(a.k, b.k) AS "left", greatest(a.k, b.k) AS "right", CASE WHEN coalesce(a.name <> b.name, false) OR a.email <> b.email THEN 'conflicting_attributes' WHEN a.email = b.email AND coalesce(a.name = b.name, false) THEN 'same_identified_record' ELSE 'possible_identity' END AS status
FROM g a JOIN g b ON a.k < b.k AND (a.name = b.name OR a.email = b.email)""")
def j13_identity_pairs(spark, d):
    """Records of senders, with and without a name, and of the offices that names in some mails stand for, which share a name or an address."""
    h = table(spark, d, "mail_headers").filter("from_addr IS NOT NULL AND segment_id IS NOT NULL")
    name, email = F.lower(X.display_name(F.col("from_addr"))), F.lower(X.mail_address(F.col("from_addr")))
    office = h.filter(F.contains("from_addr", F.lit("<")) & F.contains("subject", F.lit("CASE-"))).select(F.concat(F.col("segment_id"), F.lit(":to")).alias("k"), name.alias("name"), F.concat(F.lit("office@"), F.element_at(F.split(email, "@"), 2)).alias("email"))
    records = h.select(F.col("segment_id").alias("k"), name.alias("name"), email.alias("email")).unionByName(office)
    return knowledge.identity_pairs(records, "k", "name", ["email"])


@query(r"SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]+', '_', 'g') AS topic, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS size FROM part")
def k2_topics(spark, d):
    """Topic keys and classes of parts."""
    size = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "medium").otherwise("large")
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[^a-z]+", "_").alias("topic"), size.alias("size"))


@query(r"""
WITH q AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:REF|INV|LOT|DN|AX|CASE)-\d{3,6}\b')) AS identifier FROM documents), u AS (SELECT DISTINCT doc_id, identifier FROM q)
SELECT identifier, count(*) AS documents, min(doc_id) AS first FROM u GROUP BY 1
""")
def g1_identifiers(spark, d):
    """Identifiers by grammar, with the documents that have them."""
    ids = F.regexp_extract_all("text", F.lit(r"\b(?:REF|INV|LOT|DN|AX|CASE)-\d{3,6}\b"), F.lit(0))
    u = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(ids)).alias("identifier"))
    return u.groupBy("identifier").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))
