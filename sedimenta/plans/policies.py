"""Queries on ranking policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.operators import policies, ranking
from sedimenta.plans import retrieval
from sedimenta.plans.registry import query

_IDS = r"\b(?:REF|INV|LOT|DN|AX|CASE)-\d+\b"
_BASE = rf"""{retrieval._SEG}, {retrieval._LNK}, wd AS (SELECT id, document, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM g), tk AS (SELECT id, document, len(w) AS dl, unnest(w) AS term FROM wd),
h AS (SELECT id, document, dl, term, count(*) AS tf FROM tk WHERE term IN ('reading', 'sketch', 'survey', 'water') GROUP BY ALL), nn AS (SELECT count(DISTINCT document) AS n FROM g),
wt AS (SELECT x.term, coalesce(df, 0) AS df, n, 1 + ln((n + 1) / (coalesce(df, 0) + 1)) AS w FROM (VALUES ('reading'), ('sketch'), ('survey'), ('water')) x(term) LEFT JOIN (SELECT term, count(DISTINCT document) AS df FROM h GROUP BY 1) d USING (term), nn), tw AS (SELECT sum(w) AS total FROM wt)"""


def _units(spark, d):
    return retrieval._segments(spark, d).select("id", "document")


@query(rf"""WITH {_BASE}, r AS (SELECT id, document, sum(w) / max(total) AS relevance, count(*) AS terms, max(CASE WHEN df <= greatest(1, n / 2) THEN 1 ELSE 0 END) AS rare FROM h JOIN wt USING (term), tw GROUP BY ALL),
s AS (SELECT document, max(relevance) AS strength, max(rare) AS rare FROM r GROUP BY 1 HAVING max(relevance) >= 0.5), lk AS (SELECT other AS document, max(0.95 * strength) AS lent FROM k JOIN s ON s.document = k.node WHERE node <> other GROUP BY 1),
f AS (SELECT DISTINCT document, unnest(regexp_extract_all(text, '{_IDS}')) AS feature FROM g), dg AS (SELECT feature, count(*) AS degree FROM f, nn GROUP BY feature, n HAVING count(*) BETWEEN 2 AND greatest(2, ceil(n * 0.1))),
fs AS (SELECT feature, document AS seed, strength * (0.65 + 0.35 / degree) AS lent FROM f JOIN dg USING (feature) JOIN s USING (document) WHERE rare = 1), fx AS (SELECT f.document, max(lent) AS lent FROM f JOIN fs USING (feature) WHERE f.document <> seed GROUP BY 1),
u AS (SELECT id, relevance AS score, 'own' AS reason, terms FROM r UNION ALL SELECT g.id, lent + 0.25 * coalesce(relevance, 0), 'link', coalesce(terms, 0) FROM g JOIN lk USING (document) LEFT JOIN r ON r.id = g.id
UNION ALL SELECT g.id, lent + 0.25 * coalesce(relevance, 0), 'feature', coalesce(terms, 0) FROM g JOIN fx USING (document) LEFT JOIN r ON r.id = g.id), v AS (SELECT id, round(score, 6) AS score, reason, terms FROM u)
SELECT id, max(score) AS score, max_by(reason, (score, reason)) AS reason, max(terms) AS terms FROM v GROUP BY 1""")
def t16_discovery(spark, d):
    """Segments by the weight of a question's words they have, and by what linked documents and rare shared identifiers lend them."""
    ids = retrieval._segments(spark, d).select("document", F.explode(F.regexp_extract_all("text", F.lit(_IDS), F.lit(0))).alias("feature"))
    return policies.discovery(retrieval.frozen(spark, d), _units(spark, d), retrieval._links(spark, d), ids, retrieval.TERMS)


@query(rf"""WITH {_BASE}, st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM wd), dh AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
b AS (SELECT id, term, round(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9) AS s FROM h JOIN dh USING (term), st),
bt AS (SELECT id, w / (60 + row_number() OVER (PARTITION BY term ORDER BY s DESC, id)) AS score, w / total AS coverage, 0 AS phrase FROM b JOIN wt USING (term), tw),
pp AS (SELECT id, document, wd.w AS w, unnest(range(1, len(wd.w))) AS i FROM wd), ph AS (SELECT id, document, count(*) AS hits FROM pp WHERE w[i] = 'water' AND w[i + 1] = 'reading' GROUP BY ALL), pw AS (SELECT 1 + ln((n + 1) / (count(DISTINCT document) + 1)) AS pw FROM ph, nn GROUP BY n),
bp AS (SELECT id, 3 * pw / (60 + row_number() OVER (ORDER BY hits DESC, id)) AS score, 0.0 AS coverage, 1 AS phrase FROM ph, pw), o AS (SELECT id, sum(score) + sum(coverage) AS score, sum(coverage) AS coverage, max(phrase) AS phrase FROM (FROM bt UNION ALL FROM bp) GROUP BY 1), ow AS (SELECT o.*, document FROM o JOIN g USING (id)),
s AS (SELECT document, max(score) AS best FROM ow GROUP BY 1 HAVING max(CASE WHEN coverage >= 0.5 OR phrase = 1 THEN 1 ELSE 0 END) = 1), e AS (SELECT other AS document, max(0.85 * best) AS lent FROM k JOIN s ON s.document = k.node WHERE node <> other GROUP BY 1),
wh AS (SELECT id, document, max(lent) AS lent FROM g JOIN (SELECT document, 0.0 AS lent FROM s UNION ALL SELECT document, lent FROM e) USING (document) GROUP BY ALL),
c AS (SELECT coalesce(ow.id, wh.id) AS id, coalesce(ow.document, wh.document) AS document, round(greatest(coalesce(score, 0), coalesce(lent, 0)), 6) AS score FROM ow FULL JOIN wh ON ow.id = wh.id)
SELECT id, document, score, document IN (SELECT document FROM s) AS strong, row_number() OVER (PARTITION BY document ORDER BY score DESC, id) - 1 AS turn FROM c""")
def t18_plan_candidates(spark, d):
    """Candidates of a query plan of four words and a phrase, whole strong documents and linked ones with them, units in turn."""
    found = policies.plan_candidates(retrieval.frozen(spark, d), _units(spark, d), retrieval._links(spark, d), retrieval.TERMS, {"water reading": 3})
    return policies.in_turn(found).select("id", "document", "score", "strong", "turn")


_T15 = rf"""{_BASE}, hc AS (SELECT term, count(*) AS hits FROM h GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM wd),
bm AS (SELECT id, round(sum(CASE WHEN ln((n - hits + 0.5) / (hits + 0.5)) > 0 THEN ln((n - hits + 0.5) / (hits + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM h JOIN hc USING (term), st GROUP BY 1),
f0 AS (SELECT id, document, round(sum(1.0::DOUBLE / hits), 9) AS rarity, count(*) AS terms, bm25, 0 AS tier FROM h JOIN hc USING (term) JOIN bm USING (id) GROUP BY id, document, bm25), sf AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '{_IDS}')) AS feature FROM g),
wf AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '\b\d{{4}}-\d{{2}}-\d{{2}}\b')) AS feature FROM g), lk AS (SELECT DISTINCT other AS document FROM k WHERE node IN (SELECT document FROM f0)),
nr AS (SELECT id, 1 AS tier FROM g WHERE document IN (FROM lk) UNION ALL SELECT id, 1 FROM sf WHERE feature IN (SELECT feature FROM sf WHERE id IN (SELECT id FROM f0)) UNION ALL SELECT id, 2 FROM g WHERE contains(lower(text), 'zählerstand') OR contains(lower(text), 'vermessungsskizze')
UNION ALL SELECT id, 3 FROM wf WHERE feature IN (SELECT feature FROM wf WHERE id IN (SELECT id FROM f0))), ot AS (SELECT id, min(tier) AS tier FROM nr GROUP BY 1),
ev AS (SELECT id, document, rarity, terms, bm25, tier FROM f0 UNION ALL SELECT g.id, document, 0, 0, 0, tier FROM g JOIN ot USING (id) WHERE g.id NOT IN (SELECT id FROM f0)), tu AS (SELECT *, row_number() OVER (PARTITION BY tier, document ORDER BY rarity DESC, terms DESC, bm25 DESC, id) AS turn FROM ev),
pl AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY turn, rarity DESC, terms DESC, bm25 DESC, id) - 1 AS k FROM tu), sz AS (SELECT count(*) FILTER (tier = 0) AS n0, count(*) FILTER (tier = 1) AS n1, count(*) FILTER (tier = 2) AS n2 FROM pl),
sl AS (SELECT id, document, tier, CAST(CASE tier WHEN 0 THEN 3 * (k // 2) + k % 2 WHEN 3 THEN 3 * (n0 + n1 + n2) + k WHEN 1 THEN 3 * (k + least(k, n2)) + 2 ELSE 3 * (k + least(k + 1, n1)) + 2 END AS BIGINT) AS slot FROM pl, sz)"""


def _t15(spark, d):
    s = retrieval._segments(spark, d)
    found = lambda p: s.select("id", F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("feature")).distinct()
    attributed = s.filter(F.contains(F.lower("text"), F.lit("zählerstand")) | F.contains(F.lower("text"), F.lit("vermessungsskizze"))).select("id")
    return policies.reference_ranking(retrieval.frozen(spark, d), s.select("id", "document"), retrieval._links(spark, d), found(_IDS), attributed, found(r"\b\d{4}-\d{2}-\d{2}\b"), retrieval.TERMS)


@query(f"WITH {_T15} SELECT id, document, tier, slot FROM sl")
def t15_tiers(spark, d):
    """Segments by tier, with their place: documents in turn, two of the question's words, then one distinctive."""
    return _t15(spark, d)


@query(f"""WITH RECURSIVE {_T15}, o AS (SELECT id, octet_length(encode(text)) AS n, row_number() OVER (ORDER BY slot, id) AS r FROM sl JOIN g USING (id)), f AS (SELECT id, r, CASE WHEN n <= 20000 THEN n ELSE 0 END AS used, CASE WHEN n <= 20000 THEN 1 ELSE 0 END AS taken, n <= 20000 AS took FROM o WHERE r = 1
UNION ALL SELECT o.id, o.r, CASE WHEN f.used + o.n <= 20000 AND f.taken < 20 THEN f.used + o.n ELSE f.used END, CASE WHEN f.used + o.n <= 20000 AND f.taken < 20 THEN f.taken + 1 ELSE f.taken END, f.used + o.n <= 20000 AND f.taken < 20 FROM f JOIN o ON o.r = f.r + 1) SELECT id FROM f WHERE took""")
def t15_selection(spark, d):
    """Of these in order at most twenty that fit into 20,000 bytes, skipping those that are too large."""
    sizes = retrieval._segments(spark, d).select("id", F.octet_length("text").cast("bigint").alias("n"))
    ordered = _t15(spark, d).join(sizes, "id").withColumn("all", F.lit(0))
    return ranking.packed(ordered, "id", "n", 20_000, "slot", "all", 20).select("id")
