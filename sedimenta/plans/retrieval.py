"""Queries on multi-route retrieval, folds and the remaining joins and functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.functions.text import words
from sedimenta.operators import folds, graph, lexical, ranking, retrieval
from sedimenta.plans.registry import query
from sedimenta.session import checkpoint, scratch, table

QUESTION = "who returned the survey sketch and the water reading under CASE-10474 or REF-74231"
TERMS = ["reading", "sketch", "survey", "water"]
PROBES = ["water reading", "CASE-10474"]
GRAMMAR = r"\b(?:REF|CASE)-\d+\b"

#: What a concept is called in the languages of the texts.
CONCEPTS = {
    "survey sketch": ("survey sketch", "vermessungsskizze", "croquis du terrain", "croquis del terreno", "schets van het terrein"),
    "water reading": ("water reading", "zählerstand", "relevé d'eau", "lectura del agua", "waterstand"),
    "claim register": ("claim register", "beschwerderegister", "registre des plaintes", "registro de quejas", "klachtenregister"),
    "delivery note": ("delivery note", "lieferschein", "bon de livraison", "albarán", "vrachtbrief"),
}
#: What a claim says of an identifier, by a pattern.
PREDICATES = {"opened": "was open|war offen|était ouvert|estaba abierta|was open", "filed": "filed under|abgelegt|classé|archivad|opgeborgen", "compared": "have checked|verglichen|comparé|comparado|vergeleken"}
_NOT = r"\b(not|nobody|never|nicht|niemand|nie|kein|pas|jamais|personne|no|nadie|nunca|niet|nooit)\b"


def _segments(spark, d):
    s = table(spark, d, "segments").filter("id IS NOT NULL AND text IS NOT NULL AND document_version_id IS NOT NULL")
    return s.select("id", F.col("document_version_id").alias("document"), F.col("ordinal").cast("bigint").alias("ordinal"), "text").distinct()


def _links(spark, d):
    links = table(spark, d, "explicit_links").filter("status = 'resolved' AND relation_type IN ('EMAIL_REPLY_REFERENCE', 'ATTACHMENT_OF', 'EXPLICIT_DOCUMENT_REFERENCE')")
    return graph.adjacency(links.select(F.trim("from_node").alias("a"), F.trim("to_node").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "a", "b")


_SEG = "g AS (SELECT DISTINCT id, document_version_id AS document, CAST(ordinal AS BIGINT) AS ordinal, text FROM segments WHERE id IS NOT NULL AND text IS NOT NULL AND document_version_id IS NOT NULL)"
_LNK = """k0 AS (SELECT DISTINCT trim(from_node) AS a, trim(to_node) AS b FROM explicit_links WHERE status = 'resolved' AND relation_type IN ('EMAIL_REPLY_REFERENCE', 'ATTACHMENT_OF', 'EXPLICIT_DOCUMENT_REFERENCE') AND from_node IS NOT NULL AND to_node IS NOT NULL),
k AS (SELECT a AS node, b AS other FROM k0 UNION ALL SELECT b, a FROM k0 WHERE a <> b)"""
_VAL = lambda rows: ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
_CLAIMS = rf"""i AS (SELECT id, text, unnest(list_distinct(regexp_extract_all(text, '\b(?:REF|INV|LOT|DN|AX|CASE)-\d+\b'))) AS entity FROM g),
c AS (SELECT DISTINCT id, entity, predicate, CASE WHEN regexp_matches(lower(text), '{_NOT}') THEN 'negative' ELSE 'positive' END AS polarity FROM i JOIN (VALUES {_VAL(PREDICATES.items())}) p(predicate, pattern) ON regexp_matches(lower(text), pattern))"""
_ROUTES = (
    rf"""{_SEG}, {_LNK}, {_CLAIMS}, w AS (SELECT id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM g), t AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM w),
h AS (SELECT id, dl, term, count(*) AS tf FROM t WHERE term IN ('reading', 'sketch', 'survey', 'water') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM h GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
s AS (SELECT id, term, round(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9) AS score FROM h JOIN df USING (term), st),
rr AS (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY term ORDER BY score DESC, id)) AS rr FROM s), lx AS (SELECT id, round(sum(rr), 9) AS s FROM rr GROUP BY 1),
r1 AS (SELECT id, 'lexical' AS route, row_number() OVER (ORDER BY s DESC, id) AS pos FROM lx QUALIFY pos <= 100),
cs AS (SELECT concept, surface FROM (VALUES {_VAL((c, x) for c in ("survey sketch", "water reading") for x in CONCEPTS[c])}) x(concept, surface)),
cn AS (SELECT id, count(DISTINCT concept) AS n FROM g JOIN cs ON contains(lower(text), surface) GROUP BY 1), rc AS (SELECT id, 'concept' AS route, row_number() OVER (ORDER BY n DESC, id) AS pos FROM cn QUALIFY pos <= 100),
r2 AS (SELECT id, 'literal' AS route, row_number() OVER (ORDER BY id) AS pos FROM g WHERE contains(text, 'water reading') OR contains(text, 'CASE-10474') QUALIFY pos <= 100),
r3 AS (SELECT id, 'identifier' AS route, row_number() OVER (ORDER BY id) AS pos FROM g WHERE regexp_matches(text, '\b(?:CASE-10474|REF-74231)\b') QUALIFY pos <= 100),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
dn AS (SELECT id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM g JOIN embeddings ON vec_id = CAST('0x' || substr(id, 2, 6) AS BIGINT) % (SELECT count(*) FROM embeddings), q),
rd AS (SELECT id, 'dense' AS route, row_number() OVER (ORDER BY score DESC, id) AS pos FROM dn QUALIFY pos <= 100),
u1 AS (FROM r1 UNION ALL FROM rc UNION ALL FROM r2 UNION ALL FROM r3 UNION ALL FROM rd), f1 AS (SELECT id, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS score FROM u1 GROUP BY 1),
ck AS (SELECT DISTINCT entity, predicate FROM c JOIN (SELECT id FROM f1 ORDER BY score DESC, id LIMIT 32) USING (id)), cr AS (SELECT DISTINCT id FROM c SEMI JOIN ck USING (entity, predicate)),
rm AS (SELECT id, 'claim_context' AS route, row_number() OVER (ORDER BY coalesce(score, 0) DESC, id) AS pos FROM cr LEFT JOIN f1 USING (id) QUALIFY pos <= 100),
u2 AS (FROM u1 UNION ALL FROM rm), f2 AS (SELECT id, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS score FROM u2 GROUP BY 1),
seed AS (SELECT document AS node FROM f2 JOIN g USING (id) GROUP BY 1 ORDER BY max(score) DESC, document LIMIT 12),
d1 AS (SELECT DISTINCT other AS node FROM k WHERE node IN (FROM seed) AND other NOT IN (FROM seed)), d2 AS (SELECT DISTINCT other AS node FROM k WHERE node IN (FROM d1) AND other NOT IN (FROM seed) AND other NOT IN (FROM d1)),
al AS (SELECT node, 0 AS depth FROM seed UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2), b AS (SELECT node, depth FROM al ORDER BY depth, node LIMIT 64),
r4 AS (SELECT id, 'explicit_graph' AS route, row_number() OVER (ORDER BY coalesce(score, 0) DESC, id) AS pos FROM (SELECT DISTINCT id FROM g JOIN b ON b.node = g.document WHERE depth > 0) LEFT JOIN f2 USING (id)),
u3 AS (FROM u2 UNION ALL FROM r4), f3 AS (SELECT id, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS score FROM u3 GROUP BY 1),
top AS (SELECT id, score FROM f3 ORDER BY score DESC, id LIMIT 32), nb AS (SELECT id, lag(id) OVER w2 AS x, lead(id) OVER w2 AS y FROM g WINDOW w2 AS (PARTITION BY document ORDER BY ordinal NULLS FIRST, id)),
ar AS (SELECT unnest([x, y]) AS id, score FROM nb JOIN top USING (id)), am AS (SELECT id, max(score) AS score FROM ar WHERE id IS NOT NULL GROUP BY 1),
r5 AS (SELECT id, 'structural' AS route, row_number() OVER (ORDER BY score DESC, id) AS pos FROM am), u4 AS (FROM u3 UNION ALL FROM r5)"""
)
_INDEXES: dict[tuple[str, str], lexical.Index] = {}


def frozen(spark, d):
    """The index of the segments of a folder, written when it is first asked for and kept as long as the application runs."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = lexical.freeze(_segments(spark, d).select("id", "text"), "id", scratch(spark))
    return _INDEXES[key]


def _claims(spark, d):
    """(id, entity, predicate, polarity): what a segment says of the identifiers in it, in patterns of few words."""
    # Each pattern is tried once a text, before it is taken apart.
    low = F.lower("text")
    entities = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(?:REF|INV|LOT|DN|AX|CASE)-\d+\b"), F.lit(0)))
    of = _segments(spark, d).select("id", "text", entities.alias("entities")).filter("size(entities) > 0")
    said = F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(k)) for k, p in PREDICATES.items())))
    read = of.select("id", "entities", said.alias("said"), F.when(low.rlike(_NOT), "negative").otherwise("positive").alias("polarity"))
    return read.select("id", F.explode("entities").alias("entity"), "said", "polarity").select("id", "entity", F.explode("said").alias("predicate"), "polarity")


def _vectors(spark, d):
    """(id, vector) of segments, and the question's vector. No model for embeddings is at hand, so a segment takes the vector that its id points to."""
    e = table(spark, d, "embeddings")
    n = F.broadcast(e.agg(F.count("*").alias("n")))
    at = _segments(spark, d).select("id", F.conv(F.substring("id", 2, 6), 16, 10).cast("bigint").alias("h")).crossJoin(n).select("id", (F.col("h") % F.col("n")).alias("vec_id"))
    return at.join(e, "vec_id").select("id", F.col("embedding").alias("vector")), e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("vector"))


def _concepts(spark, question):
    """(concept, surface): all wordings of the concepts that a question names in one of them."""
    low = question.lower()
    return spark.createDataFrame([(c, x) for c, names in CONCEPTS.items() if any(n in low for n in names) for x in names], "concept string, surface string")


def _hybrid(spark, d):
    vectors, asked = _vectors(spark, d)
    return retrieval.hybrid(_segments(spark, d), frozen(spark, d), _links(spark, d), _concepts(spark, QUESTION), vectors, asked, _claims(spark, d), QUESTION, TERMS, PROBES, GRAMMAR)


@query(rf"""WITH {_SEG}, w AS (SELECT id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM g), t AS (SELECT id, unnest(w) AS term FROM w) SELECT (SELECT count(*) FROM w) AS n, count(*) AS postings FROM (SELECT DISTINCT id, term FROM t)""")
def t5_frozen_segments(spark, d):
    """The index of all segments, written once: how many segments and postings it has."""
    index = frozen(spark, d)
    return index.statistics.select("n").crossJoin(index.postings.agg(F.count("*").alias("postings")))


@query(f"WITH {_ROUTES} SELECT id, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS score, count(*) AS routes FROM u4 GROUP BY 1")
def t10_hybrid_fusion(spark, d):
    """Segments by eight fused routes, three of which start from what the others found."""
    return retrieval.fused(_hybrid(spark, d).routes)


@query(f"""WITH {_ROUTES}, cnt AS (SELECT count(DISTINCT id) AS n FROM u4) SELECT route, count(*) AS n FROM u4 GROUP BY 1 UNION ALL SELECT 'union', n FROM cnt UNION ALL SELECT 'unreranked', greatest(n - 128, 0) FROM cnt
UNION ALL SELECT 'not discovered', count(*) FROM (SELECT DISTINCT id FROM g) ANTI JOIN u4 USING (id) UNION ALL SELECT 'pending', count(*) FROM al ANTI JOIN b USING (node)
UNION ALL SELECT 'unresolved links', count(DISTINCT id) FROM explicit_links WHERE status <> 'resolved'""")
def t14_route_accounting(spark, d):
    """What each of the eight routes found, what none did, what is beyond reranking, documents left pending and links without an end."""
    found = _hybrid(spark, d)
    unresolved = table(spark, d, "explicit_links").filter("status != 'resolved'").select("id").distinct()
    return retrieval.accounting(found.routes, _segments(spark, d), found.pending, unresolved)


@query(f"""WITH {_ROUTES}, best AS (SELECT id AS anchor, score FROM f1 ORDER BY score DESC, id LIMIT 24), ad AS (SELECT anchor, document FROM best JOIN g ON g.id = anchor),
cx AS (SELECT anchor, y.polarity, min(y.id) AS id FROM best JOIN c x ON x.id = anchor JOIN c y ON x.entity = y.entity AND x.predicate = y.predicate AND y.id <> anchor AND y.polarity <> x.polarity GROUP BY ALL),
fs AS (SELECT document, min_by(id, (coalesce(ordinal, -1), id)) AS id FROM g GROUP BY 1), ep AS (SELECT anchor, min(fs.id) AS id FROM ad JOIN k ON k.node = ad.document JOIN fs ON fs.document = k.other WHERE fs.id <> anchor GROUP BY 1),
ne AS (SELECT nb.id AS anchor, unnest([x, y]) AS id FROM nb WHERE nb.id IN (SELECT anchor FROM best)),
m AS (SELECT anchor, anchor AS id, 0 AS rank FROM best UNION ALL SELECT anchor, id, 1 FROM cx UNION ALL SELECT anchor, id, 2 FROM ep UNION ALL SELECT anchor, id, 3 FROM ne WHERE id IS NOT NULL),
m0 AS (SELECT anchor, id, min(rank) AS rank FROM m GROUP BY ALL), m1 AS (SELECT anchor, id FROM m0 QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY rank, id) <= 4),
mm AS (SELECT anchor, array_to_string(list_sort(list(id)), ' ') AS members FROM m1 GROUP BY 1) SELECT min_by(anchor, (-score, anchor)) AS anchor, members FROM mm JOIN best USING (anchor) GROUP BY members""")
def t12_bundles(spark, d):
    """The best segments, each with claims to the contrary, a linked document's beginning and its neighbours; equal sets once."""
    s = _segments(spark, d)
    vectors, asked = _vectors(spark, d)
    first = [retrieval.lexical_route(frozen(spark, d), TERMS, 100), retrieval.concept_route(s, _concepts(spark, QUESTION), 100), retrieval.literal_route(s, PROBES, 100)]
    first += [retrieval.identifier_route(s, QUESTION, GRAMMAR, 100), retrieval.dense_route(vectors, asked, 100)]
    routes = first[0]
    for r in first[1:]:
        routes = routes.unionByName(r)
    return retrieval.bundles(s, checkpoint(retrieval.fused(routes)), _claims(spark, d), _links(spark, d))


@query(rf"""WITH x(concept, surface) AS (VALUES {_VAL((c, x) for c in CONCEPTS for x in CONCEPTS[c])}), a AS (SELECT DISTINCT m.segment_id, concept FROM mail_headers m JOIN x ON contains(lower(m.subject), surface))
SELECT segment_id, concept, count(*) AS surfaces FROM a JOIN x USING (concept) GROUP BY ALL""")
def k3_subject_concepts(spark, d):
    """The concepts that the subjects of mails name, and how many wordings each would be searched by."""
    lexicon = spark.createDataFrame([(c, list(x)) for c, x in CONCEPTS.items()], "concept string, surfaces array<string>")
    heads = table(spark, d, "mail_headers").select("segment_id", F.lower("subject").alias("low"))
    named = heads.join(F.broadcast(lexicon), F.exists("surfaces", lambda x: F.contains(F.col("low"), x)))
    return named.select("segment_id", "concept", F.size("surfaces").cast("bigint").alias("surfaces")).distinct()


@query(rf"""WITH {_SEG}, {_LNK}, w AS (SELECT DISTINCT document, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM g), h AS (SELECT * FROM w WHERE term IN ('reading', 'sketch', 'survey', 'water')),
rel AS (SELECT document, count(*) / 4.0::DOUBLE AS relevance FROM h GROUP BY 1), lent AS (SELECT other AS document, max(relevance) AS strength FROM k JOIN rel ON rel.document = k.node WHERE relevance >= 0.5 GROUP BY 1),
u AS (SELECT document, relevance AS score, 'own' AS reason FROM rel UNION ALL SELECT document, 0.95 * strength + 0.25 * coalesce(relevance, 0), 'link' FROM lent LEFT JOIN rel USING (document))
SELECT document, round(max(score), 6) AS score, max_by(reason, (score, reason)) AS reason FROM u GROUP BY 1""")
def t16_ranked_expansion(spark, d):
    """Documents by the share of a question's words they have, and by what linked ones lend them."""
    w = _segments(spark, d).select("document", F.explode(words(F.col("text"))).alias("term")).filter(F.col("term").isin(TERMS)).distinct()
    relevance = w.groupBy("document").agg((F.count("*") / 4.0).alias("relevance"))
    return retrieval.expansion(relevance, _links(spark, d))


@query(rf"""WITH {_SEG}, x AS (SELECT id, document, len(list_intersect(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), ['reading', 'sketch', 'survey', 'water'])) AS matched FROM g)
SELECT id, document, matched, row_number() OVER (PARTITION BY document ORDER BY matched DESC, id) AS turn FROM x WHERE matched > 0""")
def t18_candidate_rounds(spark, d):
    """Segments by the words they have, documents in turn."""
    return retrieval.coverage_rank(_segments(spark, d), TERMS, "document", "id")


@query(f"""WITH RECURSIVE {_SEG}, z AS (SELECT document, ordinal, coalesce(max(length(text)), 0) AS size FROM g WHERE ordinal IS NOT NULL GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY ordinal) AS r FROM z),
f AS (SELECT document, ordinal, r, 0 AS batch, 1 AS n, size AS used FROM o WHERE r = 1 UNION ALL SELECT o.document, o.ordinal, o.r, CASE WHEN f.n = 4 OR f.used + o.size > 3000 THEN f.batch + 1 ELSE f.batch END,
CASE WHEN f.n = 4 OR f.used + o.size > 3000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n = 4 OR f.used + o.size > 3000 THEN o.size ELSE f.used + o.size END FROM f JOIN o ON o.document = f.document AND o.r = f.r + 1) SELECT document, ordinal, batch FROM f""")
def w11_batches(spark, d):
    """Segments of each document in batches of at most four and 3,000 characters."""
    s = _segments(spark, d).withColumn("size", F.length("text"))
    return folds.batches(s.filter("ordinal IS NOT NULL").groupBy("document", "ordinal").agg(F.max("size").alias("size")), "document", "ordinal", "size", 4, 3000)


@query(r"""WITH m AS (SELECT DISTINCT id, text FROM segments WHERE text IS NOT NULL AND id IS NOT NULL), l AS (SELECT id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM m),
k AS (SELECT id, n, line, CASE WHEN regexp_matches(line, '^[A-Z][a-z]+: ') THEN regexp_extract(line, '^([A-Z][a-z]+): ', 1) END AS mark FROM l)
SELECT id, CAST(n AS BIGINT) AS line_no, last_value(mark IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS speaker FROM k QUALIFY speaker IS NOT NULL""")
def w16_carried_speaker(spark, d):
    """Lines with the speaker that was named last."""
    from sedimenta.operators.segments import lines

    m = table(spark, d, "segments").filter("id IS NOT NULL AND text IS NOT NULL").select("id", "text").distinct()
    mark = F.when(F.col("line").rlike("^[A-Z][a-z]+: "), F.regexp_extract("line", "^([A-Z][a-z]+): ", 1))
    return folds.carried(lines(m, "id"), "id", "line_no", mark, "speaker").filter("speaker IS NOT NULL").select("id", "line_no", "speaker")


@query("""WITH c AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT c_custkey, c_mktsegment, o_orderkey, greatest(n - 3, 0) AS omitted FROM customer JOIN c ON c_custkey = o_custkey AND r <= 3""")
def j16_capped_candidates(spark, d):
    """The three largest orders of each customer, with how many were left out."""
    by = W.partitionBy("o_custkey")
    c = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.row_number().over(by.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("r"), F.count("*").over(by).alias("n")).filter("r <= 3")
    cu = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return cu.join(c, cu.c_custkey == c.o_custkey).select("c_custkey", "c_mktsegment", "o_orderkey", F.greatest(F.col("n") - 3, F.lit(0)).alias("omitted"))


@query("SELECT c_custkey, coalesce(CAST(o.n AS VARCHAR), 'pending') AS state FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def j2_pending(spark, d):
    """Customers with the number of their orders, or pending."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce(F.col("n").cast("string"), F.lit("pending")).alias("state"))


@query("SELECT count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j4_exists(spark, d):
    """Orders with a returned line."""
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(returned, "o_orderkey", "left_semi").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH s AS (SELECT DISTINCT document_version_id AS k, CAST(char_start AS BIGINT) AS a, CAST(char_end AS BIGINT) AS b FROM segments WHERE document_version_id IS NOT NULL AND char_end > char_start),
p AS (SELECT k, unnest(range(0, n, 500)) AS "at" FROM (SELECT document_version_id AS k, CAST(max(char_end) AS BIGINT) AS n FROM segments WHERE document_version_id IS NOT NULL GROUP BY 1)) SELECT k, "at" FROM p ANTI JOIN s ON p.k = s.k AND p."at" >= s.a AND p."at" < s.b""")
def j24_all_unprotected_points(spark, d):
    """Positions up to the end of each document outside all its segments."""
    s = table(spark, d, "segments").filter("document_version_id IS NOT NULL").select(F.col("document_version_id").alias("k"), F.col("char_start").cast("bigint").alias("a"), F.col("char_end").cast("bigint").alias("b"))
    ends = s.groupBy("k").agg(F.max("b").alias("n")).filter("n > 0")
    points = ends.select("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(500).cast("bigint"))).alias("at"))
    return folds.outside(points, s.filter("b > a").distinct(), "k", "at", "a", "b")


@query("""WITH m AS (SELECT round(value / 10, 0) AS score, count(*) / 1000.0::DOUBLE AS rate FROM events WHERE event_id % 2 = 0 GROUP BY 1), e AS (SELECT event_id, value / 10 AS s FROM events)
SELECT event_id, round(CASE WHEN s >= (SELECT min(score) FROM m) THEN rate END, 6) AS rate FROM e ASOF LEFT JOIN m ON e.s <= m.score""")
def j25_all_calibrated_scores(spark, d):
    """All scores with the rate of the next one fitted to every second event."""
    e = table(spark, d, "events")
    model = e.filter("event_id % 2 = 0").groupBy(F.round(F.col("value") / 10, 0).alias("score")).agg((F.count("*") / 1000.0).alias("rate"))
    return folds.calibrated(e.select("event_id", (F.col("value") / 10).alias("s")), model, "s").select("event_id", F.round("rate", 6).alias("rate"))


@query("SELECT o_orderpriority AS stratum, count(*) AS population, count(*) FILTER (o_orderkey % 10 = 0) AS sample, CAST(ceil(count(*) / nullif(count(*) FILTER (o_orderkey % 10 = 0), 0)) AS BIGINT) AS break_even FROM orders GROUP BY 1")
def a9_strata(spark, d):
    """Population and sample of each stratum, and after how many queries a set-up pays."""
    sample = F.count_if(F.col("o_orderkey") % 10 == 0)
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.count("*").alias("population"), sample.alias("sample"), F.ceil(F.try_divide(F.count("*"), sample)).alias("break_even"))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT vec_id AS query_key, label AS wanted, v AS q FROM e WHERE vec_id % 100 = 0),
s AS (SELECT query_key, wanted, vec_id, label, round(list_cosine_similarity(v, q), 6) AS cosine, round(list_dot_product(v, q), 6) AS dot FROM e, q WHERE vec_id <> query_key), u AS (SELECT *, 'cosine' AS arm, cosine AS score FROM s UNION ALL SELECT *, 'dot', dot FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY arm, query_key ORDER BY score DESC, vec_id) AS r FROM u), p AS (SELECT arm, query_key, count(*) FILTER (label = wanted) AS relevant, count(*) FILTER (label = wanted AND r <= 6) AS r6, count(*) FILTER (label = wanted AND r <= 12) AS r12 FROM r GROUP BY ALL)
SELECT arm, count(*) AS queries, round(avg(r6 / least(relevant, 6)), 6) AS recall6, round(avg(r12 / least(relevant, 12)), 6) AS recall12 FROM p WHERE relevant > 0 GROUP BY 1""")
def a12_recall_at(spark, d):
    """Recall at six and twelve of two arms, over all queries (each hundredth vector); relevant is what has the query's label, failures count as nothing found."""
    v = table(spark, d, "embeddings")
    labels = v.select("vec_id", "label")
    relevant = labels.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_key"), F.col("label").alias("wanted"))
    per = labels.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    arms = []
    for arm, found in (("cosine", ranking.cosine_neighbours(v, v.filter("vec_id % 100 = 0"), "vec_id", "embedding", 12)), ("dot", ranking.dot_neighbours(v, v.filter("vec_id % 100 = 0"), "vec_id", "embedding", 12))):
        arms.append(found.select(F.lit(arm).alias("arm"), "query_key", "vec_id", "rank"))
    hits = arms[0].unionByName(arms[1]).join(labels, "vec_id").join(relevant, "query_key").filter("label = wanted").groupBy("arm", "query_key").agg(F.count_if(F.col("rank") <= 6).alias("r6"), F.count("*").alias("r12"))
    cases = relevant.join(per, relevant.wanted == per.label).filter("relevant > 0").select("query_key", "relevant", F.explode(F.array(F.lit("cosine"), F.lit("dot"))).alias("arm"))
    share = lambda c, k: F.round(F.avg(F.coalesce(c, F.lit(0)) / F.least("relevant", F.lit(k))), 6)
    return cases.join(hits, ["arm", "query_key"], "left").groupBy("arm").agg(F.count("*").alias("queries"), share(F.col("r6"), 6).alias("recall6"), share(F.col("r12"), 12).alias("recall12"))


@query("""WITH s AS (SELECT DISTINCT id, status, modality, text, document_version_id FROM segments) SELECT count(*) AS segments, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (modality = 'ocr') AS ocr, count(*) FILTER (modality = 'asr') AS asr,
count(*) FILTER (text IS NULL) AS without_text, count(DISTINCT document_version_id) AS documents, (SELECT count(DISTINCT id) FROM explicit_links WHERE status = 'ambiguous') AS ambiguous, (SELECT count(DISTINCT segment_id) FROM mail_headers) AS mails FROM s""")
def a8_review_status(spark, d):
    """Many counts in one pass."""
    s = table(spark, d, "segments").select("id", "status", "modality", "text", "document_version_id").distinct()
    one = s.agg(
        F.count("*").alias("segments"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("modality") == "ocr").alias("ocr"), F.count_if(F.col("modality") == "asr").alias("asr"),
        F.count_if(F.col("text").isNull()).alias("without_text"), F.countDistinct("document_version_id").alias("documents"),
    )
    links = table(spark, d, "explicit_links").filter("status = 'ambiguous'").agg(F.countDistinct("id").alias("ambiguous"))
    return one.crossJoin(links).crossJoin(table(spark, d, "mail_headers").agg(F.countDistinct("segment_id").alias("mails")))


@query("""WITH p AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS l, count(DISTINCT l_returnflag) AS flags, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_slice(l, 1, 3), ',') AS preview, greatest(len(l) - 3, 0) AS remaining, flags, round(q, 2) AS quantity FROM p WHERE len(l) >= 2""")
def a26_group_previews(spark, d):
    """The first lines of each order, and how many more there are."""
    p = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("l"), F.countDistinct("l_returnflag").alias("flags"), F.sum("l_quantity").alias("q")).filter("size(l) >= 2")
    return p.select("l_orderkey", F.array_join(F.slice("l", 1, 3).cast("array<string>"), ",").alias("preview"), F.greatest(F.size("l") - 3, F.lit(0)).cast("bigint").alias("remaining"), "flags", F.round("q", 2).alias("quantity"))


@query("SELECT doc_id, sha256(concat_ws('|', coalesce(lang, ''), coalesce(source, ''), coalesce(mime_type, ''))) AS identity, regexp_replace(source_path, '^([^/]+)/.*/([^/]+)$', '\\1:\\2') AS family, strftime(observed_at, '%Y-%m') AS month, strftime(last_day(observed_at), '%Y-%m-%d') AS month_end, CAST(date_diff('day', CAST(observed_at AS DATE), CAST(ingested_at AS DATE)) AS BIGINT) AS late_days FROM documents WHERE observed_at IS NOT NULL AND ingested_at IS NOT NULL AND source_path IS NOT NULL")
def x_document_keys(spark, d):
    """Identity hashes, path families, months and lateness of documents."""
    docs = table(spark, d, "documents").filter("observed_at IS NOT NULL AND ingested_at IS NOT NULL AND source_path IS NOT NULL")
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return docs.select(
        "doc_id", F.sha2(F.concat_ws("|", part("lang"), part("source"), part("mime_type")), 256).alias("identity"), F.regexp_replace("source_path", "^([^/]+)/.*/([^/]+)$", "$1:$2").alias("family"),
        F.date_format("observed_at", "yyyy-MM").alias("month"), F.date_format(F.last_day(F.col("observed_at").cast("date")), "yyyy-MM-dd").alias("month_end"), F.datediff(F.col("ingested_at").cast("date"), F.col("observed_at").cast("date")).cast("bigint").alias("late_days"),
    )


@query(r"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, len(regexp_extract_all(text, '"[^"]+"')) AS quoted, len(regexp_extract_all(text, '[\w.]+@[\w.]+')) AS addresses, len(regexp_extract_all(text, '\d+')) AS numbers, md5(text) AS digest FROM d)
SELECT doc_id, CAST(quoted AS BIGINT) AS quoted, CAST(addresses AS BIGINT) AS addresses, CAST(numbers AS BIGINT) AS numbers, digest FROM q""")
def x12_literal_probes(spark, d):
    """How many quoted strings, addresses and numbers each text has."""
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("bigint")
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", count('"[^"]+"').alias("quoted"), count(r"[\w.]+@[\w.]+").alias("addresses"), count(r"\d+").alias("numbers"), F.md5("text").alias("digest"))


@query(r"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\b\d{1,3}(?:[.,]\d{3})+\b|\b\d+[.,]\d{1,2}\b')) AS s FROM documents), p AS (SELECT CAST(floor(o_totalprice) AS BIGINT) AS w, lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS c FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 1000000),
f AS (SELECT CAST(w // 1000 AS VARCHAR) AS h, lpad(CAST(w % 1000 AS VARCHAR), 3, '0') AS t, c FROM p), a AS (SELECT s FROM n UNION SELECT h || ',' || t || '.' || c FROM f UNION SELECT h || '.' || t || ',' || c FROM f),
r AS (SELECT s, regexp_matches(s, '^\d{1,3}([.,]\d{3})+$') AS grouped, len(regexp_extract_all(s, '[.,]')) = 1 AS single, contains(s, '.') AND contains(s, ',') AS mixed, greatest(length(s) - strpos(reverse(s), '.'), length(s) - strpos(reverse(s), ',')) AS cut FROM a)
SELECT s AS surface, CASE WHEN mixed THEN regexp_replace(left(s, cut), '[.,]', '', 'g') || '.' || substr(s, cut + 2) WHEN single AND grouped AND regexp_matches(s, '^\d+[.,]\d{1,3}$') THEN array_to_string(list_sort([replace(s, ',', '.'), regexp_replace(s, '[.,]', '', 'g')]), ' ')
WHEN single THEN replace(s, ',', '.') ELSE regexp_replace(s, '[.,]', '', 'g') END AS readings FROM r""")
def x26_number_readings(spark, d):
    """All amounts each written number can mean: those in the texts, and amounts of orders in both ways of writing them."""
    from sedimenta.operators.knowledge import number_readings

    p = r"\b\d{1,3}(?:[.,]\d{3})+\b|\b\d+[.,]\d{1,2}\b"
    n = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("surface"))
    w = F.floor("o_totalprice").cast("bigint")
    parts = [F.floor(w / 1000).cast("bigint").cast("string"), F.lpad((w % 1000).cast("string"), 3, "0"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")]
    both = F.array(F.concat(parts[0], F.lit(","), parts[1], F.lit("."), parts[2]), F.concat(parts[0], F.lit("."), parts[1], F.lit(","), parts[2]))
    prices = table(spark, d, "orders").filter("o_totalprice >= 1000 AND o_totalprice < 1000000").select(F.explode(both).alias("surface"))
    return n.unionByName(prices).distinct().select("surface", F.array_join(number_readings(F.col("surface")), " ").alias("readings"))


@query(f"""WITH {_LNK} SELECT a.node AS document, a.other AS linked, b.n AS degree FROM k a JOIN (SELECT node, count(*) AS n FROM k GROUP BY 1) b ON a.other = b.node WHERE b.n BETWEEN 2 AND 5""")
def g14_linked_context(spark, d):
    """Links to documents with few links of their own."""
    k = _links(spark, d)
    degree = k.groupBy(F.col("node").alias("linked")).agg(F.count("*").alias("degree")).filter("degree BETWEEN 2 AND 5")
    return k.select(F.col("node").alias("document"), F.col("other").alias("linked")).join(degree, "linked").select("document", "linked", "degree")


@query("""WITH c AS (SELECT n_regionkey AS r, s_suppkey AS k, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey), u AS (SELECT name, count(DISTINCT k) AS n, min(k) AS k FROM c GROUP BY 1)
SELECT c.k AS caller, u.k AS callee FROM c JOIN u ON c.name = u.name WHERE u.n = 1""")
def g17_unique_names(spark, d):
    """Names that resolve to one row alone."""
    c = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    resolved = graph.resolve(c, c.select(F.col("k").alias("t"), F.col("name").alias("n")), "name", "n", "t")
    return resolved.filter("status = 'resolved'").select(F.col("k").alias("caller"), F.col("target").alias("callee"))


@query("""WITH i AS (SELECT o_orderpriority AS issue FROM orders GROUP BY 1), s AS (SELECT c_mktsegment AS seg FROM customer GROUP BY 1), n AS (SELECT count(*) AS n FROM customer) SELECT issue, seg, sha256(issue || '|' || seg) AS task, n * (n - 1) // 2 AS pairs FROM i, s, n""")
def q3_reconsideration(spark, d):
    """Each open issue against each segment, and how many pairs a full comparison would plan."""
    i, s = table(spark, d, "orders").select(F.col("o_orderpriority").alias("issue")).distinct(), table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg")).distinct()
    n = table(spark, d, "customer").agg(F.count("*").alias("n"))
    return i.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(n)).select("issue", "seg", F.sha2(F.concat("issue", F.lit("|"), "seg"), 256).alias("task"), F.expr("n * (n - 1) div 2").alias("pairs"))


@query("""WITH a AS (SELECT event_type, user_id, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL), b AS (SELECT event_type, user_id, count(*) AS n, round(sum(value), 4) AS v FROM events WHERE event_id < (SELECT max(event_id) - max(event_id) // 50 FROM events) GROUP BY ALL)
SELECT event_type, user_id, a.n AS replayed, b.n AS stored, CASE WHEN b.n IS NULL THEN 'missing' ELSE 'different' END AS finding FROM a LEFT JOIN b USING (event_type, user_id) WHERE b.n IS NULL OR b.n <> a.n OR b.v <> a.v""")
def q5_integrity_replay(spark, d):
    """A stored derivation, made before the last fiftieth of the events came in, held against a replay of all."""
    e = table(spark, d, "events")
    totals = lambda rows, n, v: rows.groupBy("event_type", "user_id").agg(F.count("*").alias(n), F.round(F.sum("value"), 4).alias(v))
    last = F.broadcast(e.agg((F.max("event_id") - F.floor(F.max("event_id") / 50)).alias("upto")))
    stored = totals(e.crossJoin(last).filter("event_id < upto"), "stored", "b")
    both = totals(e, "replayed", "a").join(stored, ["event_type", "user_id"], "left")
    finding = F.when(F.col("stored").isNull(), "missing").when((F.col("stored") != F.col("replayed")) | (F.col("a") != F.col("b")), "different")
    return both.withColumn("finding", finding).filter("finding IS NOT NULL").select("event_type", "user_id", "replayed", "stored", "finding")


@query("""WITH RECURSIVE p AS (SELECT DISTINCT id AS c, previous_version_id AS p FROM document_versions WHERE previous_version_id IS NOT NULL UNION SELECT DISTINCT id, parent_document_version_id FROM document_versions WHERE parent_document_version_id IS NOT NULL),
e AS (SELECT DISTINCT p AS node FROM p WHERE p LIKE 'D0%' OR p LIKE 'D1%' UNION SELECT p.c FROM e JOIN p ON p.p = e.node) SELECT node, count(DISTINCT s.id) AS segments FROM e LEFT JOIN segments s ON s.document_version_id = node GROUP BY 1""")
def q10_erasure_preview(spark, d):
    """What an erasure of chosen versions would take along, with its segments."""
    v = table(spark, d, "document_versions")
    parents = v.select(F.col("id").alias("c"), F.col("previous_version_id").alias("p")).unionByName(v.select(F.col("id").alias("c"), F.col("parent_document_version_id").alias("p"))).filter("p IS NOT NULL")
    seeds = parents.filter("p LIKE 'D0%' OR p LIKE 'D1%'").select(F.col("p").alias("node"))
    taken = graph.closure(parents, seeds, "c", "p")
    s = table(spark, d, "segments").select(F.col("document_version_id").alias("node"), "id")
    return taken.join(s, "node", "left").groupBy("node").agg(F.countDistinct("id").alias("segments"))


@query("SELECT status, modality, CASE WHEN modality = 'asr' AND status <> 'ready' THEN 'withheld' WHEN modality IN ('ocr', 'asr') THEN 'flagged' ELSE 'open' END AS decision, count(*) AS n FROM (SELECT DISTINCT id, status, modality FROM segments) GROUP BY ALL")
def m8_withholding(spark, d):
    """What is withheld or flagged for how it was read."""
    s = table(spark, d, "segments").select("id", "status", "modality").distinct()
    decision = F.when((F.col("modality") == "asr") & (F.col("status") != "ready"), "withheld").when(F.col("modality").isin("ocr", "asr"), "flagged").otherwise("open")
    return s.groupBy("status", "modality", decision.alias("decision")).agg(F.count("*").alias("n"))


