"""Queries on links between documents, snapshots, related documents, the claim graph and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions import text as X
from sedimenta.operators import graph, links
from sedimenta.plans import retrieval
from sedimenta.plans.registry import query
from sedimenta.session import table

_VERSIONS = "v AS (SELECT id, min(parent_document_version_id) AS parent, min(previous_version_id) AS previous, min(original_blob_sha) AS blob, min(source_path) AS path, min(ingested_at) AS ingested_at FROM document_versions WHERE id IS NOT NULL GROUP BY 1)"
_HEADS = "h AS (SELECT DISTINCT document_version_id AS document, message_id, in_reply_to FROM mail_headers WHERE document_version_id IS NOT NULL)"
_PATH = r"\b[a-z]+/[0-9]{4}/[0-9a-f]+\.[a-z]+\b"


def _versions(spark, d):
    v = table(spark, d, "document_versions").filter("id IS NOT NULL").groupBy("id")
    names = (("parent", "parent_document_version_id"), ("previous", "previous_version_id"), ("blob", "original_blob_sha"), ("path", "source_path"), ("ingested_at", "ingested_at"))
    return v.agg(*(F.min(c).alias(n) for n, c in names))


def _heads(spark, d):
    return table(spark, d, "mail_headers").filter("document_version_id IS NOT NULL").select(F.col("document_version_id").alias("document"), "message_id", "in_reply_to").distinct()


@query(rf"""WITH {_VERSIONS}, {_HEADS}, m AS (SELECT message_id AS reference, count(DISTINCT document) AS n, min(document) AS t FROM h WHERE message_id IS NOT NULL GROUP BY 1), p AS (SELECT path AS reference, count(*) AS n, min(id) AS t FROM v WHERE path IS NOT NULL GROUP BY 1),
x AS (SELECT DISTINCT document_version_id AS document, unnest(regexp_extract_all(text, '{_PATH}')) AS path FROM segments WHERE document_version_id IS NOT NULL),
l AS (SELECT 'ATTACHMENT_OF' AS relation_type, v.id AS from_node, v.parent AS reference, CASE WHEN o.id IS NULL THEN 0 ELSE 1 END AS n, o.id AS t FROM v LEFT JOIN v o ON o.id = v.parent WHERE v.parent IS NOT NULL
UNION ALL SELECT 'OBSERVED_VERSION_AFTER', v.id, v.previous, 1, o.id FROM v JOIN v o ON o.id = v.previous WHERE v.blob <> o.blob
UNION ALL SELECT 'EMAIL_REPLY_REFERENCE', r.document, r.in_reply_to, coalesce(n, 0), t FROM (SELECT DISTINCT document, in_reply_to FROM h WHERE in_reply_to IS NOT NULL) r LEFT JOIN m ON m.reference = r.in_reply_to
UNION ALL SELECT 'EXPLICIT_DOCUMENT_REFERENCE', x.document, x.path, coalesce(n, 0), t FROM x LEFT JOIN p ON p.reference = x.path)
SELECT relation_type, from_node, reference, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN n = 1 THEN t END AS target FROM l""")
def g3_document_links(spark, d):
    """Attachments, later versions, replies and references, resolved where exactly one document fits."""
    found = table(spark, d, "segments").filter("document_version_id IS NOT NULL").select(F.col("document_version_id").alias("document"), F.explode(F.regexp_extract_all("text", F.lit(_PATH), F.lit(0))).alias("path")).distinct()
    return links.document_links(_versions(spark, d), _heads(spark, d), found)


@query(f"""WITH {_VERSIONS}, t AS (SELECT CAST(min(ingested_at) AS TIMESTAMP) + INTERVAL 60 DAY AS t FROM v), s AS (SELECT v.* FROM v, t WHERE ingested_at <= t.t)
SELECT id, id NOT IN (SELECT previous FROM s WHERE previous IS NOT NULL) AS current FROM s""")
def f1_snapshot_scope(spark, d):
    """The versions that a snapshot holds, sixty days after the first one, and which of them are current."""
    v = _versions(spark, d)
    at = F.broadcast(v.agg((F.min("ingested_at") + F.expr("INTERVAL 60 DAYS")).alias("_at")))
    return links.snapshot_members(v.crossJoin(at), F.col("_at")).select("id", "current")


@query(f"WITH {retrieval._SEG}, {retrieval._CLAIMS} SELECT id, entity, polarity FROM c WHERE entity LIKE 'REF-%' AND predicate = 'opened' AND polarity = 'negative'")
def f2_knowledge_filter(spark, d):
    """Claims by a prefix of their entity, their predicate and polarity."""
    return retrieval._claims(spark, d).filter("entity LIKE 'REF-%' AND predicate = 'opened' AND polarity = 'negative'").select("id", "entity", "polarity")


@query(f"WITH {retrieval._SEG}, {retrieval._CLAIMS} SELECT DISTINCT c.id, predicate FROM c JOIN g USING (id) WHERE contains(lower(text), 'delivery note') OR contains(lower(text), 'lieferschein')")
def f3_text_filter(spark, d):
    """Claims of segments with a wording, in any case."""
    s = retrieval._segments(spark, d).filter(F.contains(F.lower("text"), F.lit("delivery note")) | F.contains(F.lower("text"), F.lit("lieferschein")))
    return retrieval._claims(spark, d).join(s.select("id"), "id", "left_semi").select("id", "predicate").distinct()


@query("SELECT DISTINCT id, document_version_id, ordinal, char_start, char_end, modality, status FROM segments WHERE status <> 'failed'")
def f9_segment_view(spark, d):
    """The documented columns of usable segments; nothing else is read."""
    return table(spark, d, "segments").filter("status != 'failed'").select("id", "document_version_id", "ordinal", "char_start", "char_end", "modality", "status").distinct()


_OCC = rf"""o AS (SELECT DISTINCT document_version_id AS item, 'identifier' AS kind, unnest(regexp_extract_all(text, '\b(?:REF|INV|LOT|DN|AX|CASE)-\d+\b')) AS feature FROM segments WHERE document_version_id IS NOT NULL
UNION SELECT id, 'original_blob', blob FROM v WHERE blob IS NOT NULL UNION SELECT document, 'message_id', message_id FROM h WHERE message_id IS NOT NULL UNION SELECT document, 'message_id', in_reply_to FROM h WHERE in_reply_to IS NOT NULL
UNION SELECT document_version_id, 'paragraph', sha256(p) FROM (SELECT document_version_id, unnest(string_split(text, chr(10) || chr(10))) AS p FROM segments WHERE document_version_id IS NOT NULL) WHERE length(p) >= 40
UNION SELECT document_version_id, 'correspondent', lower(from_addr) FROM mail_headers WHERE document_version_id IS NOT NULL AND from_addr IS NOT NULL)"""


def _occurrences(spark, d):
    """(item, kind, feature): what documents have that others may have too."""
    s = table(spark, d, "segments").filter("document_version_id IS NOT NULL").select(F.col("document_version_id").alias("item"), "text")
    named = lambda rows, kind, feature: rows.select("item", F.lit(kind).alias("kind"), feature.alias("feature"))
    ids = named(s, "identifier", F.explode(F.regexp_extract_all("text", F.lit(r"\b(?:REF|INV|LOT|DN|AX|CASE)-\d+\b"), F.lit(0))))
    paragraphs = named(s.select("item", F.explode(F.split("text", "\n\n", -1)).alias("p")).filter("length(p) >= 40"), "paragraph", F.sha2("p", 256))
    blobs = named(_versions(spark, d).withColumnRenamed("id", "item"), "original_blob", F.col("blob"))
    heads = table(spark, d, "mail_headers").filter("document_version_id IS NOT NULL").withColumnRenamed("document_version_id", "item")
    mails = [named(heads, "message_id", F.col(c)) for c in ("message_id", "in_reply_to")] + [named(heads, "correspondent", F.lower("from_addr"))]
    out = ids.unionByName(paragraphs).unionByName(blobs)
    for m in mails:
        out = out.unionByName(m)
    return out.filter("feature IS NOT NULL")


@query(f"""WITH {_VERSIONS}, {_HEADS}, {_OCC}, {retrieval._LNK}, q AS (SELECT node AS item FROM k GROUP BY 1 ORDER BY count(*) DESC, node LIMIT 1), n AS (SELECT count(DISTINCT item) AS n FROM o), f AS (SELECT kind, feature FROM o SEMI JOIN q USING (item)),
df AS (SELECT kind, feature, count(*) AS df FROM o SEMI JOIN f USING (kind, feature) GROUP BY ALL), s AS (SELECT o.item AS other, min(CASE WHEN kind = 'paragraph' THEN 2 WHEN kind = 'correspondent' THEN 3 ELSE 1 END) AS tier, round(sum(ln(1 + n / df)), 6) AS rank, count(*) AS shared
FROM o JOIN df USING (kind, feature), n WHERE o.item NOT IN (FROM q) GROUP BY 1), l AS (SELECT DISTINCT other FROM k WHERE node IN (FROM q) AND other NOT IN (FROM q))
SELECT q.item AS asked, coalesce(s.other, l.other) AS other, CAST(CASE WHEN l.other IS NOT NULL THEN 0 ELSE tier END AS BIGINT) AS tier, coalesce(rank, 0) AS rank, coalesce(shared, 0) AS shared, l.other IS NOT NULL AS linked FROM s FULL JOIN l ON s.other = l.other, q""")
def t17_related_documents(spark, d):
    """All documents related to the one with the most links: linked, or with features in common, by tier and rarity."""
    between = retrieval._links(spark, d)
    asked = between.groupBy(F.col("node").alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(1).select("item")
    return graph.related(_occurrences(spark, d), between, asked)


@query(f"""WITH {_VERSIONS}, {_HEADS}, {_OCC}, {retrieval._LNK}, q AS (SELECT min(node) AS a FROM k), p AS (SELECT a, (SELECT min(other) FROM k WHERE node = (SELECT a FROM q) AND other <> node) AS b FROM q)
SELECT x.kind, x.feature FROM p JOIN o x ON x.item = p.a JOIN o y ON y.item = p.b AND x.kind = y.kind AND x.feature = y.feature UNION ALL SELECT 'link', other FROM k JOIN p ON k.node = p.a AND k.other = p.b GROUP BY other""")
def g5_explained_connection(spark, d):
    """Why two linked documents belong together: what they have in common, and their links."""
    between = retrieval._links(spark, d)
    pair = between.agg(F.min("node").alias("a")).join(between.filter("node != other"), F.col("a") == F.col("node")).groupBy("a").agg(F.min("other").alias("b"))
    o = _occurrences(spark, d).distinct()
    sides = [o.join(F.broadcast(pair.select(F.col(s).alias("item"))), "item").select("kind", "feature") for s in "ab"]
    direct = between.join(F.broadcast(pair), (F.col("node") == F.col("a")) & (F.col("other") == F.col("b"))).select(F.lit("link").alias("kind"), F.col("other").alias("feature")).distinct()
    return sides[0].join(sides[1], ["kind", "feature"]).unionByName(direct)


_GRAPH = f"""{retrieval._SEG}, {retrieval._CLAIMS}, cc AS (SELECT *, sha256(id || '|' || entity || '|' || predicate || '|' || polarity) AS claim FROM c), cg AS (SELECT entity, predicate, sha256(entity || '|' || predicate) AS group_id FROM c GROUP BY ALL HAVING count(DISTINCT polarity) > 1),
e AS (SELECT DISTINCT id AS source, 'PART_OF' AS type, document AS target FROM g UNION SELECT claim, 'STATED_IN', id FROM cc UNION SELECT claim, 'ABOUT', 'entity:' || entity FROM cc UNION SELECT claim, 'MEMBER_OF', group_id FROM cc JOIN cg USING (entity, predicate))"""


def _graph(spark, d):
    return links.claim_graph(retrieval._segments(spark, d), retrieval._claims(spark, d))


@query(f"WITH {_GRAPH} SELECT source, type, target FROM e")
def g8_graph_edges(spark, d):
    """The edges of the claim graph: segments of documents, claims stated in them, what they are about, and groups of claims to the contrary."""
    return _graph(spark, d)[1]


@query(f"""WITH {_GRAPH} SELECT DISTINCT document AS node, 'document' AS kind FROM g UNION SELECT id, 'segment' FROM g UNION SELECT claim, 'claim' FROM cc UNION SELECT 'entity:' || entity, 'entity' FROM cc UNION SELECT group_id, 'group' FROM cg""")
def g8_graph_nodes(spark, d):
    """The nodes of the claim graph."""
    return _graph(spark, d)[0]


@query(f"""WITH {_GRAPH}, q AS (SELECT min(id) AS id FROM cc JOIN cg USING (entity, predicate)), c1 AS (SELECT claim FROM cc WHERE id IN (FROM q)), gr AS (SELECT target FROM e WHERE type = 'MEMBER_OF' AND source IN (FROM c1)),
n AS (SELECT id AS node FROM q UNION SELECT claim FROM c1 UNION SELECT source FROM e WHERE type = 'MEMBER_OF' AND target IN (FROM gr)) SELECT source, type, target FROM e WHERE source IN (FROM n) OR target IN (FROM n)""")
def g13_segment_edges(spark, d):
    """The edges that touch a segment with a claim that others contradict, its claims, or the members of their groups."""
    edges = _graph(spark, d)[1]
    first = links.conflict_groups(retrieval._claims(spark, d)).agg(F.min("id").alias("id"))
    return links.segment_edges(edges, first)


@query("""WITH n AS (SELECT DISTINCT id AS node, 'document' AS kind FROM document_versions WHERE id IS NOT NULL UNION SELECT DISTINCT id, 'passage' FROM passages WHERE id IS NOT NULL), l AS (SELECT DISTINCT id, trim(from_node) AS a, trim(to_node) AS b FROM explicit_links),
e AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM l UNION ALL SELECT b FROM l) WHERE node IS NOT NULL GROUP BY 1) SELECT coalesce(n.node, e.node) AS node, coalesce(kind, 'unresolved') AS kind, coalesce(degree, 0) AS degree FROM n FULL JOIN e ON n.node = e.node""")
def g19_viewer_nodes(spark, d):
    """Documents and passages with the number of their links, and ends of links that exist nowhere."""
    of = lambda t, kind: table(spark, d, t).filter("id IS NOT NULL").select(F.col("id").alias("node"), F.lit(kind).alias("kind")).distinct()
    edges = table(spark, d, "explicit_links").select("id", F.trim("from_node").alias("source"), F.trim("to_node").alias("target")).distinct()
    return links.projected(of("document_versions", "document").unionByName(of("passages", "passage")), edges)


@query(f"WITH {_GRAPH} SELECT claim, id, group_id FROM cc JOIN cg USING (entity, predicate)")
def j17_claim_memberships(spark, d):
    """The group of each claim that others contradict."""
    return links.conflict_groups(retrieval._claims(spark, d)).select("claim", "id", "group_id")


@query(f"""WITH {_GRAPH}, m AS (SELECT DISTINCT id, group_id FROM cc JOIN cg USING (entity, predicate)), q AS (SELECT DISTINCT m.id FROM m JOIN cc ON cc.id = m.id WHERE polarity = 'negative'),
f AS (SELECT DISTINCT q.id AS asked, y.id FROM q JOIN m x ON x.id = q.id JOIN m y ON y.group_id = x.group_id AND y.id <> q.id), r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY id) AS r, count(*) OVER (PARTITION BY asked) AS n FROM f)
SELECT asked, id, greatest(n - 3, 0) AS omitted FROM r WHERE r <= 3""")
def j18_claim_context(spark, d):
    """For each segment with a negative claim up to three segments of its groups, and how many more there are."""
    claims = retrieval._claims(spark, d)
    return links.claim_context(links.conflict_groups(claims), claims.filter("polarity = 'negative'").select("id"), 3)


@query(r"""WITH p AS (SELECT doc_id, text, unnest(range(0, length(text), 1200)) AS lo FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, lo, unnest(regexp_extract_all(substring(text, lo + 1, 1200), '\b(?:REF|INV|LOT|DN|AX|CASE)-\d+\b')) AS entity FROM p)
SELECT doc_id, lo // 1200 AS passage, entity, count(*) AS claims FROM s GROUP BY ALL""")
def j11_claims_of_passages(spark, d):
    """What each passage of 1,200 characters names, and how often."""
    docs = table(spark, d, "documents").filter("length(text) > 0")
    p = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(1200))).alias("lo"))
    named = F.explode(F.regexp_extract_all(F.expr("substring(text, lo + 1, 1200)"), F.lit(r"\b(?:REF|INV|LOT|DN|AX|CASE)-\d+\b"), F.lit(0)))
    return p.select("doc_id", F.floor(F.col("lo") / 1200).alias("passage"), named.alias("entity")).groupBy("doc_id", "passage", "entity").agg(F.count("*").alias("claims"))


@query("""WITH r AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes FROM documents), f AS (SELECT *, sum(bytes) OVER (ORDER BY doc_id) AS s FROM (SELECT * FROM r WHERE doc_id > 100 ORDER BY doc_id LIMIT 50)), k AS (SELECT * FROM f WHERE s <= 20000 OR doc_id = (SELECT min(doc_id) FROM f)),
x AS (SELECT (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r WHERE doc_id > 100) - (SELECT count(*) FROM k) AS remaining, (SELECT max(doc_id) FROM k) AS last)
SELECT doc_id, bytes, total, remaining, CASE WHEN remaining > 0 THEN to_base64(encode(sha256('documents') || ':' || last)) END AS next_cursor FROM k, x""")
def l1_byte_page(spark, d):
    """The page after document 100: at most fifty rows and 20,000 bytes, with what remains and where it goes on."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    return links.page(docs, "doc_id", F.col("n"), "documents", 100, 50, 20_000)


@query("""SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || coalesce(CAST(n_chars AS VARCHAR), 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}' AS canonical,
sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || coalesce(CAST(n_chars AS VARCHAR), 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS digest FROM documents""")
def x2_canonical_json(spark, d):
    """Each document's metadata as canonical JSON, and its hash."""
    docs = table(spark, d, "documents").select("doc_id", X.canonical_json(F.struct("doc_id", "lang", "n_chars", "source")).alias("canonical"))
    return docs.withColumn("digest", F.sha2("canonical", 256))


@query("""WITH u AS (SELECT DISTINCT source_path, 'file:///vault/' || replace(url_encode(source_path), '%2F', '/') AS uri FROM documents WHERE source_path IS NOT NULL UNION SELECT '', 'file:///vault/../etc/passwd' UNION SELECT '', 'https://host.test/vault/a')
SELECT uri, CASE WHEN source_path <> '' THEN source_path END AS path FROM u""")
def x16_relative_paths(spark, d):
    """The paths that file URIs stand for; others, and those that lead out of the folder, stand for none."""
    paths = table(spark, d, "documents").filter("source_path IS NOT NULL").select("source_path").distinct()
    uris = paths.select(F.concat(F.lit("file:///vault/"), F.replace(F.replace(F.url_encode("source_path"), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))).alias("uri"))
    odd = spark.createDataFrame([("file:///vault/../etc/passwd",), ("https://host.test/vault/a",)], "uri string")
    return uris.unionByName(odd).select("uri", X.relative_path(F.col("uri"), "/vault").alias("path"))


@query(r"""WITH m AS (SELECT DISTINCT segment_id, sent_at FROM mail_headers WHERE segment_id IS NOT NULL), s AS (SELECT DISTINCT id, text FROM segments WHERE text IS NOT NULL), d AS (SELECT segment_id, sent_at, TRY_CAST(nullif(regexp_extract(text, '\b\d{4}-\d{2}-\d{2}\b'), '') AS DATE) AS day, contains(text, '?') AS asked FROM m JOIN s ON s.id = m.segment_id)
SELECT segment_id, CASE WHEN asked THEN 'not_required' WHEN day IS NULL OR sent_at IS NULL THEN 'unknown' WHEN day = CAST(sent_at AS DATE) THEN 'same' WHEN day < CAST(sent_at AS DATE) THEN 'before' ELSE 'after' END AS relation FROM d""")
def x25_event_day_relation(spark, d):
    """How the first date in a mail stands to the day it was sent; of mails that ask, none is required."""
    m = table(spark, d, "mail_headers").filter("segment_id IS NOT NULL").select("segment_id", "sent_at").distinct()
    s = table(spark, d, "segments").filter("text IS NOT NULL").select(F.col("id").alias("segment_id"), "text").distinct()
    day = F.expr(r"try_cast(nullif(regexp_extract(text, '\\b\\d{4}-\\d{2}-\\d{2}\\b', 0), '') AS DATE)")
    return m.join(s, "segment_id").select("segment_id", X.day_relation(day, F.col("sent_at").cast("date"), ~F.contains("text", F.lit("?"))).alias("relation"))
