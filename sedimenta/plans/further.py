"""Queries on spans of text, provenance, identity records and the rest of the functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.functions import text as X
from sedimenta.operators import evaluation, folds, graph, segments, spans
from sedimenta.plans import analytics
from sedimenta.plans.registry import query
from sedimenta.session import scratch, table
from sedimenta.sources import sinks

GRAMMAR = {"identifier": r"\b(?:REF|INV|LOT|DN|AX|CASE)-\d{3,6}\b", "email": r"[\w.]+@[\w.]+\.\w+", "date": r"\b\d{4}-\d{2}-\d{2}\b"}


def _segments(spark, d):
    return table(spark, d, "segments").filter("id IS NOT NULL AND document_version_id IS NOT NULL").select("id", F.col("document_version_id").alias("document"), F.col("ordinal").cast("bigint").alias("ordinal"), "text").distinct()


_SEG = "g AS (SELECT DISTINCT id, document_version_id AS document, CAST(ordinal AS BIGINT) AS ordinal, text FROM segments WHERE id IS NOT NULL AND document_version_id IS NOT NULL)"


@query(f"WITH {_SEG}, n AS (SELECT id, document, row_number() OVER (PARTITION BY document ORDER BY ordinal NULLS FIRST, id) AS n, coalesce(length(text), 0) AS l FROM g) SELECT id, CAST(coalesce(sum(l + 2) OVER (PARTITION BY document ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM n")
def t2_canonical_offsets(spark, d):
    """Where each segment begins in its document's joined text."""
    n = _segments(spark, d).withColumn("n", F.row_number().over(W.partitionBy("document").orderBy("ordinal", "id"))).withColumn("l", F.coalesce(F.length("text"), F.lit(0)))
    return segments.canonical_offsets(n, "document", "n", F.col("l")).join(n.select("document", "n", "id"), ["document", "n"]).select("id", "begin")


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, w, unnest(range(0, len(w), 80)) AS s FROM w)
SELECT doc_id, s // 80 AS window_no, sha256(array_to_string(w[s + 1 : s + 100], ' ')) AS window_id FROM s""")
def t8_word_windows(spark, d):
    """Windows of 100 words, each 80 after the one before."""
    w = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.words(F.col("text")).alias("w")).filter("size(w) > 0")
    s = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(80))).alias("s"))
    return s.select("doc_id", F.floor(F.col("s") / 80).alias("window_no"), F.sha2(F.array_join(F.slice("w", F.col("s") + 1, F.lit(100)), " "), 256).alias("window_id"))


_CUT = r"""CASE WHEN length(text) - a <= 400 THEN length(text) WHEN regexp_matches(substr(text, a + 201, 200), '\n') THEN a + 200 + length(regexp_extract(substr(text, a + 201, 200), '^(?s:.*)\n'))
WHEN regexp_matches(substr(text, a + 201, 200), '[.!?][\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') THEN a + 200 + length(regexp_extract(substr(text, a + 201, 200), '^(?s:.*)[.!?][\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'))
WHEN contains(substr(text, a + 201, 200), ' ') THEN a + 200 + length(regexp_extract(substr(text, a + 201, 200), '^(?s:.*) ')) ELSE a + 400 END"""


@query(f"WITH RECURSIVE z AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS a FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, text, a, CAST({_CUT} AS BIGINT) AS b FROM z UNION ALL SELECT doc_id, text, a, CAST({_CUT} AS BIGINT) AS b FROM (SELECT doc_id, text, b AS a FROM c WHERE b < length(text))) SELECT doc_id, a AS char_start, b AS char_end FROM c")
def t25_citation_spans(spark, d):
    """Spans of at most 400 characters that end at lines, sentences or spaces."""
    return spans.parts(table(spark, d, "documents"), "doc_id", 400)


@query(
    "WITH t AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS s FROM documents WHERE text IS NOT NULL" for k, p in GRAMMAR.items())
    + """), i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM t), b AS (SELECT doc_id, kind, m[i] AS value, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM i)
SELECT doc_id, kind, value, start, start + length(value) AS "end" FROM b"""
)
def g2_feature_spans(spark, d):
    """Identifiers, addresses and dates with their places."""
    return spans.pattern_spans(table(spark, d, "documents"), "doc_id", GRAMMAR)


@query(rf"""WITH {_SEG}, t AS (SELECT id, text, regexp_extract_all(text, '["“„«][^"”“»]+["”“»]') AS m, string_split_regex(text, '["“„«][^"”“»]+["”“»]') AS s FROM g WHERE text IS NOT NULL), i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM t),
b AS (SELECT id, text, m[i] AS m, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM i)
SELECT id, a + 1 AS start, a + length(m) - 1 AS "end", nullif(regexp_extract(substr(text, greatest(a - 80, 0) + 1, a - greatest(a - 80, 0)), '([A-Z][\w''-]+(?: [A-Z][\w''-]+)?)(?: (?:said|wrote|says|sagte|schrieb))?\s*[:,]\s*$', 1), '') AS speaker FROM b""")
def k5_quotation_scopes(spark, d):
    """What stands in quotation marks, and who said it."""
    return spans.quotations(_segments(spark, d), "id")


@query("SELECT doc_id, replace(replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), 'ﬁ', 'fi'), 'ſ', 's') AS folded FROM documents WHERE text IS NOT NULL")
def x4_folded_texts(spark, d):
    """Texts in NFC, casefolded."""
    return spans.folded_texts(table(spark, d, "documents"), "doc_id")


@query("""WITH b AS (SELECT doc_id, unnest(range(0, length(text), 500)) AS s, text FROM documents WHERE text IS NOT NULL AND length(text) > 0), c AS (SELECT sha256(doc_id || ':' || s || ':' || substring(text, s + 1, 500)) AS choice, doc_id, s FROM b),
a AS (SELECT choice FROM c UNION ALL SELECT sha256('unknown ' || doc_id) FROM documents) SELECT a.choice, coalesce(doc_id, -1) AS doc_id, coalesce(s, -1) AS char_start, doc_id IS NULL AS rejected FROM a LEFT JOIN c ON a.choice = c.choice""")
def t29_all_citation_choices(spark, d):
    """Citations of all parts of each document resolved by their hashes, and an unknown one of each, rejected."""
    docs = table(spark, d, "documents")
    parts = segments.fixed_parts(docs.filter("text != ''"), "doc_id", 500)
    c = parts.select(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("char_start").cast("string"), F.lit(":"), F.col("part")), 256).alias("choice"), "doc_id", "char_start")
    asked = c.select("choice").unionByName(docs.select(F.sha2(F.concat(F.lit("unknown "), F.col("doc_id").cast("string")), 256).alias("choice")))
    found = asked.join(c, "choice", "left")
    return found.select("choice", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.coalesce("char_start", F.lit(-1)).cast("bigint").alias("char_start"), F.col("doc_id").isNull().alias("rejected"))


@query("SELECT trim(from_node) AS node, relation_type, count(DISTINCT trim(to_node)) AS neighbours FROM explicit_links WHERE status = 'resolved' AND relation_type IN ('POSSIBLE_REPRODUCTION', 'ATTACHMENT_OF') AND from_node IS NOT NULL GROUP BY ALL")
def g4_neighbours_by_type(spark, d):
    """How many neighbours of chosen kinds each node has."""
    links = table(spark, d, "explicit_links").filter("status = 'resolved' AND from_node IS NOT NULL").filter(F.col("relation_type").isin("POSSIBLE_REPRODUCTION", "ATTACHMENT_OF"))
    return links.groupBy(F.trim("from_node").alias("node"), "relation_type").agg(F.countDistinct(F.trim("to_node")).alias("neighbours"))


@query("""WITH f AS (SELECT DISTINCT member, lower(trim(feature, chr(32) || chr(9))) AS f FROM postings WHERE member IS NOT NULL AND trim(feature, chr(32) || chr(9)) <> ''),
p AS (SELECT DISTINCT trim(from_node) AS a, trim(to_node) AS b FROM explicit_links WHERE status = 'resolved' AND relation_type = 'POSSIBLE_REPRODUCTION' AND from_node IS NOT NULL AND to_node IS NOT NULL)
SELECT a, b, count(y.f) AS shared FROM p LEFT JOIN f x ON x.member = a LEFT JOIN f y ON y.member = b AND y.f = x.f GROUP BY ALL""")
def g5_explained_links(spark, d):
    """How many features the two ends of each recorded match have in common."""
    f = table(spark, d, "postings").select("member", F.lower(F.btrim("feature", F.lit(" \t"))).alias("f")).filter("member IS NOT NULL AND f != ''").distinct()
    p = table(spark, d, "explicit_links").filter("status = 'resolved' AND relation_type = 'POSSIBLE_REPRODUCTION'").select(F.trim("from_node").alias("a"), F.trim("to_node").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    x, y = f.select(F.col("member").alias("a"), "f"), f.select(F.col("member").alias("b"), "f", F.lit(1).alias("hit"))
    return p.join(x, "a", "left").join(y, ["b", "f"], "left").groupBy("a", "b").agg(F.count("hit").alias("shared"))


@query("""SELECT 'document' AS kind, count(DISTINCT id) AS n FROM document_versions UNION ALL SELECT 'segment', count(DISTINCT id) FROM segments UNION ALL SELECT 'passage', count(DISTINCT id) FROM passages
UNION ALL SELECT 'feature', count(DISTINCT lower(trim(feature, chr(32) || chr(9)))) FROM postings WHERE trim(feature, chr(32) || chr(9)) <> '' UNION ALL SELECT 'link ' || relation_type, count(DISTINCT id) FROM explicit_links GROUP BY relation_type""")
def g8_graph_inventory(spark, d):
    """Nodes and edges of the graph by kind."""
    count = lambda t, kind: table(spark, d, t).agg(F.countDistinct("id").alias("n")).select(F.lit(kind).alias("kind"), "n")
    f = table(spark, d, "postings").select(F.lower(F.btrim("feature", F.lit(" \t"))).alias("f")).filter("f != ''").agg(F.countDistinct("f").alias("n")).select(F.lit("feature").alias("kind"), "n")
    links = table(spark, d, "explicit_links").groupBy("relation_type").agg(F.countDistinct("id").alias("n")).select(F.concat(F.lit("link "), "relation_type").alias("kind"), "n")
    return count("document_versions", "document").unionByName(count("segments", "segment")).unionByName(count("passages", "passage")).unionByName(f).unionByName(links)


@query("""WITH e AS (SELECT DISTINCT trim(to_node) AS node FROM explicit_links WHERE status = 'resolved' AND to_node IS NOT NULL), v AS (SELECT id AS node FROM document_versions UNION SELECT member FROM postings)
SELECT node, 'materialised' AS state FROM e ANTI JOIN v USING (node)""")
def g12_missing_ends(spark, d):
    """Ends of links that exist nowhere, to be made."""
    e = table(spark, d, "explicit_links").filter("status = 'resolved'").select(F.trim("to_node").alias("node")).filter("node IS NOT NULL").distinct()
    v = table(spark, d, "document_versions").select(F.col("id").alias("node")).unionByName(table(spark, d, "postings").select(F.col("member").alias("node")))
    return e.join(v, "node", "left_anti").select("node", F.lit("materialised").alias("state"))


@query("""WITH v AS (SELECT DISTINCT id, parent_document_version_id AS p, observed_at FROM document_versions), e AS (SELECT DISTINCT id FROM v)
SELECT v.id, CASE WHEN e.id IS NULL THEN 'dangling parent' ELSE 'kept' END AS state FROM v LEFT JOIN e ON e.id = v.p WHERE v.p IS NOT NULL""")
def g16_parents(spark, d):
    """Versions with a container, and whether that exists."""
    v = table(spark, d, "document_versions").select("id", F.col("parent_document_version_id").alias("p"), "observed_at").distinct()
    e = v.select(F.col("id").alias("p"), F.lit(1).alias("there")).distinct()
    return v.filter("p IS NOT NULL").join(e, "p", "left").select("id", F.when(F.col("there").isNull(), "dangling parent").otherwise("kept").alias("state"))


@query(r"""WITH u AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b(?:REF|INV|LOT|DN|AX|CASE)-\d{3,6}\b')) AS facet FROM documents), g AS (SELECT facet, min(doc_id) AS anchor, count(*) AS n FROM u GROUP BY 1 HAVING count(*) > 1)
SELECT facet, anchor, doc_id AS member FROM g JOIN u USING (facet) WHERE doc_id <> anchor""")
def g22_anchored_groups(spark, d):
    """Members of each facet paired with its first one: as many pairs as members, not their square."""
    ids = F.regexp_extract_all("text", F.lit(GRAMMAR["identifier"]), F.lit(0))
    u = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(ids)).alias("facet"))
    g = u.groupBy("facet").agg(F.min("doc_id").alias("anchor"), F.count("*").alias("n")).filter("n > 1")
    return u.join(g, "facet").filter("doc_id != anchor").select("facet", "anchor", F.col("doc_id").alias("member"))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents) SELECT doc_id, count(*) AS sentences, CAST(max(length(s)) AS BIGINT) AS longest FROM s WHERE s <> '' GROUP BY 1""")
def k4_sentences(spark, d):
    """Sentences of each text, and the longest one."""
    s = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.regexp_replace("text", r"([.!?])[ \t\r\n]+", "$1\u0001"), "\u0001")).alias("s")).filter("s != ''")
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("s")).cast("bigint").alias("longest"))


@query(r"""WITH m AS (SELECT DISTINCT id, text FROM segments WHERE id IS NOT NULL), l AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM m)
SELECT id, regexp_extract(line, '^(From|Von|De|Van): ([^<]+) <([^>]+)>', 2) AS name, lower(regexp_extract(line, '^(From|Von|De|Van): ([^<]+) <([^>]+)>', 3)) AS email, count(*) AS n FROM l WHERE regexp_matches(line, '^(From|Von|De|Van): ([^<]+) <([^>]+)>') GROUP BY ALL""")
def k8_identity_records(spark, d):
    """Names and addresses of header lines within texts."""
    p = r"^(From|Von|De|Van): ([^<]+) <([^>]+)>"
    m = table(spark, d, "segments").filter("id IS NOT NULL").select("id", "text").distinct()
    line = m.select("id", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(p))
    return line.groupBy("id", F.regexp_extract("line", p, 2).alias("name"), F.lower(F.regexp_extract("line", p, 3)).alias("email")).agg(F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS p FROM documents WHERE text IS NOT NULL) SELECT sha256(p) AS paragraph, count(*) AS uses, min(doc_id) AS first FROM p WHERE p <> '' GROUP BY 1""")
def k10_paragraph_cache(spark, d):
    """Each different paragraph once: what has to be parsed, and how often it is used."""
    p = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n[ \t\r]*\n")).alias("p")).filter("p != ''")
    return p.groupBy(F.sha2("p", 256).alias("paragraph")).agg(F.count("*").alias("uses"), F.min("doc_id").alias("first"))


@query("""WITH s AS (SELECT DISTINCT document_version_id AS k, CAST(char_start AS BIGINT) AS s, CAST(char_end AS BIGINT) AS e FROM segments WHERE document_version_id IS NOT NULL AND char_end > char_start),
w AS (SELECT k, unnest(range(0, max(e), 1500)) AS lo, max(e) AS m FROM s GROUP BY k), o AS (SELECT w.k, lo, m, greatest(lo, s.s) AS a, least(lo + 1500, s.e) AS b FROM w JOIN s ON s.k = w.k AND s.s < lo + 1500 AND s.e > lo)
SELECT k AS document, lo, CAST(sum(b - a) AS BIGINT) = least(lo + 1500, m) - lo AS covered, count(*) AS refs FROM o GROUP BY k, lo, m""")
def k11_source_references(spark, d):
    """Spans of 1,500 characters with the segments they refer to, and whether these cover them exactly."""
    s = table(spark, d, "segments").filter("document_version_id IS NOT NULL AND char_end > char_start")
    s = s.select(F.col("document_version_id").alias("document"), F.col("char_start").cast("bigint").alias("start"), F.col("char_end").cast("bigint").alias("end")).distinct()
    w = s.groupBy("document").agg(F.max("end").alias("m")).select("document", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1, F.lit(1500).cast("bigint"))).alias("lo")).withColumn("hi", F.col("lo") + 1500)
    o = segments.overlapping(w, s, "document", 3000).withColumn("part", F.least("hi", "end") - F.greatest("lo", "start"))
    return o.groupBy("document", "lo", "hi", "m").agg(F.sum("part").alias("c"), F.count("*").alias("refs")).select("document", "lo", (F.col("c") == F.least("hi", "m") - F.col("lo")).alias("covered"), "refs")


@query(r"""WITH u AS (SELECT DISTINCT source, unnest(regexp_extract_all(text, '\b(?:REF|INV|LOT|DN|AX|CASE)-\d{3,6}\b')) AS i FROM documents WHERE source IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY i) AS r, count(*) OVER (PARTITION BY source) AS n FROM u)
SELECT source, array_to_string(list(i ORDER BY i), ' ') AS hints, max(greatest(n - 20, 0)) AS remaining FROM r WHERE r <= 20 GROUP BY 1""")
def k14_discovery_hints(spark, d):
    """The first twenty identifiers of each source, and how many more there are."""
    ids = F.regexp_extract_all("text", F.lit(GRAMMAR["identifier"]), F.lit(0))
    u = table(spark, d, "documents").filter("source IS NOT NULL").select("source", F.explode(ids).alias("i")).distinct()
    by = W.partitionBy("source")
    r = u.select("source", "i", F.row_number().over(by.orderBy("i")).alias("r"), F.count("*").over(by).alias("n")).filter("r <= 20")
    return r.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("i")), " ").alias("hints"), F.max(F.greatest(F.col("n") - 20, F.lit(0))).alias("remaining"))


@query("SELECT doc_id, to_base64(encode(left(text, 12))) AS region, hex(encode(left(text, 4))) AS head FROM documents WHERE text IS NOT NULL")
def x18_regions(spark, d):
    """The first bytes of each text, encoded."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.base64(F.encode(F.left("text", F.lit(12)), "UTF-8")).alias("region"), F.hex(F.encode(F.left("text", F.lit(4)), "UTF-8")).alias("head"))


@query("SELECT DISTINCT segment_id, strftime(sent_at, '%Y-%m-%d') AS day, strftime(sent_at + INTERVAL 1 DAY, '%Y-%m-%d') AS tomorrow, strftime(sent_at - INTERVAL 1 DAY, '%Y-%m-%d') AS yesterday FROM mail_headers WHERE sent_at IS NOT NULL")
def x22_relative_days(spark, d):
    """The day of each mail, read from a header in the usual form, with the days beside it."""
    h = table(spark, d, "mail_headers").filter("sent_at IS NOT NULL").select("segment_id", F.date_format("sent_at", "d MMM yyyy HH:mm:ss").alias("header")).distinct()
    day = F.to_date(F.try_to_timestamp("header", F.lit("d MMM yyyy HH:mm:ss")))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd")
    return h.select("segment_id", fmt(day).alias("day"), fmt(F.date_add(day, 1)).alias("tomorrow"), fmt(F.date_sub(day, 1)).alias("yesterday")).distinct()


@query(r"""WITH s AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'total EUR ' WHEN 1 THEN 'total CHF ' ELSE 'total $' END || o_orderkey || '.50 due' AS t FROM orders)
SELECT k, CASE WHEN contains(t, '$') THEN 'ambiguous' ELSE regexp_extract(t, '(EUR|CHF)', 1) END AS currency, regexp_extract(t, '(\d+\.\d{2})', 1) AS amount FROM s""")
def x27_money_mentions(spark, d):
    """Amounts with their currency; a symbol of several currencies settles none."""
    k = F.col("o_orderkey")
    t = F.concat(F.when(k % 3 == 0, "total EUR ").when(k % 3 == 1, "total CHF ").otherwise("total $"), k.cast("string"), F.lit(".50 due"))
    s = table(spark, d, "orders").select(k.alias("k"), t.alias("t"))
    p = r"(EUR|CHF|USD|GBP|[$£€]) ?(\d+\.\d{2})"
    mark = F.regexp_extract("t", p, 1)
    return s.select("k", F.when(mark.isin("$", "£"), "ambiguous").when(mark == "€", "EUR").otherwise(mark).alias("currency"), F.regexp_extract("t", p, 2).alias("amount"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, count(*) FILTER (n % 2 = 0) AS even, count(*) FILTER (n % 2 = 1) AS odd, count(*) AS kinds FROM c GROUP BY 1) SELECT user_id, kinds, even, odd FROM p""")
def x33_merged_maps(spark, d):
    """Counters of each user as a map, split and put together again."""
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    even, odd = F.map_filter("m", lambda k, v: v % 2 == 0), F.map_filter("m", lambda k, v: v % 2 == 1)
    return m.select("user_id", F.size(F.map_concat(even, odd)).cast("bigint").alias("kinds"), F.size(even).cast("bigint").alias("even"), F.size(odd).cast("bigint").alias("odd"))


@query("""SELECT doc_id, CASE WHEN text LIKE '%PDF%' AND starts_with(text, '%PDF') THEN 'pdf' WHEN starts_with(ltrim(text), '<') THEN 'markup' WHEN starts_with(ltrim(text), '{') THEN 'json' WHEN starts_with(text, '+-') OR starts_with(text, '| ') THEN 'table' WHEN text IS NULL THEN 'none' ELSE 'text' END AS kind FROM documents""")
def s8_text_kinds(spark, d):
    """The kind of each text by how it begins."""
    t, left = F.col("text"), F.ltrim("text")
    kind = F.when(t.startswith("%PDF"), "pdf").when(left.startswith("<"), "markup").when(left.startswith("{"), "json").when(t.startswith("+-") | t.startswith("| "), "table").when(t.isNull(), "none").otherwise("text")
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"))


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents WHERE regexp_matches(text, '^[a-z]+;[a-z]+;'))
SELECT doc_id, n AS row_no, len(string_split(line, ';')) AS cells, string_split(line, ';')[1] AS first FROM l WHERE contains(line, ';')""")
def s11_delimited_rows(spark, d):
    """Rows of texts that begin with a delimited header."""
    docs = table(spark, d, "documents").filter(F.col("text").rlike("^[a-z]+;[a-z]+;"))
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "line")).filter(F.col("line").contains(";")).withColumn("c", F.split("line", ";"))
    return rows.select("doc_id", F.col("row_no").cast("bigint").alias("row_no"), F.size("c").cast("bigint").alias("cells"), F.col("c")[0].alias("first"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '<(script|style)[^>]*>[^<]*</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n\f\v]+', ' ', 'g')) AS visible FROM documents WHERE contains(text, '</')""")
def s12_markup_text(spark, d):
    """Texts with markup, without it."""
    t = F.regexp_replace(F.regexp_replace("text", "<(script|style)[^>]*>[^<]*</(script|style)>", " "), "<[^>]*>", " ")
    return table(spark, d, "documents").filter(F.col("text").contains("</")).select("doc_id", X.collapse(t).alias("visible"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_sha, true AS equal FROM documents")
def s4_staged_copy(spark, d):
    """The inventory of a staged copy, which was written and read again, and whether each row is as it was."""
    inventory = lambda rows: rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha"))
    source = table(spark, d, "documents")
    staged = inventory(scratch(spark).write(source.select("doc_id", "text")))
    return staged.join(inventory(source).withColumn("equal", F.lit(True)), ["doc_id", "content_sha"], "left").withColumn("equal", F.coalesce("equal", F.lit(False)))


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT doc_id, n, CASE WHEN regexp_matches(line, '^(#|§)+ ?[0-9A-Za-z]') THEN line END AS h FROM l)
SELECT doc_id, n AS line_no, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS heading FROM h QUALIFY heading IS NOT NULL""")
def w17_headings(spark, d):
    """Lines with the heading they stand under."""
    line = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))
    heading = F.when(F.col("line").rlike("^(#|§)+ ?[0-9A-Za-z]"), F.col("line"))
    return folds.carried(line, "doc_id", "line_no", heading, "heading").filter("heading IS NOT NULL").select("doc_id", "line_no", "heading")


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents WHERE contains(text, chr(9)))
SELECT doc_id, n AS row_no, c AS column_no, first_value(cell) OVER (PARTITION BY doc_id, c ORDER BY n) AS header, cell FROM (SELECT doc_id, n, unnest(range(len(string_split(line, chr(9))))) AS c, unnest(string_split(line, chr(9))) AS cell FROM l)""")
def w15_column_headers(spark, d):
    """Cells with the first cell of their column."""
    rows = table(spark, d, "documents").filter(F.col("text").contains("\t")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
    cells = rows.select("doc_id", F.col("row_no").cast("bigint").alias("row_no"), F.posexplode(F.split("line", "\t")).alias("column_no", "cell")).withColumn("column_no", F.col("column_no").cast("bigint"))
    return cells.withColumn("header", F.first("cell").over(W.partitionBy("doc_id", "column_no").orderBy("row_no")))


@query("SELECT user_id AS target, count(*) AS reviews, count(*) FILTER (k <> current) AS stale FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, arg_max(CAST(json_extract(props, '$.k') AS BIGINT), (ts, event_id)) OVER (PARTITION BY user_id) AS current FROM events) GROUP BY 1")
def q6_stale_reviews(spark, d):
    """Reviews of another revision than the current one."""
    e = table(spark, d, "events").select(F.col("user_id").alias("target"), "ts", "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    current = graph.latest(e, ["target"], ["ts", "event_id"], ["k"]).withColumnRenamed("k", "current")
    return e.join(current, "target").groupBy("target").agg(F.count("*").alias("reviews"), F.count_if(F.col("k") != F.col("current")).alias("stale"))


@query("""WITH v AS (SELECT DISTINCT id, original_blob_sha AS b FROM document_versions WHERE original_blob_sha IS NOT NULL), e AS (SELECT * FROM v WHERE id LIKE 'D0%')
SELECT b AS blob, count(*) AS versions, count(*) FILTER (id LIKE 'D0%') AS erased, count(*) = count(*) FILTER (id LIKE 'D0%') AS removable FROM v WHERE b IN (SELECT b FROM e) GROUP BY 1""")
def q15_erasure_plan(spark, d):
    """Contents of erased versions, and whether others still use them."""
    v = table(spark, d, "document_versions").filter("original_blob_sha IS NOT NULL").select("id", F.col("original_blob_sha").alias("blob")).distinct()
    touched = v.join(v.filter("id LIKE 'D0%'").select("blob"), "blob", "left_semi")
    erased = F.count_if(F.col("id").like("D0%"))
    return touched.groupBy("blob").agg(F.count("*").alias("versions"), erased.alias("erased"), (F.count("*") == erased).alias("removable"))


@query("""WITH i AS (SELECT p_partkey AS k, p_size AS s FROM part), r AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT count(*) AS intents, count(n) AS completed, count(*) FILTER (n IS NULL) AS unknown, CAST(coalesce(sum(n), 0) AS BIGINT) AS returned, CAST(max(s) AS BIGINT) AS largest FROM i LEFT JOIN r USING (k)""")
def a32_index_status(spark, d):
    """Counters over intents and what came of them."""
    r = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    j = table(spark, d, "part").select("p_partkey", "p_size").join(r, "p_partkey", "left")
    return j.agg(F.count("*").alias("intents"), F.count("n").alias("completed"), F.count_if(F.col("n").isNull()).alias("unknown"), F.coalesce(F.sum("n"), F.lit(0)).alias("returned"), F.max("p_size").cast("bigint").alias("largest"))


@query("SELECT event_id, round(least(exp(-value / 50), 1 - value / 200), 6) AS weakest, least(exp(-value / 50), 1 - value / 200) < 0.5 AS withheld FROM events WHERE value IS NOT NULL")
def a29_weakest(spark, d):
    """The weaker of two confidences, and whether it is too weak."""
    v = F.least(F.exp(-F.col("value") / 50), 1 - F.col("value") / 200)
    return table(spark, d, "events").filter("value IS NOT NULL").select("event_id", F.round(v, 6).alias("weakest"), (v < 0.5).alias("withheld"))


@query("""WITH s AS (SELECT o_custkey % 5 AS arm, o_orderkey, bool_and(l_quantity <= 50) AS valid, bool_or(l_returnflag = 'R') AS cited FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT arm, count(*) AS cases, count(*) FILTER (valid AND cited) AS passed, count(*) FILTER (NOT cited) AS uncited FROM s GROUP BY 1""")
def a33_citation_gate(spark, d):
    """Cases of each arm that pass all gates."""
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = j.groupBy((F.col("o_custkey") % 5).alias("arm"), "o_orderkey").agg(F.bool_and(F.col("l_quantity") <= 50).alias("valid"), F.bool_or(F.col("l_returnflag") == "R").alias("cited"))
    return s.groupBy("arm").agg(F.count("*").alias("cases"), F.count_if(F.col("valid") & F.col("cited")).alias("passed"), F.count_if(~F.col("cited")).alias("uncited"))


@query("SELECT event_type, min(event_id) AS next FROM events GROUP BY 1")
def l12_next_task(spark, d):
    """The next task of each kind."""
    return table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("next"))


@query()
def m1_calibration(spark, d):
    """Scores calibrated on four fifths of the documents, with the error before and after on the rest."""
    x = analytics._scored(spark, d)
    train, rest = x.filter("doc_id % 5 != 0"), x.filter("doc_id % 5 = 0")
    model = evaluation.isotonic(train, "score", "ok")
    y = F.col("ok").cast("int")
    scored = folds.calibrated(rest, model, "score")
    return scored.agg(F.round(F.avg(F.pow(F.col("score") - y, F.lit(2))), 6).alias("before"), F.round(F.avg(F.pow(F.col("rate") - y, F.lit(2))), 6).alias("after"), F.count("rate").alias("calibrated"), F.count("*").alias("n"))
