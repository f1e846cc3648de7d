"""Queries on texts: scans, predicates, segmentation, duplicates, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.functions import text as X
from sedimenta.operators import dedup, segments
from sedimenta.plans.registry import query
from sedimenta.session import table


@query("SELECT doc_id, sha256(text) AS content_sha, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents WHERE text IS NOT NULL")
def s3_checksums(spark, d):
    """Content hashes and byte lengths of all texts."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.sha2("text", 256).alias("content_sha"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@query("SELECT sha256(text) AS content_sha, count(*) AS refs, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1")
def s7_blobs(spark, d):
    """One row for each distinct content, with the number of documents that have it."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.groupBy(F.sha2("text", 256).alias("content_sha")).agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_doc"))


@query("""
WITH v AS (SELECT DISTINCT id, source_path FROM document_versions WHERE id IS NOT NULL),
s AS (SELECT DISTINCT document_version_id AS id FROM segments WHERE document_version_id IS NOT NULL),
j AS (SELECT coalesce(v.id, s.id) AS id, v.id AS a, s.id AS b, count(*) OVER (PARTITION BY v.source_path) AS same_path FROM v FULL JOIN s ON v.id = s.id)
SELECT CASE WHEN b IS NULL THEN 'not indexed' WHEN a IS NULL THEN 'missing' WHEN same_path > 1 THEN 'shared path' ELSE 'indexed' END AS status, count(*) AS n FROM j GROUP BY 1
""")
def s5_reconcile(spark, d):
    """What is on disk against what is indexed: a full outer join, with a count per path."""
    v = table(spark, d, "document_versions").filter("id IS NOT NULL").select(F.col("id").alias("a"), "source_path").distinct()
    s = table(spark, d, "segments").filter("document_version_id IS NOT NULL").select(F.col("document_version_id").alias("b")).distinct()
    j = v.join(s, F.col("a") == F.col("b"), "full").withColumn("same_path", F.count("*").over(W.partitionBy("source_path")))
    status = F.when(F.col("b").isNull(), "not indexed").when(F.col("a").isNull(), "missing").when(F.col("same_path") > 1, "shared path").otherwise("indexed")
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT lower(regexp_extract(source_path, '\\.([A-Za-z0-9]+)$', 1)) AS suffix, count(*) AS n, count(text) AS with_text FROM documents GROUP BY 1")
def s9_formats(spark, d):
    """Documents by suffix of their path."""
    docs = table(spark, d, "documents")
    return docs.groupBy(F.lower(F.regexp_extract("source_path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix")).agg(F.count("*").alias("n"), F.count("text").alias("with_text"))


@query(r"""
WITH m AS (SELECT DISTINCT s.id, s.text FROM segments s SEMI JOIN mail_headers h ON s.id = h.segment_id WHERE s.text IS NOT NULL),
l AS (SELECT id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM m)
SELECT id, CAST(line_no AS BIGINT) AS line_no, CAST(len(regexp_extract(line, '^[> ]*', 0)) - len(replace(regexp_extract(line, '^[> ]*', 0), '>', '')) AS BIGINT) AS depth FROM l
""")
def s19_quotation_depth(spark, d):
    """Of each line of an e-mail, how deep it is quoted."""
    mails = table(spark, d, "segments").join(table(spark, d, "mail_headers").select(F.col("segment_id").alias("id")), "id", "left_semi").select("id", "text").distinct()
    lead = F.regexp_extract("line", "^[> ]*", 0)
    return segments.lines(mails, "id").select("id", "line_no", (F.length(lead) - F.length(F.replace(lead, F.lit(">"), F.lit("")))).cast("bigint").alias("depth"))


@query(r"""SELECT DISTINCT segment_id, CASE WHEN regexp_matches(subject, '^[=+\-@\t\r]') THEN '''' || subject ELSE subject END AS subject,
replace(replace(subject, '|', '\|'), '*', '\*') AS markdown FROM mail_headers""")
def s29_report_cells(spark, d):
    """Subjects as cells of a spreadsheet and of a Markdown table."""
    h = table(spark, d, "mail_headers")
    escaped = F.replace(F.replace(F.col("subject"), F.lit("|"), F.lit("\\|")), F.lit("*"), F.lit("\\*"))
    return h.select("segment_id", X.formula_guard(F.col("subject")).alias("subject"), escaped.alias("markdown")).distinct()


@query("SELECT doc_id, source_path FROM documents WHERE contains(lower(source_path), 'minutes') AND (text IS NULL OR mime_type IS NULL)")
def f4_document_listing(spark, d):
    """Documents by part of the path, with an issue."""
    return table(spark, d, "documents").filter(F.lower("source_path").contains("minutes") & (F.col("text").isNull() | F.col("mime_type").isNull())).select("doc_id", "source_path")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '^[\\t-\\r\\x1c-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]*$')")
def f6_with_text(spark, d):
    """Documents that aren't blank."""
    return table(spark, d, "documents").filter(~X.is_blank(F.col("text"))).select("doc_id")


@query("""
WITH c AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE contains(text, 'the '))
SELECT doc_id, CAST(i - 1 AS BIGINT) AS position FROM c WHERE substring(text, i, 4) = 'the '
""")
def f10_literal_hits(spark, d):
    """Every place of a literal, in all texts."""
    from sedimenta.operators.lexical import literal_hits

    return literal_hits(table(spark, d, "documents"), "the ", "doc_id")


@query("""
SELECT 'text_sha' AS rule, count(*) AS broken FROM (SELECT DISTINCT id, text, text_sha FROM segments) WHERE text IS NOT NULL AND text_sha IS NOT NULL AND sha256(text) <> text_sha
UNION ALL SELECT 'length', count(*) FROM (SELECT DISTINCT id, text, char_start, char_end FROM segments) WHERE char_end - char_start <> length(text)
UNION ALL SELECT 'n_chars', count(*) FROM documents WHERE n_chars <> length(text)
""")
def f12_integrity(spark, d):
    """Rows whose stored hash or length isn't that of their text."""
    s = table(spark, d, "segments").select("id", "text", "text_sha", "char_start", "char_end").distinct()
    docs = table(spark, d, "documents")
    broken = lambda name, df, rule: df.agg(F.count_if(rule).alias("broken")).select(F.lit(name).alias("rule"), "broken")
    parts = broken("text_sha", s, F.sha2("text", 256) != F.col("text_sha")), broken("length", s, F.col("char_end") - F.col("char_start") != F.length("text"))
    return parts[0].unionByName(parts[1]).unionByName(broken("n_chars", docs, F.col("n_chars") != F.length("text")))


@query("""SELECT source_path, CASE WHEN contains(source_path, 'scans') THEN 'scan' WHEN contains(source_path, 'minutes') OR contains(source_path, 'notes') THEN 'record' ELSE 'deed' END AS role,
string_split(source_path, '/')[1] AS module, count(*) AS n FROM documents GROUP BY ALL""")
def f13_path_roles(spark, d):
    """Roles and modules by path."""
    docs, p = table(spark, d, "documents"), F.col("source_path")
    role = F.when(p.contains("scans"), "scan").when(p.contains("minutes") | p.contains("notes"), "record").otherwise("deed")
    return docs.groupBy("source_path", role.alias("role"), F.split(p, "/")[0].alias("module")).agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 600)) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(s // 600 AS BIGINT) AS ordinal, CAST(s AS BIGINT) AS char_start, CAST(least(s + 600, length(text)) AS BIGINT) AS char_end, sha256(substring(text, s + 1, 600)) AS part_sha FROM c
""")
def t1_fixed_segments(spark, d):
    """All texts in consecutive parts of 600 characters."""
    return segments.fixed_parts(table(spark, d, "documents"), "doc_id", 600).withColumn("part_sha", F.sha2("part", 256)).drop("part")


@query("""
WITH s AS (SELECT DISTINCT document_version_id, ordinal, char_start, char_end FROM segments WHERE document_version_id IS NOT NULL),
g AS (SELECT document_version_id, ordinal, char_start AS found, coalesce(lag(char_end) OVER (PARTITION BY document_version_id ORDER BY ordinal, char_start NULLS FIRST, char_end NULLS FIRST), 0) AS expected FROM s)
SELECT document_version_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(expected AS BIGINT) AS expected, CAST(found AS BIGINT) AS found FROM g WHERE found <> expected
""")
def w7_partition_gaps(spark, d):
    """Segments that don't begin where the one before ends."""
    s = table(spark, d, "segments").filter("document_version_id IS NOT NULL").select("document_version_id", "ordinal", "char_start", "char_end").distinct()
    w = W.partitionBy("document_version_id").orderBy("ordinal", "char_start", "char_end")
    numbered = s.withColumn("n", F.row_number().over(w))
    gaps = segments.partition_gaps(numbered, "document_version_id", "n").join(numbered, ["document_version_id", "n"])
    return gaps.select("document_version_id", *(F.col(c).cast("bigint").alias(c) for c in ("ordinal", "expected", "found")))


@query("""
WITH c AS (SELECT doc_id, length(text) AS n, unnest(range(0, greatest(length(text), 1), 800)) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(s // 800 AS BIGINT) AS ordinal, CAST(greatest(s - 200, 0) AS BIGINT) AS low, CAST(least(least(s + 800, n) + 200, n) AS BIGINT) AS high FROM c
""")
def t3_context_windows(spark, d):
    """Cores of 800 characters with 200 on both sides."""
    return segments.context_windows(table(spark, d, "documents"), "doc_id", 800, 200)


@query("""
WITH c AS (SELECT doc_id, text, unnest(range(0, length(text), 1200)) AS s FROM documents WHERE text IS NOT NULL AND length(text) > 0)
SELECT doc_id, CAST(s AS BIGINT) AS char_start, sha256(substring(text, s + 1, 1200)) AS block_id FROM c
""")
def t26_citation_blocks(spark, d):
    """Blocks of 1,200 characters that citations point to, with ids from their content."""
    parts = segments.fixed_parts(table(spark, d, "documents").filter("text != ''"), "doc_id", 1200)
    return parts.select("doc_id", "char_start", F.sha2("part", 256).alias("block_id"))


@query("""
WITH q AS (SELECT doc_id, greatest(length(text) // 2, 1) AS s, substring(text, greatest(length(text) // 2, 1), 40) AS quote FROM documents WHERE text IS NOT NULL),
o AS (SELECT q.doc_id, q.quote, q.s, d2.text FROM q JOIN documents d2 ON d2.doc_id = q.doc_id + 1)
SELECT doc_id, contains(text, quote) AS elsewhere, coalesce(substring(text, s, length(quote)) = quote, false) AS same_place FROM o WHERE text IS NOT NULL
""")
def t27_quote_validation(spark, d):
    """Whether a quotation from one document stands in the next one, and at the same place."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    q = docs.withColumn("s", F.greatest(F.floor(F.length("text") / 2), F.lit(1)).cast("int")).select("doc_id", "s", F.expr("substring(text, s, 40)").alias("quote"))
    o = q.withColumn("next", F.col("doc_id") + 1).join(docs.select(F.col("doc_id").alias("next"), "text"), "next")
    return o.select("doc_id", F.contains("text", "quote").alias("elsewhere"), F.expr("coalesce(substring(text, s, length(quote)) = quote, false)").alias("same_place"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS line_no FROM l WHERE contains(lower(line), 'register')
""")
def t24_line_search(spark, d):
    """Lines that contain a literal in any case."""
    return segments.lines(table(spark, d, "documents"), "doc_id").filter(F.lower("line").contains("register")).select("doc_id", "line_no")


@query("SELECT doc_id, " + ", ".join(f"""CAST(len(regexp_extract_all(lower(text), '{p.replace("'", "''")}')) AS BIGINT) AS "{n}\"""" for n, p in X.RISK_MARKERS.items()) + " FROM documents WHERE text IS NOT NULL")
def t28_risk_markers(spark, d):
    """Words that restrict or qualify, by category, in each text."""
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", *X.marker_counts(F.col("text")))


@query("SELECT sha256(text) AS content_sha, min(doc_id) AS first_key, count(*) AS members FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def d1_exact_duplicates(spark, d):
    """Texts that several documents have."""
    return dedup.duplicate_groups(table(spark, d, "documents"), "doc_id", F.col("text"))


@query(r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n\f\v]+', ' ', 'g')) AS t FROM documents
WHERE NOT regexp_matches(text, '^[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*$'))
SELECT sha256(t) AS content_sha, min(doc_id) AS first_key, count(*) AS members FROM c GROUP BY 1 HAVING count(*) > 1
""")
def d2_repeated_wording(spark, d):
    """Texts that differ in whitespace at most."""
    return dedup.repeated_wording(table(spark, d, "documents"), "doc_id")


_PARAGRAPHS = """l AS (SELECT doc_id, coalesce(mime_type, '') AS modality, string_split(text, chr(10) || chr(10)) AS p FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id || ':' || n AS id, doc_id, modality, n AS ordinal, sha256(p[n]) AS sha FROM (SELECT *, unnest(range(1, len(p) + 1)) AS n FROM l))"""


def _paragraphs(spark, d):
    """(id, doc_id, modality, ordinal, sha) of the paragraphs of all documents."""
    l = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.coalesce("mime_type", F.lit("")).alias("modality"), F.posexplode(F.split("text", "\n\n", -1)).alias("n", "p"))
    n = F.col("n").cast("bigint") + 1
    return l.select(F.concat_ws(":", F.col("doc_id").cast("string"), n.cast("string")).alias("id"), "doc_id", "modality", n.alias("ordinal"), F.sha2("p", 256).alias("sha"))


@query(f"""WITH {_PARAGRAPHS}, p AS (SELECT id, sha, lag(sha) OVER w AS b, lead(sha) OVER w AS a FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal, id)), m AS (SELECT id, min(id) OVER (PARTITION BY sha, b, a) AS alias_of FROM p)
SELECT id, alias_of FROM m WHERE id <> alias_of""")
def d3_context_aliases(spark, d):
    """Paragraphs that repeat another one with the same neighbours."""
    return dedup.context_aliases(_paragraphs(spark, d), "doc_id", "id", "ordinal", "sha")


@query(f"""WITH {_PARAGRAPHS}, p AS (SELECT modality, sha, lag(sha) OVER w AS b, lead(sha) OVER w AS a FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal, id)),
k AS (SELECT sha256(modality || '|' || sha || '|' || coalesce(b, '') || '|' || coalesce(a, '')) AS context FROM p) SELECT context, count(*) AS members FROM k GROUP BY 1 HAVING count(*) > 1""")
def w6_context_key(spark, d):
    """Contexts (kind, text and the texts beside it) that several paragraphs have, and how many."""
    w = W.partitionBy("doc_id").orderBy("ordinal", "id")
    beside = [F.coalesce(f("sha").over(w), F.lit("")) for f in (F.lag, F.lead)]
    keys = _paragraphs(spark, d).select(F.sha2(F.concat_ws("|", "modality", "sha", *beside), 256).alias("context"))
    return keys.groupBy("context").agg(F.count("*").alias("members")).filter("members > 1")


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM w WHERE len(w) >= 5),
c AS (SELECT min(doc_id) AS k, s FROM r GROUP BY s), e AS (SELECT k, len(s) AS n, unnest(s) AS h FROM c),
p AS (SELECT a.k AS l, b.k AS r, a.n AS n, b.n AS m, count(*) AS shared FROM e a JOIN e b ON a.h = b.h AND a.k < b.k WHERE a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY ALL)
SELECT l AS left_key, r AS right_key, round(shared / (n + m - shared), 6) AS similarity FROM p WHERE shared / (n + m - shared) >= 0.8
""")
def d4_near_duplicates(spark, d):
    """Documents that share at least 0.8 of their runs of five words; of equal ones the first."""
    return dedup.near_duplicates(table(spark, d, "documents"), "doc_id")


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM w WHERE len(w) >= 5)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS representative FROM r
""")
def d4_shingle_classes(spark, d):
    """Of each document, the first one with the same runs of five words."""
    return dedup.shingle_classes(table(spark, d, "documents"), "doc_id")


@query(r"""
WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS p FROM documents WHERE text IS NOT NULL),
c AS (SELECT DISTINCT doc_id, sha256(trim(regexp_replace(p, '[ \t\r\n\f\v]+', ' ', 'g'))) AS h FROM p WHERE length(trim(regexp_replace(p, '[ \t\r\n\f\v]+', ' ', 'g'))) >= 40)
SELECT h AS paragraph_sha, count(*) AS items FROM c GROUP BY 1 HAVING count(*) > 1
""")
def d5_shared_paragraphs(spark, d):
    """Paragraphs that stand in several documents."""
    return dedup.shared_paragraphs(table(spark, d, "documents"), "doc_id")


@query(r"""SELECT DISTINCT segment_id, lower(trim(regexp_extract(from_addr, '<([^>]*)>', 1))) AS address,
CASE WHEN contains(from_addr, '<') THEN array_to_string(regexp_extract_all(replace(replace(replace(replace(lower(trim(string_split(from_addr, '<')[1])), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[\p{L}\p{N}]+'), ' ') END AS name
FROM mail_headers WHERE contains(from_addr, '<')""")
def x5_names_and_addresses(spark, d):
    """Names and addresses of senders, for comparison."""
    h = table(spark, d, "mail_headers").filter(F.col("from_addr").contains("<"))
    return h.select("segment_id", F.lower(X.mail_address(F.col("from_addr"))).alias("address"), X.folded_name(X.display_name(F.col("from_addr"))).alias("name")).distinct()


@query(r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
SELECT w AS word, CASE WHEN w LIKE '%ation' AND length(w) >= 9 THEN left(w, length(w) - 5) WHEN w LIKE '%ion' AND length(w) >= 7 THEN left(w, length(w) - 3) WHEN w LIKE '%ing' AND length(w) >= 7 THEN left(w, length(w) - 3)
WHEN w LIKE '%ed' AND length(w) >= 6 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) >= 5 THEN left(w, length(w) - 1) ELSE w END AS stem FROM w
""")
def x10_stems(spark, d):
    """All words without common English endings."""
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", X.stem(F.col("word")).alias("stem"))


@query("SELECT doc_id, left(text, 1024) AS preview, length(text) > 1024 AS truncated FROM documents WHERE text IS NOT NULL")
def x14_previews(spark, d):
    """The first 1,024 characters of each text."""
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.preview(F.col("text")).alias("preview"), (F.length("text") > 1024).alias("truncated"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(strlen(props) AS BIGINT) AS n_bytes FROM events")
def x34_json_fields(spark, d):
    """A field of each event's JSON, and its size."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.octet_length("props").cast("bigint").alias("n_bytes"))


@query("""
WITH s AS (SELECT DISTINCT document_version_id, char_start AS a, char_end AS b FROM segments WHERE document_version_id IS NOT NULL AND char_end > char_start),
f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY document_version_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY document_version_id ORDER BY a, b) = 1 THEN 1 ELSE 0 END AS f FROM s),
i AS (SELECT *, sum(f) OVER (PARTITION BY document_version_id ORDER BY a, b) AS i FROM f)
SELECT document_version_id, CAST(min(a) AS BIGINT) AS a, CAST(max(b) AS BIGINT) AS b FROM i GROUP BY document_version_id, i
""")
def x36_merged_spans(spark, d):
    """What the segments of each document cover, without overlaps."""
    s = table(spark, d, "segments").filter("document_version_id IS NOT NULL AND char_end > char_start")
    spans = s.select("document_version_id", F.col("char_start").cast("bigint").alias("a"), F.col("char_end").cast("bigint").alias("b")).distinct()
    return segments.merged_spans(spans, "document_version_id", "a", "b")
