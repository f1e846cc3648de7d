"""Queries of the operators in this subpackage over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import components, language, mail, neardup, packing, quality, splitting, tokens
from sedimenta.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return mail.new_lines(table(spark, folder, "segments"), table(spark, folder, "mail_headers"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.similar_members(table(spark, folder, "postings"))


def p2_class_links(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.class_links(table(spark, folder, "postings"))


def p2_class_members(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.class_members(table(spark, folder, "postings"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.member_groups(table(spark, folder, "explicit_links"), table(spark, folder, "postings"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized_boundaries(table(spark, folder, "segments"))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_segments(table(spark, folder, "segments"))


def p4_piece_checks(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.piece_checks(table(spark, folder, "segments"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.undeclared_languages(*(table(spark, folder, t) for t in ("segments", "document_versions", "lang_tags", "common_words")))


def p5_spans(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_spans(table(spark, folder, "segments"), table(spark, folder, "common_words"))


def p5_documents(spark: SparkSession, folder: str) -> DataFrame:
    return language.document_languages(table(spark, folder, "segments"), table(spark, folder, "common_words"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(table(spark, folder, "documents"), "doc_id")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def p7_instructions(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_instructions(table(spark, folder, "documents"))


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_checks(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.unnatural(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    of = quality.text_statistics(table(spark, folder, "documents"), table(spark, folder, "common_words"))
    return of.select("doc_id", "n_words", "mean_word_length", "symbol_ratio", "end_punctuation", "common_share")


def p8_line_shares(spark: SparkSession, folder: str) -> DataFrame:
    of = quality.text_statistics(table(spark, folder, "documents"), table(spark, folder, "common_words"))
    return of.select("doc_id", "prose_share", "list_share", "table_share", "junk_share", "shape")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p2_class_links, p2_class_members, p3_found, p4_found, p4_pieces, p4_piece_checks, p5_found, p5_spans, p5_documents, p6_ids, p7_containers, p7_instructions, p7_checks, p8_found, p8_statistics, p8_line_shares)
}

_SETS = r"""f AS (SELECT DISTINCT member, lower(trim(feature, ' ' || chr(9))) AS f FROM postings WHERE member IS NOT NULL AND trim(feature, ' ' || chr(9)) <> ''),
n AS (SELECT member, count(*) AS n, array_to_string(list_sort(list(f)), ' ') AS key FROM f GROUP BY 1)"""
_SIMILAR = f"""{_SETS}, o AS (SELECT a.member AS a, b.member AS b, count(*) AS shared FROM f a JOIN f b ON a.f = b.f AND a.member < b.member GROUP BY ALL),
s AS (SELECT o.a, o.b FROM o JOIN n x ON x.member = o.a JOIN n y ON y.member = o.b WHERE shared >= 0.75 * (x.n + y.n - shared))"""
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

ORACLE_SQL: dict[str, str] = {
    "p4_piece_checks": "SELECT DISTINCT id AS segment_id, length(text) AS covered, 0 AS too_long, 0 AS wrong_overlap, 0 AS wrong_text FROM segments WHERE length(text) > 2000",
    "p7_checks": "SELECT count(*) AS placed, 0 AS cut_needlessly, 0 AS with_gaps, 0 AS over_limits FROM documents WHERE text <> ''",
    "p8_statistics": rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS w, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS filled,
length(regexp_replace(text, '[\p{{L}}\p{{N}}]|{_BLANK}', '', 'g')) AS symbols, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_BLANK}+$', '')), lambda x: x <> '') AS lines FROM documents),
c AS (SELECT DISTINCT lower(word) AS word FROM common_words WHERE word IS NOT NULL), k AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN c USING (word) GROUP BY 1)
SELECT doc_id, coalesce(len(w), 0) AS n_words, CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) END AS mean_word_length, CASE WHEN filled > 0 THEN symbols / filled END AS symbol_ratio,
CASE WHEN filled > 0 THEN len(list_filter(lines, lambda x: regexp_matches(x, '([.!?…:;。！？]|\.[”"»])$'))) / len(lines) END AS end_punctuation, CASE WHEN len(w) > 0 THEN coalesce(n, 0) / len(w) END AS common_share FROM d LEFT JOIN k USING (doc_id)""",
    "p2_found": f"WITH {_SIMILAR} SELECT a AS member_a, b AS member_b FROM s",
    "p2_class_members": f"WITH {_SETS} SELECT member, min(member) OVER (PARTITION BY key) AS rep FROM n",
    "p2_class_links": f"WITH {_SIMILAR}, r AS (SELECT key, min(member) AS rep FROM n GROUP BY 1) SELECT a AS rep_a, b AS rep_b FROM s WHERE a IN (SELECT rep FROM r) AND b IN (SELECT rep FROM r)",
    "p3_found": """
WITH RECURSIVE m AS (SELECT DISTINCT member FROM postings WHERE member IS NOT NULL),
l AS (SELECT DISTINCT trim(from_node) AS a, trim(to_node) AS b FROM explicit_links WHERE status = 'resolved' AND trim(from_node) <> trim(to_node) AND trim(from_node) IN (FROM m) AND trim(to_node) IN (FROM m)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS member, min(least(a, b)) AS group_id FROM r GROUP BY 1""",
    "p4_found": rf"""
WITH s AS (SELECT DISTINCT id, text FROM segments WHERE length(text) > 2000), t AS (SELECT id, regexp_replace(regexp_replace(text, '^{_BLANK}+', ''), '{_BLANK}+$', '') AS t FROM s)
SELECT id AS segment_id, CASE WHEN regexp_matches(t, '\n{_BLANK}*\n') THEN 'paragraph' WHEN contains(t, chr(10)) THEN 'line' WHEN regexp_matches(t, '[.!?]{_BLANK}') THEN 'sentence' WHEN regexp_matches(t, '{_BLANK}') THEN 'word' ELSE 'none' END AS boundary FROM t""",
}
