"""Segmentation of texts into gap-free parts, context windows and citation blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def fixed_parts(items: DataFrame, key: str, size: int, text: str = "text") -> DataFrame:
    """(`key`, ordinal, char_start, char_end, part): consecutive parts of `size` characters; an empty text is one empty part."""
    n = F.length(text)
    starts = F.when(n == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(size)))
    cut = items.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_t"), F.posexplode(starts).alias("ordinal", "char_start"))
    return cut.select(
        key,
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.col("char_start").cast("bigint").alias("char_start"),
        F.least(F.col("char_start") + size, F.length("_t")).cast("bigint").alias("char_end"),
        F.substring("_t", F.col("char_start") + 1, F.lit(size)).alias("part"),
    )


def partition_gaps(parts: DataFrame, key: str, ordinal: str = "ordinal", start: str = "char_start", end: str = "char_end") -> DataFrame:
    """(`key`, ordinal, expected, found): where a part doesn't begin at the end of the one before, or the first one not at 0."""
    w = W.partitionBy(key).orderBy(ordinal)
    seen = parts.select(key, ordinal, F.col(start).alias("found"), F.coalesce(F.lag(end).over(w), F.lit(0)).alias("expected"))
    return seen.filter(F.col("found") != F.col("expected")).select(key, ordinal, "expected", "found")


def context_windows(items: DataFrame, key: str, core: int, margin: int, text: str = "text") -> DataFrame:
    """(`key`, ordinal, low, high): cores of `core` characters widened by `margin` on both sides, within the text."""
    parts = fixed_parts(items, key, core, text)
    total = F.max("char_end").over(W.partitionBy(key))
    return parts.select(key, "ordinal", F.greatest(F.col("char_start") - margin, F.lit(0)).alias("low"), F.least(F.col("char_end") + margin, total).alias("high"))


def canonical_offsets(sections: DataFrame, key: str, order: str, length: Column, separator: int = 2) -> DataFrame:
    """(`key`, `order`, begin): where each section begins in the text of all sections joined by a separator."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return sections.select(key, order, F.coalesce(F.sum(length + separator).over(w), F.lit(0)).cast("bigint").alias("begin"))


def lines(items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(`key`, line_no, line): what \\n separates, from 0; a carriage return before it belongs to the line end."""
    return items.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", F.regexp_replace("line", "\r$", "")).withColumn("line_no", F.col("line_no").cast("bigint"))


def merged_spans(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(`key`, start, end): overlapping or touching spans of a key made one (gaps and islands)."""
    before = W.partitionBy(key).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    running = W.partitionBy(key).orderBy(start, end)
    opened = spans.select(key, F.col(start).alias("s"), F.col(end).alias("e")).select(key, F.col("s").alias(start), F.col("e").alias(end))
    flagged = opened.withColumn("fresh", F.coalesce(F.col(start) > F.max(end).over(before), F.lit(True)).cast("int"))
    return flagged.withColumn("island", F.sum("fresh").over(running)).groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def overlapping(left: DataFrame, right: DataFrame, key: str, bucket: int) -> DataFrame:
    """Rows of left (lo, hi) and right (start, end) whose half-open ranges overlap: an equi-join on key and bucket of positions, so no nested loop."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.greatest(F.col(b) - 1, F.col(a))) / bucket)))
    x, y = left.withColumn("_b", span("lo", "hi")), right.withColumn("_b", span("start", "end"))
    joined = x.join(y, [key, "_b"]).filter("start < hi AND end > lo")
    # A pair meets in each bucket both touch; it counts in the first one.
    return joined.filter(F.col("_b") == F.floor(F.greatest("lo", "start") / bucket)).drop("_b")
