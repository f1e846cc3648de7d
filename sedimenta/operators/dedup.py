"""Exact and contextual duplicates, shared paragraphs, and near-duplicates by banded MinHash with exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.functions.text import collapse, is_blank, words


def duplicate_groups(items: DataFrame, key: str, content: Column) -> DataFrame:
    """(content_sha, first_key, members) of each content that two or more items have. Only hashes are shuffled."""
    hashed = items.filter(content.isNotNull()).select(F.col(key), F.sha2(content, 256).alias("content_sha"))
    return hashed.groupBy("content_sha").agg(F.min(key).alias("first_key"), F.count("*").alias("members")).filter("members > 1")


def repeated_wording(items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """As `duplicate_groups`, of texts that differ in whitespace at most; blank texts are no wording."""
    return duplicate_groups(items.filter(~is_blank(F.col(text))), key, collapse(F.col(text)))


def context_aliases(segments: DataFrame, document: str, key: str, order: str, sha: str) -> DataFrame:
    """(`key`, alias_of): segments whose text and both neighbours' texts equal another's; the smallest key stands for all."""
    w = W.partitionBy(document).orderBy(order, key)
    placed = segments.select(key, F.col(sha).alias("own"), F.lag(sha).over(w).alias("before"), F.lead(sha).over(w).alias("after"))
    same = W.partitionBy("own", "before", "after")
    return placed.filter("own IS NOT NULL").withColumn("alias_of", F.min(key).over(same)).filter(F.col(key) != F.col("alias_of")).select(key, "alias_of")


def shared_paragraphs(items: DataFrame, key: str, text: str = "text", least: int = 40) -> DataFrame:
    """(paragraph_sha, items) of paragraphs of at least so many characters that stand in two or more items."""
    parts = items.select(F.col(key), F.explode(F.split(text, "\n[ \t\r]*\n")).alias("p")).select(key, collapse(F.col("p")).alias("p"))
    hashed = parts.filter(F.length("p") >= least).select(key, F.sha2("p", 256).alias("paragraph_sha")).distinct()
    return hashed.groupBy("paragraph_sha").agg(F.count("*").alias("items")).filter("items > 1")


def _shingle_sets(items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    tokens = items.filter(F.col(text).isNotNull()).select(F.col(key), words(F.col(text)).alias("w")).filter(F.size("w") >= size)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.xxhash64(F.slice("w", i, F.lit(size))))
    return tokens.select(key, F.array_sort(F.array_distinct(runs)).alias("set")).withColumn("class", F.xxhash64("set"))


def near_duplicates(items: DataFrame, key: str, text: str = "text", size: int = 5, bands: int = 14, rows: int = 3, threshold: float = 0.8) -> DataFrame:
    """(left_key, right_key, similarity) of items whose shingle sets have a Jaccard similarity of at least `threshold`.

    Equal shingle sets are put together first, and only their smallest keys are paired (`shingle_classes` lists the copies). Candidates agree in
    all `rows` minimum hashes of one of `bands` bands: of pairs at 0.8 that finds all but one in 20,000, of closer ones more. Shingles that
    many items share don't make buckets large, and no bucket is cut. The sets then decide.
    """
    sets = _shingle_sets(items, key, text, size)
    reps = sets.groupBy("class").agg(F.min(key).alias(key), F.first("set").alias("set"))
    least = lambda i: F.array_min(F.transform("set", lambda x: F.xxhash64(x, F.lit(i))))
    band = F.array(*(F.xxhash64(F.lit(b), *(least(b * rows + r) for r in range(rows))) for b in range(bands)))
    banded = reps.select(key, F.size("set").alias("n"), F.explode(band).alias("h"))
    other = banded.select(F.col(key).alias("right_key"), F.col("n").alias("m"), "h")
    pairs = banded.withColumnRenamed(key, "left_key").join(other, "h").filter("left_key < right_key")
    pairs = pairs.filter((F.col("n") >= threshold * F.col("m")) & (F.col("m") >= threshold * F.col("n"))).select("left_key", "right_key").distinct()
    a = reps.select(F.col(key).alias("left_key"), F.col("set").alias("a"))
    b = reps.select(F.col(key).alias("right_key"), F.col("set").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    similarity = shared / (F.size("a") + F.size("b") - shared)
    scored = pairs.join(a, "left_key").join(b, "right_key").withColumn("similarity", similarity).filter(F.col("similarity") >= threshold)
    return scored.select("left_key", "right_key", F.round("similarity", 6).alias("similarity"))


def shingle_classes(items: DataFrame, key: str, text: str = "text", size: int = 5) -> DataFrame:
    """(`key`, representative) of each item with at least `size` words: the smallest key with an equal set of shingles."""
    sets = _shingle_sets(items, key, text, size).select(key, "class")
    return sets.join(sets.groupBy("class").agg(F.min(key).alias("representative")), "class").select(key, "representative")
