"""Statistics of evaluations: intervals, percentiles, bootstrap, isotonic regression, confusion counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.session import checkpoint, ship


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval of a share, within 0 and 1; null for n = 0."""
    p = F.try_divide(successes.cast("double"), n.cast("double"))
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    radius = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.when(n > 0, F.greatest(centre - radius, F.lit(0.0))), F.when(n > 0, F.least(centre + radius, F.lit(1.0)))


def nearest_rank(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """(`by`, value): the value at rank ceil(share n) of each group; not interpolated."""
    group = W.partitionBy(*by)
    ranked = rows.filter(F.col(value).isNotNull()).select(*by, value, F.row_number().over(group.orderBy(value)).alias("_r"), F.count("*").over(group).alias("_n"))
    return ranked.filter(F.col("_r") == F.ceil(F.col("_n") * F.lit(share))).select(*by, value)


def index_rank(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """(`by`, value): the value at index round((n - 1) share), halves to the even one."""
    group = W.partitionBy(*by)
    ranked = rows.filter(F.col(value).isNotNull()).select(*by, value, (F.row_number().over(group.orderBy(value)) - 1).alias("_r"), F.count("*").over(group).alias("_n"))
    return ranked.filter(F.col("_r") == F.bround((F.col("_n") - 1) * F.lit(share), 0).cast("int")).select(*by, value)


def bootstrap_interval(clusters: DataFrame, key: str, value: str, resamples: int = 2000, seed: str = "37", low: int = 49, high: int = 1949) -> DataFrame:
    """(low, high): order statistics of the means of resampled clusters; null for fewer than two.

    Draws come from a hash of seed, resample and draw, so they are the same in any engine. The clusters are numbered once; resamples are spread over the cluster.
    """
    numbered = clusters.select(F.col(value).alias("v"), (F.row_number().over(W.orderBy(key)) - 1).alias("i"))
    n = clusters.count()
    if n < 2:
        return clusters.sparkSession.range(1).select(F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    draws = clusters.sparkSession.range(resamples).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    digest = F.sha2(F.concat_ws(":", F.lit(seed), "r", "k"), 256)
    drawn = draws.select("r", (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % n).cast("int").alias("i"))
    means = drawn.join(numbered, "i").groupBy("r").agg(F.round(F.avg("v"), 9).alias("m"))
    placed = means.withColumn("p", F.row_number().over(W.orderBy("m")) - 1)
    return placed.agg(F.max(F.when(F.col("p") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("p") == high, F.col("m"))).alias("high"))


def _pooled(rows: Iterator[tuple]) -> Iterator[list]:
    """Blocks [sum, count, keys] of rows (key, sum, count) in order, merged while one's mean isn't below that of the next: pool adjacent violators, with a stack."""
    stack: list[list] = []
    for key, total, n in rows:
        stack.append([total, n, [key]])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            total, n, keys = stack.pop()
            stack[-1][0] += total
            stack[-1][1] += n
            stack[-1][2] += keys
    return iter(stack)


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, first, s, n): of each key the first key of its block, and the block's totals."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for total, n, keys in _pooled(rows):
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.float64()), pa.array([keys[0]] * len(keys), pa.float64()), pa.array([total] * len(keys), pa.float64()), pa.array([n] * len(keys), pa.int64())], names=["key", "first", "s", "n"])


def isotonic(rows: DataFrame, score: str, outcome: str) -> DataFrame:
    """(score, rate): the non-decreasing fit to the outcome's rate by distinct score, by pooling adjacent violators.

    Rows are aggregated by score, ranges of scores are pooled each for itself, and the blocks that are left are pooled once more, in one task: merging within a range first
    doesn't change the fit. Scores find their block's rate by an equality join. Linear in distinct scores; null scores don't count.
    """
    ship(rows.sparkSession)
    points = rows.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("key")).agg(F.sum(F.col(outcome).cast("double")).alias("s"), F.count("*").alias("n"))
    within = checkpoint(points.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_pool, "key double, first double, s double, n bigint"))
    blocks = within.filter("key = first").select("key", "s", "n")
    merged = blocks.coalesce(1).sortWithinPartitions("key").mapInArrow(_pool, "key double, first double, s double, n bigint")
    rates = merged.select(F.col("key").alias("first"), F.round(F.col("s") / F.col("n"), 6).alias("rate"))
    return within.join(rates, "first").select(F.col("key").alias("score"), "rate")


def confusion(labelled: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall): null where a denominator is 0. Rows without prediction are misses, not dropped."""
    a = labelled.groupBy(F.col(actual).alias("label")).agg(F.count("*").alias("actual"), F.count_if(F.col(actual) == F.col(predicted)).alias("tp")).filter("label IS NOT NULL")
    p = labelled.groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("predicted")).filter("label IS NOT NULL")
    j = a.join(p, "label", "full").select("label", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tp", "actual", "predicted")))
    return j.select(
        "label", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("actual") - F.col("tp")).alias("fn"),
        F.round(F.try_divide("tp", "predicted"), 6).alias("precision"), F.round(F.try_divide("tp", "actual"), 6).alias("recall"),
    )
