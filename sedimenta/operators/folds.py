"""Ordered folds and carried states that no window expresses, or that a window carries."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.session import ship


def batch_numbers(sizes: list[int], most: int, budget: int) -> list[int]:
    """Consecutive batches of at most `most` items and `budget` together; an item over the budget is alone."""
    out, number, count, used = [], 0, 0, 0
    for s in sizes:
        if count and (count == most or used + s > budget):
            number, count, used = number + 1, 0, 0
        out.append(number)
        count, used = count + 1, used + s
    return out


def batches(items: DataFrame, by: str, order: str, size: str, most: int, budget: int) -> DataFrame:
    """(`by`, `order`, batch): greedy batches within each group, in order. A group is one document's parts, folded by one task."""
    ship(items.sparkSession)
    kinds = dict(items.dtypes)
    source = items.select(by, order, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"))

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [(order, "ascending")]))
        return group.select([by, order]).append_column("batch", pa.array(batch_numbers(group.column("_size").to_pylist(), most, budget), pa.int64()))

    return source.groupBy(by).applyInArrow(run, f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, batch bigint")


def carried(rows: DataFrame, by: str, order: str, marker: Column, name: str) -> DataFrame:
    """`rows` with the last marker at or before each one: headers of tables, speakers, days, headings."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(marker, ignorenulls=True).over(w))


def outside(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points that lie in no span [start, end) of their key: a running maximum of ends, no range join."""
    both = points.select(key, F.col(at).alias("p"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("e")).unionByName(
        spans.select(key, F.col(start).alias("p"), F.lit(0).alias("kind"), F.col(end).cast("bigint").alias("e"))
    )
    w = W.partitionBy(key).orderBy("p", "kind").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("_m", F.max("e").over(w)).filter("kind = 1 AND (_m IS NULL OR _m <= p)").select(key, F.col("p").alias(at))


def calibrated(scores: DataFrame, model: DataFrame, score: str) -> DataFrame:
    """`scores` with the rate of the first fitted score at or above each; null beyond the fitted range. model: (score, rate), few rows."""
    blocks = model.agg(F.array_sort(F.collect_list(F.struct("score", "rate"))).alias("m"))
    joined = scores.crossJoin(F.broadcast(blocks))
    fits = F.filter("m", lambda b: b["score"] >= F.col(score))
    within = (F.col(score) >= F.col("m")[0]["score"]) & (F.size(fits) > 0)
    return joined.withColumn("rate", F.when(within, fits[0]["rate"])).drop("m")
