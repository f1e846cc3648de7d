"""Dense search, fusion of routes, diversity, interleaving, budgets and samples."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.operators import lexical
from sedimenta.session import checkpoint, discard, ship

#: Queries that are compared with all rows at once.
QUERY_BLOCK = 10_000


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """A vector of length 1; null for zero vectors and vectors with values that aren't finite."""
    n = norm(a)
    return F.when((n > 0) & (n < float("inf")), F.transform(a, lambda x: x.cast("double") / n))


def cosine_search(vectors: DataFrame, query: DataFrame, key: str, vector: str, limit: int) -> DataFrame:
    """(`key`, score) of the vectors nearest to the query, a table of one row and column, by exact cosine; equal scores in the order of the key. A top-k, so no full sort."""
    q = F.col("_q")
    scored = vectors.crossJoin(F.broadcast(query.limit(1).toDF("_q"))).select(key, F.round(F.try_divide(dot(F.col(vector), q), norm(F.col(vector)) * norm(q)), 6).alias("score"))
    return scored.filter("score IS NOT NULL").orderBy(F.desc("score"), key).limit(limit)


def cosine_neighbours(vectors: DataFrame, queries: DataFrame, key: str, vector: str, limit: int) -> DataFrame:
    """(query_key, `key`, score, rank): for each row of `queries` its nearest others by cosine, exactly. Vectors without a direction are left out."""
    return _neighbours(vectors.select(key, normalised(F.col(vector)).alias("v")), queries.select(F.col(key).alias("query_key"), normalised(F.col(vector)).alias("q")), key, limit)


def dot_neighbours(vectors: DataFrame, queries: DataFrame, key: str, vector: str, limit: int) -> DataFrame:
    """As `cosine_neighbours`, by dot product."""
    doubles = F.col(vector).cast("array<double>")
    return _neighbours(vectors.select(key, doubles.alias("v")), queries.select(F.col(key).alias("query_key"), doubles.alias("q")), key, limit)


def _neighbours(rows: DataFrame, asked: DataFrame, key: str, limit: int) -> DataFrame:
    """Queries go against all rows in blocks of about `QUERY_BLOCK`, of which one at a time is sent to the workers: however many there are, what is sent at once has a bound.

    Each batch of rows is multiplied with a block's matrix, and of each query only its best `limit` of the batch leave the worker.
    """
    ship(rows.sparkSession)
    rows, asked = rows.filter("v IS NOT NULL"), asked.filter("q IS NOT NULL")
    kinds = f"query_key {dict(asked.dtypes)['query_key']}, `{key}` {dict(rows.dtypes)[key]}, score double"
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    w = W.partitionBy("query_key").orderBy(F.desc("score"), key)
    found = []
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_key"), F.lit(blocks)) == b) if blocks > 1 else asked
        arrow = block.toArrow().combine_chunks()
        sent = rows.sparkSession.sparkContext.broadcast((arrow.column(0), np.array(arrow.column(1).to_pylist(), float).reshape(arrow.num_rows, -1)))
        best = rows.mapInArrow(_best(sent, limit), kinds)
        found.append(best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit))
    return reduce(DataFrame.unionByName, found)


def _best(sent, limit: int):
    def run(batches):
        asked, matrix = sent.value
        names = asked.to_pylist()
        for b in batches:
            keys = b.column(0).to_pylist()
            if not keys or not names:
                continue
            scores = np.round(np.array(b.column(1).to_pylist(), float) @ matrix.T, 6) + 0.0
            order = np.array(sorted(range(len(keys)), key=keys.__getitem__))  # equal scores in the order of the key
            rows, columns = [], []
            for j, name in enumerate(names):
                kept = order[np.argsort(-scores[order, j], kind="stable")]
                kept = [i for i in kept[: limit + 1] if keys[i] != name][:limit]
                rows += kept
                columns += [j] * len(kept)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in columns], asked.type), b.column(0).take(at), pa.array(scores[rows, columns])], names=["query_key", b.schema.names[0], "score"])

    return run


def fuse(routes: DataFrame, key: str, route: str, order: list, k: int = 60) -> DataFrame:
    """(`key`, score, routes): reciprocal rank fusion of all routes' hits."""
    hits = lexical.reciprocal_ranks(routes, key, order, k, [route])
    return hits.groupBy(key).agg(F.round(F.sum("rr"), 6).alias("score"), F.count("*").alias("routes"))


def diversified(ranked: DataFrame, group: list[str], order: list) -> DataFrame:
    """`ranked` with `turn`: how many of its group come before it. Sorting by turn first admits the groups in turn."""
    return ranked.withColumn("turn", (F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1).cast("bigint"))


def interleaved(first: DataFrame, second: DataFrame, position: str) -> DataFrame:
    """Both pools with `slot`: two of the first, then one of the second. position: of each row in its pool, from 0."""
    k = F.col(position)
    a = first.withColumn("slot", (F.lit(3) * F.floor(k / 2) + k % 2).cast("bigint"))
    b = second.withColumn("slot", (F.lit(3) * k + 2).cast("bigint"))
    return a.unionByName(b)


def within_budget(ranked: DataFrame, size: Column, budget: int, order: list, by: list[str]) -> DataFrame:
    """The rows of each group of `by` up to the first that would go over the budget, with `used`."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(size).over(w).cast("bigint")).filter(F.col("used") <= budget)


def packed(ranked: DataFrame, key: str, size: str, budget: int, order: str, by: str, limit: int | None = None) -> DataFrame:
    """(`by`, `key`): of each group, in order, each row that still fits, up to `limit` rows if there is one: one that is too large is skipped and later ones are tried.

    One pass over the sorted rows of each group that holds what is used so far alone, so a group's size doesn't matter.
    """
    ship(ranked.sparkSession)
    rows = ranked.select(F.col(by).alias("g"), F.col(key).alias("k"), F.col(size).cast("bigint").alias("s"), F.col(order).alias("o"))

    def fold(batches):
        group, used, taken = object(), 0, 0
        for b in batches:
            take = []
            for i, (g, s) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if g != group:
                    group, used, taken = g, 0, 0
                if used + s <= budget and (limit is None or taken < limit):
                    used += s
                    taken += 1
                    take.append(i)
            yield b.select([0, 1]).take(pa.array(take, pa.int64()))

    turn = rows.filter(F.col("s") <= budget).repartition("g").sortWithinPartitions("g", "o").select("g", "k", "s")
    schema = rows.select("g", "k").schema
    return turn.mapInArrow(fold, schema).select(F.col("g").alias(by), F.col("k").alias(key))


def hash_sample(items: DataFrame, stratum: str, key: str, seed: str, n: int) -> DataFrame:
    """(`stratum`, `key`): of each stratum the `n` rows that come first by a hash of seed and key: the same whatever the order of the rows."""
    drawn = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    w = W.partitionBy(stratum).orderBy(drawn, key)
    return items.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).select(stratum, key)


def page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next `limit` rows after a key, with `remaining`: how many come after the page. Filter and top-k, no offset."""
    rest = rows.filter(F.col(key) > after) if after is not None else rows
    count = rest.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("remaining"))
    return rest.orderBy(key).limit(limit).crossJoin(F.broadcast(count))


def page_cursor(scope: str, last: Column) -> Column:
    """An opaque cursor that is bound to the scope it was made for."""
    return F.base64(F.concat(F.sha2(F.lit(scope), 256), F.lit(":"), last.cast("string")))


def facet_cover(items: DataFrame, key: str, facet: str, limit: int, relevance: str | None = None) -> DataFrame:
    """(`key`, place, fresh): at most `limit` items, each the one with the most facets not yet covered (then the most relevant, then the smallest key), until nothing is new.

    What is left of the items after each choice is written and read once; the driver sees one key a choice, of which there are `limit`.
    """
    spark = items.sparkSession
    order = [F.desc("n"), *([F.desc("r")] if relevance else []), key]
    rest = checkpoint(items.select(key, facet, *([F.col(relevance).alias("r")] if relevance else [])).distinct())
    chosen: list[tuple] = []
    while len(chosen) < limit:
        best = rest.groupBy(key).agg(F.countDistinct(facet).alias("n"), *([F.max("r").alias("r")] if relevance else [])).orderBy(*order).limit(1).collect()
        if not best:
            break
        chosen.append((best[0][0], len(chosen), best[0]["n"]))
        covered = rest.filter(F.col(key) == best[0][0]).select(facet)
        before, rest = rest, checkpoint(rest.join(covered, facet, "left_anti"))
        discard(before)
    discard(rest)
    kind = dict(items.select(key).dtypes)[key]
    return spark.createDataFrame(chosen, f"`{key}` {kind}, place bigint, fresh bigint")
