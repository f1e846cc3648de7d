"""Links, neighbourhoods, bounded search, closures and shared features.

Edges are rows; a node with very many edges is never collected. Searches go level by level, each one join and one distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.session import Scratch, checkpoint


def resolve(references: DataFrame, targets: DataFrame, reference: str, name: str, target: str) -> DataFrame:
    """`references` with status and target: resolved if exactly one target has the name, ambiguous (and no target) if several, else unresolved.

    Targets are counted per name before the join, so a name that many targets share is one row.
    """
    named = targets.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias(reference)).agg(F.countDistinct(target).alias("_n"), F.min(target).alias("_t"))
    joined = references.join(named, reference, "left")
    status = F.when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "ambiguous").otherwise("unresolved")
    return joined.withColumn("status", status).withColumn("target", F.when(F.col("_n") == 1, F.col("_t"))).drop("_n", "_t")


def adjacency(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, other): edges in both directions, self links once."""
    out = edges.select(F.col(source).alias("node"), F.col(target).alias("other"))
    back = edges.filter(F.col(source) != F.col(target)).select(F.col(target).alias("node"), F.col(source).alias("other"))
    return out.unionByName(back).filter("node IS NOT NULL AND other IS NOT NULL")


def levels(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): all nodes within `depth` steps of the seeds. edges: (node, other) in both directions; seeds: (node).

    Each level is written once, as the next ones and the result all read it."""
    found = checkpoint(seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("bigint")))
    last = found
    for level in range(1, depth + 1):
        step = last.select("node").join(edges, "node").select(F.col("other").alias("node")).distinct()
        last = checkpoint(step.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(level).cast("bigint")))
        found = found.unionByName(last)
    return found


def bounded_search(edges: DataFrame, seeds: DataFrame, depth: int, most: int) -> DataFrame:
    """(node, depth): of the nodes within `depth` steps of the seeds the first `most` by (depth, node)."""
    return levels(edges, seeds, depth).orderBy("depth", "node").limit(most)


def closure(parents: DataFrame, seeds: DataFrame, child: str, parent: str) -> DataFrame:
    """(node): seeds and everything derived from them, directly or not. Rounds end when nothing is new; what is new in each is written once, to the checkpoint folder."""
    scratch = Scratch(seeds.sparkSession)
    links = scratch.write(parents.select(F.col(parent).alias("node"), F.col(child).alias("next")).filter("node IS NOT NULL AND next IS NOT NULL").distinct())
    fresh = found = scratch.write(seeds.select("node").filter("node IS NOT NULL").distinct())
    while True:
        fresh = scratch.write(fresh.join(links, "node").select(F.col("next").alias("node")).distinct().join(found, "node", "left_anti"))
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh)


#: How much a shared feature of a kind says; explicit links come before all of them (0), other kinds after them (3).
TIERS = {"identifier": 1, "original_blob": 1, "message_id": 1, "document_reference": 1, "paragraph": 2}


def related(occurrences: DataFrame, links: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, other, tier, rank, shared, linked): for each asked item all others that have a feature in common with it or are linked with it.

    occurrences: (item, kind, feature); links: (node, other), both directions; asked: (item). rank: sum of ln(1 + N / df) over the distinct shared features; tier:
    0 for linked ones, else that of the best kind. However common a feature is, nothing is left out: the search goes out from the asked items alone, so the work is that of
    the postings of their features, not of all pairs.
    """
    rows = occurrences.select("item", "kind", "feature").filter("item IS NOT NULL AND feature IS NOT NULL").distinct()
    n = rows.agg(F.countDistinct("item").alias("n"))
    mine = asked.select("item").distinct().join(rows, "item").select(F.col("item").alias("asked"), "kind", "feature")
    df = rows.join(mine.select("kind", "feature").distinct(), ["kind", "feature"]).groupBy("kind", "feature").agg(F.count("*").alias("df"))
    weighted = mine.join(df, ["kind", "feature"]).crossJoin(F.broadcast(n)).select("asked", "kind", "feature", F.log1p(F.col("n") / F.col("df")).alias("w"))
    tier = F.lit(3)
    for kind, t in TIERS.items():
        tier = F.when(F.col("kind") == kind, t).otherwise(tier)
    shared = rows.withColumnRenamed("item", "other").join(weighted, ["kind", "feature"]).filter("other != asked")
    by_feature = shared.groupBy("asked", "other").agg(F.min(tier).alias("tier"), F.round(F.sum("w"), 6).alias("rank"), F.count("*").alias("shared"))
    direct = asked.select(F.col("item").alias("asked")).distinct().join(links.select(F.col("node").alias("asked"), "other").distinct(), "asked").filter("other != asked").withColumn("linked", F.lit(True))
    both = by_feature.join(direct, ["asked", "other"], "full")
    linked = F.coalesce("linked", F.lit(False))
    return both.select("asked", "other", F.when(linked, 0).otherwise(F.col("tier")).cast("bigint").alias("tier"), F.coalesce("rank", F.lit(0.0)).alias("rank"), F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared"), linked.alias("linked"))


def shared_by(occurrences: DataFrame, left, right, item: str, feature: str) -> DataFrame:
    """(`feature`): what two items have in common; both are filtered before anything is joined."""
    of = lambda k: occurrences.filter(F.col(item) == F.lit(k)).select(feature).filter(F.col(feature).isNotNull()).distinct()
    return of(left).join(of(right), feature)


def capped_view(nodes: DataFrame, edges: DataFrame, key: str, source: str, target: str, most: int) -> DataFrame:
    """The edges with both ends among the first `most` nodes, at most four times as many."""
    kept = nodes.select(F.col(key).alias("_k")).orderBy("_k").limit(most)
    inner = edges.join(kept.withColumnRenamed("_k", source), source, "left_semi").join(kept.withColumnRenamed("_k", target), target, "left_semi")
    return inner.orderBy(*inner.columns).limit(4 * most)


def latest(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each group: an aggregate, not a sort."""
    chosen = F.max_by(F.struct(*columns), F.struct(*order)).alias("r")
    return rows.groupBy(*by).agg(chosen).select(*by, "r.*")


def interval_conflicts(claims: DataFrame, block: list[str], key: str, start: str, end: str, opposite: Column, width: int = 32) -> DataFrame:
    """(left, right, overlap_start, overlap_end, boundary): claims of one block that contradict each other while both hold; an open end never ends.

    opposite: the condition on the columns l.* and r.* of the two claims. Nulls of a block are equal. Claims meet by block and by stretches of `width` days in which they hold: each
    is put into the stretch it begins in, and looks for those that begin later in all it holds in up to the last beginning, so claims of a crowded block that are far apart are never paired.
    """
    last = F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))
    rows = claims.withColumns({"_s": F.col(start).cast("date"), "_e": last}).filter("_s IS NOT NULL AND _s <= _e")
    # Nothing begins after the last beginning of a block, so an open end needs no stretch beyond it.
    ends = rows.groupBy(*block).agg(F.max("_s").alias("_max"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in block]
    joined = rows.alias("a").join(ends.alias("b"), on).select("a.*", "b._max") if block else rows.crossJoin(F.broadcast(ends))
    at = lambda c: F.floor(F.unix_date(c) / width)
    holds = joined.withColumn("_bin", F.explode(F.sequence(at(F.col("_s")), at(F.least("_e", "_max"))))).drop("_max")
    begins = rows.withColumn("_bin", at(F.col("_s")))
    left, right = holds.alias("l"), begins.alias("r")
    cond = F.col("l._bin") == F.col("r._bin")
    for c in block:
        cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    # The later beginning finds the earlier one; of equal beginnings the larger key finds the smaller.
    first = (F.col("l._s") < F.col("r._s")) | ((F.col("l._s") == F.col("r._s")) & (F.col(f"l.{key}") < F.col(f"r.{key}")))
    pairs = left.join(right, cond & first & (F.col("l._e") >= F.col("r._s")) & opposite)
    stop = F.least("l._e", "r._e")
    return pairs.select(F.least(f"l.{key}", f"r.{key}").alias("left"), F.greatest(f"l.{key}", f"r.{key}").alias("right"), F.col("r._s").alias("overlap_start"), stop.alias("overlap_end"), (F.col("r._s") == stop).alias("boundary"))


def as_of(events: DataFrame, marks: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """`events` with the last value of `marks` at or before each one, by group: one union and a running last, no range join.

    A mark counts for an event of the same time."""
    both = events.withColumn("_m", F.lit(None).cast(marks.schema[value].dataType)).withColumn("_o", F.lit(1)).unionByName(
        marks.select(*by, at, F.col(value).alias("_m")).withColumn("_o", F.lit(0)), allowMissingColumns=True
    )
    w = W.partitionBy(*by).orderBy(at, "_o").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("as_of", F.last("_m", ignorenulls=True).over(w)).filter("_o = 1").drop("_m", "_o")
