"""Filling of fixed-capacity containers: vector bin packing by the dot-product heuristic.

An item is a vector of demands (tokens, segments, loss-bearing tokens) and a container holds a vector of limits. A container is
filled by always adding, of the items that still fit in every dimension, the one whose demands, weighted by the scarcity of each
dimension, have the largest dot product with the room that is left. Items of equal demands are interchangeable, so only distinct
vectors are compared.

Items are spread by a hash over shards of about `SHARD` items, each packed by one task: a task's memory doesn't grow with the
table, and each shard leaves at most a few partly filled containers. Only the number of items reaches the driver. Items larger
than a container are cut into full containers and a rest, which is an item like others; only they are ever cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.tokens import RANK_FILE, token_counts
from sedimenta.session import checkpoint, ship

CAPACITY = 2048
#: Most documents in a container: attention masks and position resets are kept for so many.
SEGMENTS = 64
#: Items that are packed together.
SHARD = 50_000


def fill(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container of each item, from 0. demands: [items, dimensions], each within limits: [dimensions]."""
    kinds, kind_of = np.unique(demands, axis=0, return_inverse=True)
    kind_of = kind_of.reshape(-1)
    left = np.bincount(kind_of, minlength=len(kinds))
    relative = kinds / limits
    weighted = relative * (relative * left[:, None]).sum(axis=0)  # scarcity: the whole demand, in containers
    order: list[list[int]] = [[] for _ in kinds]
    container = -1
    alive = np.arange(len(kinds))
    while len(alive):
        container += 1
        room = limits.astype(np.int64).copy()
        own = alive
        while True:
            own = own[(kinds[own] <= room).all(axis=1) & (left[own] > 0)]
            if not len(own):
                break
            best = own[np.argmax(weighted[own] @ (room / limits))]
            left[best] -= 1
            order[best].append(container)
            room -= kinds[best]
        alive = alive[left[alive] > 0]
    out = np.empty(len(demands), np.int64)
    out[np.argsort(kind_of, kind="stable")] = np.concatenate([np.array(x, np.int64) for x in order]) if len(kinds) else []
    return out


def _pack(limits: np.ndarray):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.take(pc.sort_indices(shard, [("item", "ascending"), ("piece_no", "ascending")]))
        demands = np.stack([shard.column(c).to_numpy() for c in ("n_tokens", "n_segments", "n_loss")], axis=1)
        number = (shard.column("shard").to_numpy().astype(np.int64) << 32) + fill(demands, limits)
        return shard.select(["item", "piece_no", "token_start", "n_tokens"]).append_column("container_id", pa.array(number))

    return run


def pack(items: DataFrame, key: str, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_capacity: int | None = None) -> DataFrame:
    """(`key`, piece_no, token_start, n_tokens, container_id): a place for each item, cut only if it is larger than a container.

    items: `key`, n_tokens and optionally n_loss, the tokens that bear loss (else all but an item's first, which nothing predicts).
    Items without tokens need no container and have no row; null counts are like 0. A repeated row is another item. Containers never exceed
    `capacity` tokens, `segments` items and `loss_capacity` (default: capacity) loss-bearing tokens. Other columns don't matter.
    """
    ship(items.sparkSession)
    limits = np.array([capacity, segments, loss_capacity or capacity], np.int64)
    n = F.col("n_tokens").cast("bigint")
    loss = F.least(F.col("n_loss").cast("bigint"), n) if "n_loss" in items.columns else n - 1
    sized = items.select(F.col(key).alias("item"), n.alias("size"), F.greatest(loss, F.lit(0)).alias("loss"))
    sized = checkpoint(sized.filter("size > 0"))
    kind = dict(sized.dtypes)["item"]
    # Pieces of a cut item are so short that they fit even if all their tokens bear loss.
    piece = F.when((F.col("size") <= capacity) & (F.col("loss") <= int(limits[2])), F.col("size")).otherwise(int(limits[[0, 2]].min()))
    first = F.lit(0).cast("bigint")
    starts = F.when(F.col("size") <= piece, F.array(first)).otherwise(F.sequence(first, F.col("size") - 1, piece))
    parts = sized.withColumn("piece", piece).select("*", F.posexplode(starts).alias("piece_no", "token_start"))
    parts = parts.withColumn("n_tokens", F.least(F.col("piece"), F.col("size") - F.col("token_start")))
    share = F.when(F.col("n_tokens") == F.col("size"), F.col("loss")).otherwise(F.least("loss", "n_tokens"))
    parts = parts.select("item", "piece_no", "token_start", "n_tokens", F.lit(1).cast("bigint").alias("n_segments"), share.alias("n_loss"))
    shards = max(1, -(-sized.count() // SHARD))
    sharded = parts.withColumn("shard", F.pmod(F.xxhash64("item", "piece_no"), F.lit(shards)))
    out = sharded.groupBy("shard").applyInArrow(_pack(limits), f"item {kind}, piece_no int, token_start bigint, n_tokens bigint, container_id bigint")
    return out.withColumnRenamed("item", key)


#: Limits of containers for instruction data: segments, and loss-bearing tokens.
FEW_SEGMENTS, LOSS = 6, 1536


def instruction_sizes(documents: DataFrame, ranks: str = RANK_FILE) -> DataFrame:
    """(doc_id, n_tokens, n_loss): a document read as a prompt, its first line, and the answer to it, whose tokens bear loss. A document of one line has no prompt, but nothing predicts its first token."""
    parts = documents.select("doc_id", "text", F.substring_index("text", "\n", 1).alias("prompt"))
    both = parts.select("doc_id", F.explode(F.array(F.struct(F.lit("all").alias("part"), "text"), F.struct(F.lit("prompt").alias("part"), F.col("prompt").alias("text")))).alias("x"))
    of = token_counts(both.select(F.struct("doc_id", "x.part").alias("key"), "x.text"), "key", "text", ranks)
    one = F.col("key.part") == "prompt"
    sizes = of.groupBy("key.doc_id").agg(F.sum(F.when(~one, F.col("n_tokens"))).alias("n_tokens"), F.sum(F.when(one, F.col("n_tokens"))).alias("prompt"))
    return sizes.select("doc_id", "n_tokens", (F.col("n_tokens") - F.when(F.col("prompt") < F.col("n_tokens"), F.col("prompt")).otherwise(1)).alias("n_loss"))


def pack_instructions(documents: DataFrame, capacity: int = CAPACITY, segments: int = FEW_SEGMENTS, loss: int = LOSS, ranks: str = RANK_FILE) -> DataFrame:
    """`pack` of documents as instruction data, under all three limits: (doc_id, piece_no, token_start, n_tokens, container_id)."""
    return pack(instruction_sizes(documents, ranks), "doc_id", capacity, segments, loss)


def pack_checks(documents: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, ranks: str = RANK_FILE) -> DataFrame:
    """One row about `pack_documents`: documents placed, containers over a limit, documents cut though they fit, documents whose pieces leave a gap or overlap."""
    placed = checkpoint(pack_documents(documents, capacity, segments, ranks))
    of = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("m"))
    over = of.agg(F.count(F.when((F.col("n") > capacity) | (F.col("m") > segments), 1)).alias("over_limits"))
    ends = F.max(F.col("token_start") + F.col("n_tokens"))
    items = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("pieces"), ends.alias("end"), F.min("token_start").alias("begin"), F.countDistinct("token_start").alias("starts"))
    gaps = (F.col("begin") != 0) | (F.col("end") != F.col("size")) | (F.col("starts") != F.col("pieces"))
    cut = (F.col("pieces") > 1) & (F.col("size") <= capacity)
    return items.agg(F.count("*").alias("placed"), F.count(F.when(cut, 1)).alias("cut_needlessly"), F.count(F.when(gaps, 1)).alias("with_gaps")).crossJoin(over)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, ranks: str = RANK_FILE) -> DataFrame:
    """`pack` of the texts of documents, sized in tokens of the tokenizer: (doc_id, piece_no, token_start, n_tokens, container_id)."""
    return pack(token_counts(documents, "doc_id", "text", ranks), "doc_id", capacity, segments)
