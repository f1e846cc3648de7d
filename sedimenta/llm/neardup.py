"""Near-duplicate sets by Golay-code fuzzy hashing, with exact verification.

Each feature flips one bit of a fingerprint, so two fingerprints differ in at most as many bits as the sets differ in
features. Sets of a and b features with a Jaccard similarity of at least T share at least ceil((a + b) T / (1 + T)), so they
differ in at most D(a + b) features. The features are dealt to m segments; if m > D / 3, some segment differs in at most two
features (pigeonhole). A segment's fingerprint is a Golay word, and its keys are the codeword indices of the word and of its
one-bit neighbours: words that differ in at most two bits share one of them, for certain. Sets take part with each m that a
partner of a possible size calls for, m rounded up to a few steps, so the keys of a set are in proportion to its size.

Twelve bits of index are few for sets without end, and words of few features lie close together. So an index counts together with a feature
of the set's prefix, the rarest |A| - ceil(T |A|) + 1, of which similar sets always share one; with a common feature (in more than one set of
`COMMON`), two words from independent hashes are used, all pairs of whose indices are keys. Similar sets thus share a key for
certain, buckets stay small however frequent a feature is, and none is capped. The sets themselves then decide.

Sets that are equal are put together first and only one of them is hashed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.functions.text import strip
from sedimenta.llm import golay
from sedimenta.session import checkpoint, ship

#: A feature is common if more than one set in so many has it; at most so many times the mean set's size of features are.
COMMON = 500
#: Fingerprint bits made at once.
_CELLS = 1 << 22


def least_overlap(total: int, threshold: float) -> int:
    """Features that sets of `total` features together must share."""
    return math.ceil(round(total * threshold / (1 + threshold), 9))


def _rounded(need: int) -> int:
    """`need` rounded up to 1, 2, 3, 4, 6, 8, 12, 16, ..."""
    step = 1
    while step < need:
        step = step + 1 if step < 3 else 1 << step.bit_length() if step & (step - 1) else step * 3 // 2
    return step


def _differ(total: int, threshold: float) -> int:
    """Features in which sets of `total` features together may differ."""
    return total - 2 * least_overlap(total, threshold)


def segments_for(total: int, threshold: float) -> int:
    """Segments of which one differs in two bits at most, by sets of `total` features together."""
    return _rounded(_differ(total, threshold) // 3 + 1)


@cache
def levels(size: int, threshold: float) -> tuple[int, ...]:
    """The numbers of segments with which a set of this size can meet a partner: those of all totals from the least partner to the largest.

    From one total to the next the features that may differ change by one, up or down, so they take all values between their least and
    their greatest. They lie less than two below a straight line, so these extremes are near the ends.
    """
    least, most = size + math.ceil(round(size * threshold, 9)), size + math.floor(round(size / threshold, 9))
    near = math.ceil(2 * (1 + threshold) / (1 - threshold)) + 1 if threshold < 1 else 1
    low = min(_differ(t, threshold) for t in range(least, min(most, least + near) + 1))
    high = max(_differ(t, threshold) for t in range(max(least, most - near), most + 1))
    found = [_rounded(low // 3 + 1)]
    while found[-1] < high // 3 + 1:
        found.append(_rounded(found[-1] + 1))
    return tuple(found)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Well-spread 64-bit values."""
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def segment_words(values: np.ndarray, row: np.ndarray, rows: int, m: int, salt: int) -> np.ndarray:
    """[rows * m]: the Golay words of the segments of `rows` sets. values: features as uint64; row: the set of each."""
    where = _mix(values, m)
    segment = row * m + (where % np.uint64(m)).astype(np.int64)
    bit = (_mix(values, 0x60A1 + salt) >> np.uint64(20)) % np.uint64(golay.BITS)
    odd = np.bincount(segment * golay.BITS + bit.astype(np.int64), minlength=rows * m * golay.BITS) & 1
    return (odd.reshape(-1, golay.BITS) << np.arange(golay.BITS)).sum(axis=1).astype(np.int32)


def _distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different indices of each word and its neighbours: (indices, sorted, [n, 24]; which of them are the first of their value)."""
    near = np.sort(golay.neighbour_indices(words), axis=-1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    return near, fresh


def _crossed(left: np.ndarray, right_start: np.ndarray, right_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (position in left, position in right), left's group g having the range [right_start[g], + right_n[g]); left: group of each."""
    n = right_n[left]
    first = np.repeat(np.arange(len(left)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return first, np.repeat(right_start[left], n) + offset


def anchored_keys(values: np.ndarray, row: np.ndarray, rows: int, anchors: np.ndarray, anchor_row: np.ndarray, often: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each key, key) for `rows` sets with m segments and the anchors (prefix features, by row) of each; often: which of these are common."""
    near, fresh = _distinct(segment_words(values, row, rows, m, 0))
    at, place = np.nonzero(fresh)
    index = near[at, place].astype(np.uint64) | (at % m).astype(np.uint64) << np.uint64(24)
    counts = np.bincount(at // m, minlength=rows)
    begin = np.cumsum(counts) - counts
    out_row, out_key = [], []
    for common in (False, True):
        mine = np.flatnonzero(often == common)
        if not len(mine):
            continue
        anchor, key = _crossed(anchor_row[mine], begin, counts)
        total, segment = index[key], at[key]
        if common:
            second, again = _distinct(segment_words(values, row, rows, m, 1))
            at2, place2 = np.nonzero(again)
            n2 = np.bincount(at2, minlength=rows * m)
            first, other = _crossed(segment, np.cumsum(n2) - n2, n2)
            anchor, total = anchor[first], total[first] | second[at2, place2][other].astype(np.uint64) << np.uint64(12)
        out_row.append(anchor_row[mine][anchor])
        out_key.append(_mix(total ^ _mix(anchors[mine][anchor], 0xA5A5 + m), 0x51ED))
    return np.concatenate([np.empty(0, np.int64), *out_row]), np.concatenate([np.empty(0, np.uint64), *out_key])


def prefixes(values: np.ndarray, row: np.ndarray, size: np.ndarray, common: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions in values, whether common) of each set's prefix. Any order that is the same for all sets would do; common features come last."""
    often = np.isin(values, common)
    order = np.lexsort((values, often, row))
    rank = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    length = size - np.ceil(np.round(size * threshold, 9)).astype(np.int64) + 1
    chosen = order[rank < np.repeat(length, size)]
    return chosen, often[chosen]


def _keys(threshold: float, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sets = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            values = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            size = np.diff(sets.offsets.to_numpy()).astype(np.int64)
            start = np.cumsum(size) - size
            wanted = [levels(int(n), threshold) for n in size]
            for m in sorted({m for x in wanted for m in x}):
                mine = np.flatnonzero([m in x for x in wanted])
                step = max(1, _CELLS // (m * golay.BITS))
                for part in (mine[i : i + step] for i in range(0, len(mine), step)):
                    n = size[part]
                    row, at = _crossed(np.arange(len(part)), start[part], n)
                    own = values[at]
                    chosen, often = prefixes(own, row, n, common.value, threshold)
                    rows, keys = anchored_keys(own, row, len(part), own[chosen], row[chosen], often, m)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part][rows]), pa.array(keys.view(np.int64))], names=["id", "key"])

    return run


def common_features(distinct: DataFrame) -> np.ndarray:
    """The features of more than one set in `COMMON`; their number is bounded by that times the mean size of a set."""
    counts = distinct.select(F.explode("features").alias("f")).groupBy("f").count()
    least = distinct.count() / COMMON
    return np.sort(np.array([r.f for r in counts.filter(F.col("count") > least).select("f").collect()], np.int64).view(np.uint64))


def feature_sets(postings: DataFrame) -> DataFrame:
    """(member, features ARRAY<BIGINT>): sorted 64-bit hashes of each member's features, which compare in lower case without surrounding whitespace.

    Null or blank features and null members don't count; a member without any feature has no row.
    """
    feature = F.lower(strip(F.col("feature")))
    rows = postings.filter("member IS NOT NULL AND feature IS NOT NULL").select("member", feature.alias("f")).filter("f != ''")
    return rows.groupBy("member").agg(F.array_sort(F.collect_set(F.xxhash64("f"))).alias("features"))


def _similar(a: Column, b: Column, threshold: float) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared >= F.lit(threshold) * (F.size(a) + F.size(b) - shared)


def classes(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal feature sets put together: (id, rep, members, n, features) of each distinct set, and (member, id).

    rep is the smallest member of the set's class. Both come from a checkpoint.
    """
    sets = checkpoint(feature_sets(postings).withColumns({"h1": F.xxhash64("features"), "h2": F.xxhash64(F.lit(1), "features")}))
    merged = sets.groupBy("h1", "h2").agg(F.min("member").alias("rep"), F.count("*").alias("members"), F.first("features").alias("features"))
    distinct = checkpoint(merged.withColumns({"id": F.monotonically_increasing_id(), "n": F.size("features")}))
    membership = sets.select("member", "h1", "h2").join(distinct.filter("members > 1").select("h1", "h2", "id"), ["h1", "h2"]).select("member", "id")
    alone = distinct.filter("members = 1").select(F.col("rep").alias("member"), "id")
    return distinct.select("id", "rep", "members", "n", "features"), membership.unionByName(alone)


def similar_classes(distinct: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(a, b): ids of the pairs of distinct sets with a Jaccard similarity of at least `threshold`, each once."""
    spark = distinct.sparkSession
    ship(spark)
    common = spark.sparkContext.broadcast(common_features(distinct))
    keys = distinct.select("id", "features").mapInArrow(_keys(threshold, common), "id bigint, key bigint")
    # Most keys have one set; only the others are kept, counted where they were shuffled to be joined.
    shared = checkpoint(keys.withColumn("sets", F.count("*").over(W.partitionBy("key"))).filter("sets > 1").select("id", "key"))
    sides = [shared.select("key", F.col("id").alias(x)) for x in "ab"]
    pairs = sides[0].join(sides[1], "key").filter("a < b").select("a", "b").distinct()
    first = distinct.select(F.col("id").alias("a"), F.col("features").alias("fa"))
    second = distinct.select(F.col("id").alias("b"), F.col("features").alias("fb"))
    return pairs.join(first, "a").join(second, "b").filter(_similar(F.col("fa"), F.col("fb"), threshold)).select("a", "b")


def similar_members(postings: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(member_a, member_b), member_a < member_b: all pairs of members whose feature sets have that Jaccard similarity.

    Members with equal sets are all paired with one another and with each similar member. Features are compared as 64-bit hashes: sets of some
    dozens of features compare wrongly with a probability under 10^-15. Empty tables, null and blank values and repeated rows are allowed.
    """
    distinct, membership = classes(postings)
    membership = checkpoint(membership)
    links = checkpoint(similar_classes(distinct, threshold))
    twins = membership.join(distinct.filter("members > 1").select("id"), "id")
    within = twins.select("id", F.col("member").alias("a")).join(twins.select("id", F.col("member").alias("b")), "id").filter("a < b")
    x = membership.select(F.col("id").alias("a"), F.col("member").alias("x"))
    y = membership.select(F.col("id").alias("b"), F.col("member").alias("y"))
    across = links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("member_a"), F.greatest("x", "y").alias("member_b"))
    return across.unionByName(within.select(F.col("a").alias("member_a"), F.col("b").alias("member_b")))


def class_links(postings: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(rep_a, rep_b), rep_a < rep_b: the similar pairs between representatives of equal sets, for use where copies needn't be expanded."""
    distinct, _ = classes(postings)
    x = distinct.select(F.col("id").alias("a"), F.col("rep").alias("x"))
    y = distinct.select(F.col("id").alias("b"), F.col("rep").alias("y"))
    links = similar_classes(distinct, threshold).join(x, "a").join(y, "b")
    return links.select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"))


def class_members(postings: DataFrame) -> DataFrame:
    """(member, rep): each member and the smallest member with an equal feature set."""
    distinct, membership = classes(postings)
    return membership.join(distinct.select("id", "rep"), "id").select("member", "rep")
