"""Append-only ledgers: hash chains, latest states, leases, supersession, schedules."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.session import ship

GENESIS = "0" * 64


def pad(key: str, byte: int) -> str:
    """A key of HMAC-SHA256 as one of its two paddings, in hex."""
    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    return bytes(x ^ byte for x in raw.ljust(64, b"\0")).hex()


def signature(payload: Column, key: str) -> Column:
    """HMAC-SHA256 of a text, in hex, by built-in functions alone."""
    inner = F.unhex(F.sha2(F.concat(F.unhex(F.lit(pad(key, 0x36))), F.encode(payload, "UTF-8")), 256))
    return F.sha2(F.concat(F.unhex(F.lit(pad(key, 0x5C))), inner), 256)


def link_hash(payload: Column, previous: Column) -> Column:
    """The hash that a record of a chain has."""
    return F.sha2(F.concat(previous, F.lit("|"), payload), 256)


def chained(records: DataFrame, by: str, order: str, payload: str) -> DataFrame:
    """`records` (`by`, `order`, `payload`) with prev and hash: the chain that starts at GENESIS in each group. One pass over sorted rows that holds the last hash alone."""
    ship(records.sparkSession)
    rows = records.select(by, order, payload).repartition(by).sortWithinPartitions(by, order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = object(), GENESIS
        for b in batches:
            before, after = [], []
            for g, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if g != group:
                    group, last = g, GENESIS
                before.append(last)
                last = hashlib.sha256(f"{last}|{text}".encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*b.schema.names, "prev", "hash"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    return rows.mapInArrow(fold, f"{kinds}, prev string, hash string")


def chain_breaks(records: DataFrame, by: list[str], order: str, payload: Column, hash_: str, previous: str) -> DataFrame:
    """(`by`, `order`): records whose previous hash isn't that of the record before, or whose own hash is wrong. One window per chain, no recursion."""
    before = F.coalesce(F.lag(hash_).over(W.partitionBy(*by).orderBy(order)), F.lit(GENESIS))
    wrong = (F.col(previous) != before) | (F.col(hash_) != link_hash(payload, F.col(previous)))
    return records.withColumn("_w", wrong).filter("_w").select(*by, order)


def heads(reviews: DataFrame, by: str, order: str, key: str, supersedes: str) -> DataFrame:
    """(`by`, head, linear): the last review of each target, and whether each one superseded the one before it."""
    w = W.partitionBy(by).orderBy(order)
    seen = reviews.withColumn("_ok", F.col(supersedes).eqNullSafe(F.lag(key).over(w)))
    return seen.groupBy(by).agg(F.max_by(key, order).alias("head"), F.bool_and("_ok").alias("linear"))


def lease_states(log: DataFrame, task: str, at: str, order: str, kind: str, now: Column, seconds: int) -> DataFrame:
    """(`task`, state, attempts): from a log of lease, submit and fail events: done, failed, leased while the lease lasts, else open again."""
    last = log.groupBy(task).agg(F.max_by(F.struct(kind, at), F.struct(at, order)).alias("e"), F.count_if(F.col(kind) == "lease").alias("attempts"))
    held = F.col(f"e.{at}").cast("timestamp") + F.expr(f"INTERVAL {seconds} SECONDS") > now
    state = F.when(F.col(f"e.{kind}") == "submit", "done").when(F.col(f"e.{kind}") == "fail", "failed").when(held, "leased").otherwise("open")
    return last.select(task, state.alias("state"), "attempts")


def superseded(jobs: DataFrame, by: str, revision: str) -> DataFrame:
    """`jobs` with current: whether no job of the same group has a later revision."""
    return jobs.withColumn("current", F.col(revision) == F.max(revision).over(W.partitionBy(by)))


def paired_schedule(cases: DataFrame, key: str, repetitions: int, seed: str) -> DataFrame:
    """(`key`, repetition, arm, place): both arms of each case side by side, their order drawn by a hash, pairs in hashed order."""
    runs = cases.select(F.col(key), F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("repetition"))
    drawn = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), "repetition"), 256)
    flip = F.conv(F.substring(drawn, 1, 2), 16, 10).cast("int") % 2
    arms = runs.withColumn("_d", drawn).withColumn("arm", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("place", F.when(F.col("arm") == "a", flip).otherwise(1 - flip).cast("bigint"))
    return arms.select(key, F.col("repetition").cast("bigint").alias("repetition"), "arm", "place")


def journal(intents: DataFrame, results: DataFrame, key: str, status: str) -> DataFrame:
    """(`key`, status): each intent with its result's status; unknown where there is none, which blocks its repetition."""
    last = results.groupBy(key).agg(F.max(status).alias(status))
    return intents.select(key).distinct().join(last, key, "left").select(key, F.coalesce(status, F.lit("unknown")).alias(status))


def covered_once(given: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """(`key`, uses): inputs that a result doesn't use exactly once, and uses of what wasn't an input."""
    uses = used.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("uses"))
    joined = given.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_g", F.lit(1)).join(uses, key, "full")
    return joined.filter("_g IS NULL OR uses IS NULL OR uses != 1").select(key, F.coalesce("uses", F.lit(0)).alias("uses"))
