"""Reports and verified tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.text import formula_guard


def write_verified(df: DataFrame, path: str, partition_by: list[str] | None = None, rows_per_file: int = 0) -> int:
    """Write a table, read it again and compare; returns the number of rows. A difference is an error."""
    writer = df.write.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    again = df.sparkSession.read.parquet(path).select(*df.columns)
    if not differences(df, again).isEmpty():
        raise ValueError(f"{path} does not hold what was written")
    return again.count()


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, row): rows of one table that the other lacks, repetitions counted; by hashes of rows, in one shuffle."""
    hashed = lambda df, n: df.select(F.xxhash64(*df.columns).alias("a"), F.hash(*df.columns).alias("b"), F.lit(n).alias("n"))
    both = hashed(left, 1).unionByName(hashed(right.select(*left.columns), -1))
    return both.groupBy("a", "b").agg(F.sum("n").alias("surplus")).filter("surplus != 0")


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV, its texts guarded against being taken for formulas."""
    guarded = [formula_guard(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes]
    df.select(*guarded).write.option("header", "true").option("escape", '"').csv(path)


def write_markdown(df: DataFrame, path: str) -> None:
    """A table's rows as lines of a Markdown table, in files below `path`."""
    cell = lambda c: F.coalesce(F.replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(""))
    df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in df.columns)), F.lit(" |")).alias("value")).write.text(path)


def upserted(stored: DataFrame, loaded: DataFrame, keys: list[str]) -> DataFrame:
    """`stored` with the rows of `loaded` in the place of those with the same keys, and `change`: inserted, updated or kept. Both have the same columns; keys are unique and not null in each."""
    others = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, F.struct(*others).alias("_old"))
    new = loaded.select(*keys, F.struct(*others).alias("_new"))
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").otherwise("updated")
    both = old.join(new, keys, "full").select(*keys, F.coalesce("_new", "_old").alias("_r"), change.alias("change"))
    return both.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in others), "change")
