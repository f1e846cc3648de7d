"""Inverted index and lexical ranking.

An index is written once per snapshot (`freeze`): postings (bucket, term, key, dl, tf, positions), in folders by a hash of the term and sorted by it within each file, and the
corpus statistics, one row. A question reads the folders of its terms alone, with the terms pushed down to the row groups, and
shuffles nothing but their hits. A term of all items is spread over `SPREAD` files, so none is a task of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.functions.text import words
from sedimenta.session import Scratch, checkpoint, ship

K1, B = 1.2, 0.75
#: Folders of an index, and files that the postings of one term are spread over.
BUCKETS, SPREAD = 16, 4


@dataclass(frozen=True)
class Index:
    """A frozen index. postings: (bucket, term, key, dl, tf, at), at: positions from 0; statistics: (n, avgdl), one row; key: the items' key column."""

    postings: DataFrame
    statistics: DataFrame
    key: str

    def hits(self, terms: list[str], *columns: str) -> DataFrame:
        """The postings of the terms: (key, term and other columns), read from the folders they are in."""
        asked = sorted(set(terms))
        found = self.postings.filter(F.col("bucket").isin(sorted({bucket_of(t) for t in asked})) & F.col("term").isin(asked))
        return found.select(self.key, "term", *columns)


def bucket_of(term: str) -> int:
    """The folder of a term: Spark's xxhash64 of it, modulo `BUCKETS`."""
    signed = (xxhash.xxh64_intdigest(term, seed=42) + (1 << 63)) % (1 << 64) - (1 << 63)
    return signed % BUCKETS


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, term, dl, at) of each item and each of its different words, from (key, words)."""
    for b in batches:
        for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
            rows: list[int] = []
            terms: list[str] = []
            sizes: list[int] = []
            places: list[list[int]] = []
            for i, found in enumerate(part.column(1).to_pylist()):
                at: defaultdict[str, list[int]] = defaultdict(list)
                for n, w in enumerate(found):
                    at[w].append(n)
                rows.extend([i] * len(at))
                terms.extend(at)
                sizes.extend([len(found)] * len(at))
                places.extend(at.values())
            columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "term", "dl", "at"])


def freeze(items: DataFrame, key: str, scratch: Scratch, text: str = "text") -> Index:
    """The index of all items with a text, written below the scratch folder. Null texts aren't indexed; a text without words counts with length 0."""
    ship(items.sparkSession)
    split = items.select(F.col(key).alias("key"), words(F.col(text)).alias("w")).filter("w IS NOT NULL")
    kind = dict(split.dtypes)["key"]
    found = split.mapInArrow(_postings, f"key {kind}, term string, dl bigint, at array<int>")
    placed = found.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    spread = F.pmod(F.xxhash64("key"), F.lit(SPREAD))
    ordered = placed.repartition(F.col("bucket"), spread).sortWithinPartitions("bucket", "term")
    postings = scratch.write(ordered.select("bucket", "term", F.col("key").alias(key), "dl", F.size("at").cast("bigint").alias("tf"), "at"), ["bucket"])
    return Index(postings, scratch.write(corpus_statistics(items, text)), key)


def term_index(items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(`key`, term, tf, dl) of each item and each of its words; dl: its length in words."""
    split = items.select(F.col(key), words(F.col(text)).alias("w")).filter("w IS NOT NULL")
    return split.select(key, F.size("w").cast("bigint").alias("dl"), F.explode("w").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def document_frequency(index: DataFrame, key: str) -> DataFrame:
    """(term, df): the number of items with each term. The index has a row per item and term, so counting rows is enough."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def corpus_statistics(items: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """(n, avgdl) of all items with a text, or of each group of `by`: the statistics that ranking is frozen to."""
    counted = items.filter(F.col(text).isNotNull()).select(*(by or []), F.size(words(F.col(text))).alias("dl"))
    return counted.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    """The score of a term in an item; terms in more than half of the items weigh next to nothing."""
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(F.lit(1e-6)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25_scores(index: Index, terms: list[str]) -> DataFrame:
    """(key, term, score) of each item that has a term. The statistics are one row, the frequencies as many as there are terms."""
    hits = index.hits(terms, "dl", "tf")
    scored = hits.join(F.broadcast(document_frequency(hits, index.key)), "term").crossJoin(F.broadcast(index.statistics))
    return scored.select(index.key, "term", bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl")).alias("score"))


def bm25_search(index: Index, terms: list[str], limit: int, require_all: bool = False) -> DataFrame:
    """(key, score, matched) of the best items for any (or all) of the terms; equal scores in the order of the key."""
    key = index.key
    scores = bm25_scores(index, terms).groupBy(key).agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("matched"))
    if require_all:
        scores = scores.filter(F.col("matched") == len(set(terms)))
    return scores.orderBy(F.desc("score"), key).limit(limit)


def phrase_matches(index: Index, phrase: list[str]) -> DataFrame:
    """(key, hits): how often the words of `phrase` follow one another in an item, from their positions. A word that occurs twice in the phrase is read once."""
    wanted = sorted(set(phrase))
    by_term = [F.max(F.when(F.col("term") == t, F.col("at"))).alias(f"_{i}") for i, t in enumerate(wanted)]
    together = index.hits(phrase, "at").groupBy(index.key).agg(F.count("*").alias("_n"), *by_term).filter(F.col("_n") == len(wanted))
    moved = lambda k: lambda x: x - F.lit(k)
    starts = [F.transform(F.col(f"_{wanted.index(t)}"), moved(k)) for k, t in enumerate(phrase)]
    common = starts[0]
    for other in starts[1:]:
        common = F.array_intersect(common, other)
    return together.select(index.key, F.size(common).cast("bigint").alias("hits")).filter("hits > 0")


def literal_hits(items: DataFrame, literal: str, key: str, text: str = "text") -> DataFrame:
    """(`key`, position): each place, counted from 0 in characters, at which the literal stands, overlapping ones included."""
    pieces = F.split(F.col(text), "(?=" + "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in literal) + ")", -1)
    cut = items.filter(F.col(text).contains(literal)).select(F.col(key), pieces.alias("p"), F.col(text).startswith(literal).alias("_at0"))
    running = F.aggregate("p", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x))))
    # Every piece but the first begins at a hit.
    at = cut.select(key, "_at0", F.explode(F.slice(running, 1, F.size("p"))).alias("position"))
    return at.filter("position > 0 OR _at0").select(key, F.col("position").cast("bigint").alias("position"))


def ranked(hits: DataFrame, order: list, by: list[str]) -> DataFrame:
    """`hits` with rank, from 1, by `order` within each group of `by`; the order must leave no ties.

    Hits are range-partitioned by group and order, so a group with a third of them is spread over many tasks; each counts its own, and what
    comes before it is added. The parts are written once, as their borders are drawn from a sample.
    """
    part = checkpoint(hits.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    counts = part.groupBy("_part", *by).agg(F.count("*").alias("_n"))  # as many rows as there are tasks and groups
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", *by, before.alias("_before"))
    own = F.row_number().over(W.partitionBy("_part", *by).orderBy(*order))
    return part.withColumn("_own", own).join(F.broadcast(offsets), ["_part", *by]).withColumn("rank", (F.col("_own") + F.col("_before")).cast("bigint")).drop("_part", "_own", "_before")


def reciprocal_ranks(hits: DataFrame, key: str, order: list, k: int = 60, by: list[str] | None = None) -> DataFrame:
    """`hits` with rank and 1 / (k + rank), by `order` within each group of `by`."""
    if not by:
        return ranked(hits.withColumn("_all", F.lit(0)), order, ["_all"]).drop("_all").withColumn("rr", 1.0 / (k + F.col("rank")))
    return ranked(hits, order, by).withColumn("rr", 1.0 / (k + F.col("rank")))
