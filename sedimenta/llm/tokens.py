"""Encoding of texts with a public byte-level BPE tokenizer (tiktoken ranks in a local file).

The rank file is read once on the driver and broadcast (its size does not depend on the data); every Python worker
builds its encoder once. Texts longer than `SPLIT_CHARS` are cut into runs before encoding, only at places where the
tokenizer's own pre-splitting pattern breaks in any context, so the ids are those of the whole text.

Defined results: null and empty texts give an empty list; text that looks like a special token is ordinary text; a
row that is repeated is encoded again, each in its own row; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.session import ship

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-splitting pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT_CHARS = 1 << 16
#: No alternative of the pattern holds a non-space before a space, so a match always ends between them.
_SAFE = re.compile(r"(?<=\S)(?=\s)")
_ENCODERS: dict[str, object] = {}


def read_ranks(path: str = RANK_FILE) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes):
    """The tiktoken encoder of a rank file's content, built once in this process."""
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _ENCODERS:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _ENCODERS[key]


def runs(text: str, limit: int = SPLIT_CHARS) -> Iterator[str]:
    """`text` in consecutive runs of about `limit` characters, cut at safe boundaries alone; longer where there is none."""
    start = 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(enc, text: str | None) -> np.ndarray:
    """Ids of one text as int32."""
    if not text:
        return np.empty(0, np.int32)
    if len(text) <= SPLIT_CHARS:
        return np.array(enc.encode_ordinary(text), np.int32)
    return np.concatenate([np.array(enc.encode_ordinary(r), np.int32) for r in runs(text)])


def decode(enc, ids) -> str:
    """The text of ids: raw bytes of all ids are joined before decoding, as one character may span several ids."""
    return b"".join(enc.decode_tokens_bytes([int(i) for i in ids])).decode("utf-8", errors="replace")


def broadcast_ranks(spark: SparkSession, path: str = RANK_FILE) -> Broadcast:
    ship(spark)
    return spark.sparkContext.broadcast(read_ranks(path))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32()))


def token_ids(df: DataFrame, key: str, text: str | Column = "text", ranks: str = RANK_FILE) -> DataFrame:
    """(`key`, ids ARRAY<INT>) for each row of `df`; no shuffle, texts stay in their partitions."""
    spark = df.sparkSession
    shared = broadcast_ranks(spark, ranks)
    source = df.select(F.col(key), F.col(text).alias("_text") if isinstance(text, str) else text.alias("_text"))

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            column = _lists([encode(enc, t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), column], names=[key, "ids"])

    kind = dict(source.dtypes)[key]
    return source.mapInArrow(ids_of, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str = "text", ranks: str = RANK_FILE) -> DataFrame:
    """(`key`, n_tokens BIGINT) for each row of `df`: as `token_ids`, but only the lengths leave the workers."""
    spark = df.sparkSession
    shared = broadcast_ranks(spark, ranks)
    source = df.select(F.col(key), F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            column = pa.array([len(encode(enc, t)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), column], names=[key, "n_tokens"])

    kind = dict(source.dtypes)[key]
    return source.mapInArrow(count, f"`{key}` {kind}, n_tokens bigint")


def token_texts(df: DataFrame, key: str, ids: str = "ids", ranks: str = RANK_FILE) -> DataFrame:
    """(`key`, text STRING): the inverse of `token_ids`; null ids give null, an empty list the empty text."""
    spark = df.sparkSession
    shared = broadcast_ranks(spark, ranks)
    source = df.select(F.col(key), F.col(ids).alias("_ids"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            column = pa.array([None if x is None else decode(enc, x) for x in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), column], names=[key, "text"])

    kind = dict(source.dtypes)[key]
    return source.mapInArrow(texts, f"`{key}` {kind}, text string")
