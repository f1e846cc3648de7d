"""Text statistics per document, and the shape of its lines by a hidden Markov model.

Each non-blank line is a step, its state prose, list, table or junk. What is observed of a line are yes/no statistics (an enumeration mark, cells
between delimiters, common words, odd symbols, repeated words, whether a wrapped line would have taken the next word, ...); a state gives each
a probability, and neighbouring lines tend to have the same state. The likeliest path labels the lines, and a document has the shape that
most of its characters have. The probabilities are fitted to the corpus: starting from rough ones (`START`), the lines of at most `SAMPLE` documents
are labelled and the probabilities counted again, with the rough ones as a prior, until the labels stay (Viterbi training).

Rows are handled where they lie, without a shuffle; the list of common words (a fixed table) is sent to the workers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.hmm import viterbi
from sedimenta.session import ship

STATES = ("prose", "list", "table", "junk")
#: Probability that a line has the state of the line before.
STAY = 0.9
#: Most documents the model is fitted to, drawn by a hash of key and text; longer ones than so many characters aren't drawn.
SAMPLE, LONGEST = 1000, 50_000
#: Lines that the rough probabilities count for, and rounds of fitting at most.
PRIOR, ROUNDS = 400.0, 10
#: Most rows of the table of common words, which is sent to each worker.
MAX_COMMON = 100_000

_WORD = re.compile(r"[^\W\d_]+")
_MARK = re.compile(r"\s*(?:[-*+•‣◦▪–—·☐☑☒✓✔□■►]|\(?(?:\d{1,3}|[A-Za-z]|[ivxlcIVXLC]{1,6})[.)])\s+\S")
_RULE = re.compile(r"[\s|+:=_-]{3,}")
_GAP = re.compile(r"\s{2,}")
_SYMBOL = re.compile(r"[^\w\s]|_")
#: Symbols as texts have them; others are odd.
_ORDINARY = frozenset(".,;:!?'\"’‘“”„«»()/|+*&%€$#§–—…•☐-")
_CODE = frozenset("{}[]<>=\\^~&%;|")
_ESCAPE = frozenset("\\&%=#")
_SENTENCE_END = (".", "!", "?", "…", ":", ";", "。", "！", "？", ".”", '."', ".»")
_ENTRY_END = re.compile(r"(?:(?<!\S)[^\s\d]*\d+[^\s.]*|\d ?x)$")

#: Of each state, a rough probability of each statistic; in the order of STATES.
START = {
    "mark": (0.02, 0.6, 0.03, 0.01),
    "cells": (0.01, 0.01, 0.95, 0.03),
    "border": (0.005, 0.005, 0.15, 0.02),
    "common": (0.9, 0.06, 0.03, 0.03),
    "rich": (0.6, 0.01, 0.005, 0.01),
    "short": (0.12, 0.9, 0.3, 0.15),
    "brief": (0.1, 0.75, 0.3, 0.15),
    "broken": (0.12, 0.85, 0.85, 0.3),
    "ended": (0.45, 0.03, 0.02, 0.05),
    "entry": (0.02, 0.45, 0.25, 0.01),
    "odd": (0.003, 0.003, 0.01, 0.75),
    "noisy": (0.01, 0.08, 0.1, 0.6),
    "code": (0.005, 0.005, 0.05, 0.55),
    "mixed": (0.001, 0.01, 0.02, 0.08),
    "unbroken": (0.003, 0.003, 0.003, 0.3),
    "repeated": (0.002, 0.004, 0.02, 0.3),
    "wordless": (0.01, 0.1, 0.3, 0.7),
}
_TRANSITION = np.log(np.where(np.eye(len(STATES), dtype=bool), STAY, (1 - STAY) / (len(STATES) - 1)))


def _cells(line: str) -> bool:
    """Whether the line is a row of at least two or three short cells, delimited or aligned."""
    for mark, least in (("\t", 2), ("|", 2), (";", 3), (",", 3)):
        n = line.count(mark)
        if n + 1 < least:
            continue
        cells = line.strip("|").split(mark) if mark == "|" else line.split(mark)
        if len(cells) < least or len(line) > 24 * len(cells):
            continue
        if mark in ",;" and line.count(mark + " ") * 2 > n:
            continue
        return max(map(len, cells)) <= 60
    bare = line.strip()
    if "  " not in bare and "\t" not in bare:
        return False
    cells = _GAP.split(bare)
    return len(cells) >= 2 and max(map(len, cells)) <= (40 if len(cells) >= 3 else 20)


def line_features(lines: list[str], common: frozenset[str]) -> tuple[np.ndarray, list[int]]:
    """Of the non-blank lines of a text: [lines, statistics], as 0 and 1 in the order of START; and sums over them: words, letters in words,
    common words, symbols, characters that aren't whitespace."""
    width = max(map(len, lines), default=0)
    out = np.zeros((len(lines), len(START)), bool)
    sums = [0] * 5
    for i, line in enumerate(lines):
        bare = line.strip()
        words = _WORD.findall(bare.lower())
        tokens = bare.split()
        symbols = _SYMBOL.findall(bare)
        n, filled, marks = len(words), sum(map(len, tokens)), len(symbols)
        every = sum(map(common.__contains__, words))
        known = every - sum(len(w) == 1 and w in common for w in words) if every else 0
        border = n == 0 and _RULE.fullmatch(bare) is not None
        cells = not border and known * 3 <= max(n, 3) and _cells(line)
        odd = code = 0
        if marks >= 0.08 * filled:
            odd = sum(c not in _ORDINARY for c in symbols)
            code = sum(map(_CODE.__contains__, symbols))
            cells = cells and sum(map(_ESCAPE.__contains__, symbols)) < 0.1 * filled
        row = cells or border
        longest = max(map(len, tokens))
        following = lines[i + 1].split(None, 1)[0] if i + 1 < len(lines) else None
        fits = following is not None and len(line.rstrip()) + 1 + len(following) <= width
        last = bare[-1] in ".!?…"
        # What an entry says may well be sentences: that it is marked counts, not how it reads.
        marked = _MARK.match(line) is not None
        out[i] = (
            marked,
            cells,
            border,
            not marked and n > 0 and known >= 0.12 * n and (n >= 4 or known * 2 >= n),
            not marked and n >= 7 and known >= 0.1 * n,
            marked or n <= 6,
            marked or len(bare) <= 45,
            (marked or fits) and not last,
            last and not marked,
            _ENTRY_END.search(bare[-24:]) is not None,
            odd >= 0.08 * filled and not border and odd > 0,
            not row and marks >= 0.15 * filled,
            not row and code >= 0.08 * filled and code > 0,
            not cells and 2 * sum(t.isalnum() and not t.isalpha() and not t.isdigit() for t in tokens) >= max(len(tokens), 4),
            not row and longest >= 34 and longest * 2 > filled and not bare[:8].lower().startswith(("http", "www.")),
            len(tokens) >= 6 and len(set(tokens)) <= 0.3 * len(tokens),
            known == 0 and filled >= 30 and not border,
        )
        sums[0] += n
        sums[1] += sum(map(len, words))
        sums[2] += every
        sums[3] += marks
        sums[4] += filled
    return out, sums


_COLUMNS = [("n_words", pa.int64()), ("mean_word_length", pa.float64()), ("symbol_ratio", pa.float64()), ("end_punctuation", pa.float64()), ("common_share", pa.float64())] + [
    (f"{s}_share", pa.float64()) for s in STATES
] + [("shape", pa.string())]


def _start() -> np.ndarray:
    return np.array(list(START.values()))


def _scores(seen: np.ndarray, likelihood: np.ndarray) -> np.ndarray:
    yes, no = np.log(likelihood), np.log1p(-likelihood)
    return seen @ (yes - no) + no.sum(axis=0)


def fit(texts: list[str], common: frozenset[str]) -> np.ndarray:
    """[statistics, states]: the probabilities fitted to the lines of texts; without texts the rough ones."""
    lines = [[x for x in t.split("\n") if x and not x.isspace()] for t in texts]
    seen = np.concatenate([np.zeros((0, len(START)), bool), *(line_features(x, common)[0] for x in lines)])
    lengths = np.array([len(x) for x in lines], np.int64)
    prior = likelihood = _start()
    labels = None
    for _ in range(ROUNDS if len(seen) else 0):
        before, labels = labels, viterbi(_scores(seen, likelihood), lengths, _TRANSITION)
        if before is not None and (before == labels).all():
            break
        is_state = labels[:, None] == np.arange(len(STATES))
        likelihood = (seen.T.astype(float) @ is_state + prior * PRIOR) / (is_state.sum(axis=0) + PRIOR)
    return likelihood


def statistics(texts: list[str | None], common: frozenset[str], likelihood: np.ndarray | None = None) -> list[tuple]:
    """The columns after the key of `text_statistics`, of each text."""
    likelihood = _start() if likelihood is None else likelihood
    lines = [[x for x in t.split("\n") if x and not x.isspace()] if t else [] for t in texts]
    found = [line_features(x, common) for x in lines]
    seen = np.concatenate([np.zeros((0, len(START)), bool), *(f for f, _ in found)])
    states = viterbi(_scores(seen, likelihood), np.array([len(x) for x in lines]), _TRANSITION)
    out: list[tuple] = []
    at = 0
    for text, own, (_, (n, letters, known, symbols, filled)) in zip(texts, lines, found, strict=True):
        mine = states[at : at + len(own)]
        at += len(own)
        if not own:
            out.append((0, *[None] * 8, None if text is None else "blank"))
            continue
        size = np.bincount(mine, weights=[len(x.strip()) for x in own], minlength=len(STATES))
        ended = sum(x.rstrip().endswith(_SENTENCE_END) for x in own)
        shares = (size / size.sum()).tolist()
        out.append((n, letters / n if n else None, symbols / filled, ended / len(own), known / n if n else None, *shares, STATES[int(size.argmax())]))
    return out


def common_words(words: DataFrame) -> frozenset[str]:
    """The distinct lower-case words of the table; it is small by definition, and a larger one is refused."""
    rows = words.filter("word IS NOT NULL").select(F.lower("word").alias("word")).distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    return frozenset(r.word for r in rows)


def sample(documents: DataFrame, key: str, text: str, n: int = SAMPLE) -> list[str]:
    """At most `n` texts, drawn by a hash: the same ones whatever the partitions."""
    usable = documents.filter(F.col(text).isNotNull() & (F.length(text) <= LONGEST)).select(F.col(text).alias("_text"), F.xxhash64(key, text).alias("_drawn"))
    total = documents.count()
    drawn = usable.filter(F.col("_drawn") / F.lit(2.0**63) < -1 + 4.0 * n / max(total, 1))
    return [r["_text"] for r in drawn.orderBy("_drawn", "_text").limit(n).select("_text").collect()]


def text_statistics(documents: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row: `key`, n_words, mean_word_length, symbol_ratio (symbols among non-space characters), end_punctuation (share of non-blank lines),
    common_share (of words), the shares of characters in prose, list, table and junk lines, and shape: the largest of these.

    Words are runs of letters. A blank text has no words, null ratios and the shape `blank`, a null text the shape null; of equal shares
    the first in the order prose, list, table, junk counts. Repeated rows are kept.
    """
    ship(documents.sparkSession)
    common = common_words(words)
    shared = documents.sparkSession.sparkContext.broadcast((common, fit(sample(documents, key, text), common)))
    source = documents.select(F.col(key), F.col(text).alias("_text"))
    names = [key, *(n for n, _ in _COLUMNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                rows = statistics(part.column(1).to_pylist(), *shared.value)
                columns = [pa.array(list(c), t) for c, (_, t) in zip(zip(*rows, strict=True), _COLUMNS, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    kinds = ", ".join(f"{n} {'string' if t == pa.string() else 'bigint' if t == pa.int64() else 'double'}" for n, t in _COLUMNS)
    return source.mapInArrow(run, f"`{key}` {dict(source.dtypes)[key]}, {kinds}")


def unnatural(documents: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, shape) of each document that is neither blank nor natural prose."""
    shapes = text_statistics(documents, words)
    return shapes.filter("shape IN ('list', 'table', 'junk')").select("doc_id", "shape").distinct()
