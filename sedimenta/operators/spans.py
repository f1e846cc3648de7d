"""Operators that need the places of matches in a text, which Spark's own functions don't give: Arrow batches, where the rows lie."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sedimenta.session import ship


def boundary_parts(text: str, size: int) -> list[tuple[int, int]]:
    """Consecutive (start, end) of at most `size` characters: each ends after the last line break in its second half, else after the last end of a sentence, else after a space."""
    out, start = [], 0
    while len(text) - start > size:
        low, high = start + size // 2, start + size
        cut = text.rfind("\n", low, high) + 1
        if cut <= low:
            ends = [m.end() for m in re.finditer(r"[.!?]\s", text[low:high])]
            cut = low + ends[-1] if ends else text.rfind(" ", low, high) + 1
        if cut <= low:
            cut = high
        out.append((start, cut))
        start = cut
    out.append((start, len(text)))
    return out


def locate(text: str, quote: str) -> tuple[int, int] | None:
    """Where a quotation stands in a text if whitespace is of no account; None if it doesn't, or is blank."""
    words = quote.split()
    found = re.search(r"\s+".join(map(re.escape, words)), text) if words else None
    return found.span() if found else None


def folded(text: str | None) -> str | None:
    """NFC and casefolded."""
    return None if text is None else unicodedata.normalize("NFC", text).casefold()


def quotation_scopes(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, speaker) of what stands in quotation marks; speaker: the name before a colon or a verb of saying in front of it."""
    out = []
    for m in re.finditer(r"[\"“„«]([^\"”“»]+)[\"”“»]", text):
        before = re.search(r"([A-Z][\w'-]+(?: [A-Z][\w'-]+)?)(?: (?:said|wrote|says|sagte|schrieb))?\s*[:,]\s*$", text[max(0, m.start() - 80) : m.start()])
        out.append((m.start(1), m.end(1), before[1] if before else None))
    return out


def _mapped(items: DataFrame, key: str, text: str, rows_of, names: list[str], kinds: list[pa.DataType], sql: str) -> DataFrame:
    ship(items.sparkSession)
    source = items.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t is not None:
                    own = rows_of(t)
                    rows.extend(own)
                    at.extend([i] * len(own))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[key, *names])

    return source.mapInArrow(run, f"`{key}` {dict(source.dtypes)[key]}, {sql}")


def parts(items: DataFrame, key: str, size: int, text: str = "text") -> DataFrame:
    """(`key`, char_start, char_end): `boundary_parts` of each text."""
    return _mapped(items, key, text, lambda t: boundary_parts(t, size), ["char_start", "char_end"], [pa.int64()] * 2, "char_start bigint, char_end bigint")


def pattern_spans(items: DataFrame, key: str, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """(`key`, kind, value, start, end): each match of each pattern, the grammar of features."""
    compiled = {k: re.compile(p) for k, p in patterns.items()}
    find = lambda t: [(k, m[0], m.start(), m.end()) for k, p in compiled.items() for m in p.finditer(t)]
    return _mapped(items, key, text, find, ["kind", "value", "start", "end"], [pa.string(), pa.string(), pa.int64(), pa.int64()], "kind string, value string, start bigint, end bigint")


def quotations(items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(`key`, start, end, speaker): `quotation_scopes` of each text."""
    return _mapped(items, key, text, quotation_scopes, ["start", "end", "speaker"], [pa.int64(), pa.int64(), pa.string()], "start bigint, end bigint, speaker string")


def folded_texts(items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(`key`, folded): texts in NFC, casefolded."""
    return _mapped(items, key, text, lambda t: [(folded(t),)], ["folded"], [pa.string()], "folded string")


def compatible_words(items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(`key`, words): the words of each text in NFKC, casefolded, joined by spaces."""
    return _mapped(items, key, text, lambda t: [(" ".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t).casefold())),)], ["words"], [pa.string()], "words string")
