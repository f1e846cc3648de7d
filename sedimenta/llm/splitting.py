"""Splitting of oversized texts at natural boundaries, by structure-tree packing.

A text is parsed into a tree: sections nested by the level of their headings (`#`, numbers, `<h1>` to `<h6>`), blocks of markup nested by their tags,
paragraphs, list entries nested by their indents, lines; below a line its sentences, words and code points. Packing goes bottom-up: a node within the limit stays
whole; of an oversized node the children are packed, and neighbours among what they give are merged as long as they fit. So only
oversized nodes are descended into, and a piece is a run of sibling subtrees wherever there is one. Each piece after the first begins
with the last `overlap` code points of the one before, so nodes are packed to the limit less the overlap.

Texts are handled row by row in Arrow batches, in time proportional to their length; no shuffle but that which drops repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import ship

LIMIT, OVERLAP = 2000, 150
#: Boundaries from coarse to fine; a section also begins at a heading that no blank line precedes.
KINDS = ("section", "paragraph", "line", "sentence", "word", "none")
#: Nodes of one kind that are nested at most; what is nested deeper stands beside the deepest.
DEEPEST = 50

_HASHES = re.compile(r"[ \t]*(#{1,6})[ \t]+\S")
_NUMBERED = re.compile(r"[ \t]*(?:§[ \t]*)?((?:\d+\.)+\d*|(?<=§)[ \t]*\d+)[ \t]+\S[^\n.]{0,80}\s*$")
_TITLE_TAG = re.compile(r"[ \t]*<h([1-6])\b", re.I)
_OPENS = re.compile(r"[ \t]*<(section|article|div|ul|ol|li|table|tr|blockquote|p|body)\b[^>]*>", re.I)
_CLOSES = re.compile(r"</(section|article|div|ul|ol|li|table|tr|blockquote|p|body)>", re.I)
_ENTRY = re.compile(r"([ \t]*)(?:[-*+•‣◦▪–·]|\(?(?:\d{1,3}|[A-Za-z]|[ivxlcIVXLC]{1,6})[.)])[ \t]+\S")
_SENTENCE = re.compile(r"[.!?]\s+")
_WORD = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    """A part [start, end) of a text. kind: section, block, paragraph, entry, line, or what a line is made of; gap: the boundary before it, of KINDS; depth: level or indent among nodes of its kind."""

    kind: str
    start: int
    gap: str
    depth: int = 0
    end: int = 0
    children: list[Node] = field(default_factory=list)


def _heading(line: str) -> int:
    """The level of a heading, from 1; 0 for another line."""
    if m := _HASHES.match(line):
        return len(m[1])
    if m := _TITLE_TAG.match(line):
        return int(m[1])
    if m := _NUMBERED.match(line):
        return min(1 + m[1].strip().strip(".").count("."), 6)
    return 0


def tree(text: str) -> Node:
    """The structure tree of a text, down to its lines. Blank lines belong to the line before them, at the beginning to the one after."""
    root = Node("section", 0, "none")
    path = [root]

    def close(keep) -> None:
        while len(path) > 1 and not keep(path[-1]):
            path.pop()

    def add(kind: str, depth: int = 0) -> Node:
        node = Node(kind, start, gap if kind != "section" else "section", depth)
        path[-1].children.append(node)
        return node

    at, start, gap, lines = 0, 0, "none", 0
    for line in text.split("\n"):
        here, at = at, at + len(line) + 1
        if not line or line.isspace():
            gap = "paragraph" if lines else "none"
            continue
        start = here if lines else 0
        lines += 1
        level, entry = _heading(line), _ENTRY.match(line)
        if level and not (entry and gap == "line"):
            close(lambda n: n.kind == "section" and n.depth < level)
            path.append(add("section", level))
            add("line")
        else:
            if gap == "paragraph":
                close(lambda n: n.kind in ("section", "block"))
            opened = _OPENS.match(line)
            nested = sum(n.kind == "block" for n in path)
            if opened and nested < DEEPEST and f"</{opened[1].lower()}>" not in line.lower():
                close(lambda n: n.kind in ("section", "block"))
                path.append(add("block", nested))
                add("line")
            else:
                if path[-1].kind in ("section", "block"):
                    path.append(add("paragraph"))
                indent = len(entry[1].expandtabs(4)) if entry else len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
                close(lambda n: n.kind != "entry" or n.depth < indent)
                if entry and sum(n.kind == "entry" for n in path) < DEEPEST:
                    path.append(add("entry", indent))
                add("line")
            for _ in _CLOSES.findall(line) if "</" in line else ():
                if any(n.kind == "block" for n in path) and not (opened and f"</{opened[1].lower()}>" in line.lower()):
                    close(lambda n: n.kind == "block")
                    path.pop()
        gap = "line"
    _finish(root, len(text))
    return root


def _finish(root: Node, end: int) -> None:
    """Set the ends of all nodes: where the next one begins."""
    todo = [(root, end)]
    while todo:
        node, end = todo.pop()
        node.end = end
        for i, child in enumerate(node.children):
            todo.append((child, node.children[i + 1].start if i + 1 < len(node.children) else end))


def _parts(text: str, node: Node) -> list[Node]:
    """The children of a node; of a line its sentences, of a sentence its words, made when they are asked for."""
    if node.children or node.kind not in ("line", "sentence"):
        return node.children
    kind, pattern = ("sentence", _SENTENCE) if node.kind == "line" else ("word", _WORD)
    starts = [node.start, *(m.end() for m in pattern.finditer(text, node.start, node.end) if node.start < m.end() < node.end)]
    parts = [Node(kind, a, kind, 0, b) for a, b in zip(starts, [*starts[1:], node.end], strict=True)]
    parts[0].gap = node.gap
    return parts


def boundary(text: str, root: Node) -> str:
    """The coarsest boundary inside the text, leading and trailing whitespace aside, by its tree: paragraph, line, sentence, word or none."""
    kinds, todo, lines = set(), [root], []
    while todo:
        node = todo.pop()
        todo.extend(node.children)
        if node.kind == "line":
            lines.append(node)
            kinds.add(node.gap)
    for kind in ("paragraph", "line"):
        if kind in kinds:
            return kind
    if lines:
        inner = text.strip()
        only = Node("line", 0, "none", 0, len(inner))
        sentences = _parts(inner, only)
        if len(sentences) > 1:
            return "sentence"
        if len(_parts(inner, sentences[0])) > 1:
            return "word"
    return "none"


def _packed(text: str, node: Node, most: int, used: int = 0) -> list[tuple[int, int, str]]:
    """(start, end, boundary before it) of the runs of nodes below `node` that fit into `most` code points, merged bottom-up; of the first run's room, `used` is taken.

    An oversized node begins a run of its own, so what it is about isn't torn off; a heading stays with the beginning of what it is above.
    """
    if node.end - node.start <= most:
        return [(node.start, node.end, node.gap)]
    parts = _parts(text, node)
    if not parts:
        cuts = [node.start, *range(node.start + most - used, node.end, most)]
        return [(c, end, "none" if i else node.gap) for i, (c, end) in enumerate(zip(cuts, [*cuts[1:], node.end], strict=True))]
    merged: list[tuple[int, int, str]] = []
    for i, part in enumerate(parts):
        whole = part.end - part.start <= most
        titled = i == 1 and node.kind == "section" and node.depth > 0
        taken = used if i == 0 else merged[0][1] - merged[0][0] + used if titled and len(merged) == 1 else 0
        for k, (start, end, gap) in enumerate(_packed(text, part, most, taken)):
            room = most - (used if len(merged) == 1 else 0)
            if merged and (whole or k or titled) and end - merged[-1][0] <= room:
                merged[-1] = (merged[-1][0], end, merged[-1][2])
            else:
                merged.append((start, end, gap if merged else node.gap))
    return merged


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, root: Node | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind of boundary at the end) of each piece; the last one's kind is `end`."""
    runs = [(0, len(text), "none")] if len(text) <= limit else _packed(text, root or tree(text), limit - overlap)
    if len(runs) > 1 and runs[1][1] <= limit:  # the first piece has no overlap
        runs[:2] = [(0, runs[1][1], "none")]
    return [(max(0, start - overlap) if i else 0, end, runs[i + 1][2] if i + 1 < len(runs) else "end") for i, (start, end, _) in enumerate(runs)]


_PIECES = pa.schema(
    [("segment_id", pa.string()), ("piece_no", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("text", pa.string()), ("cut", pa.string()), ("boundary", pa.string())]
)


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for key, text, start in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                root = tree(text)
                kind = boundary(text, root)
                for n, (lo, hi, cut) in enumerate(pieces(text, limit, overlap, root)):
                    rows.append((key, n, None if start is None else start + lo, None if start is None else start + hi, text[lo:hi], cut, kind))
            columns = zip(*rows, strict=True) if rows else [[] for _ in _PIECES]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    return run


def split_segments(segments: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(segment_id, piece_no, char_start, char_end, text, cut, boundary) of each piece of each segment over the limit.

    Pieces have at most `limit` code points, together hold the whole text, and begin with the last `overlap` ones of the piece before. `cut` is the
    boundary at a piece's end (`end` for the last), `boundary` the coarsest one in the segment. Offsets are the document's: from the first
    locator, else from char_start; null where neither is known. A repeated row counts once; null, empty and shorter texts have no
    piece; whitespace is kept as it is.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be from 0 to less than limit")
    ship(segments.sparkSession)
    start = F.coalesce(F.try_element_at("locators", F.lit(1))["start"], F.col("char_start")).cast("bigint")
    large = segments.filter(F.char_length("text") > limit).select("id", "text", start.alias("start")).distinct()
    return large.mapInArrow(_split(limit, overlap), "segment_id string, piece_no int, char_start bigint, char_end bigint, text string, cut string, boundary string")


def oversized_boundaries(segments: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(segment_id, boundary) of each segment over the limit, from its pieces."""
    return split_segments(segments, limit, overlap).filter("piece_no = 0").select("segment_id", "boundary")


def piece_checks(segments: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(segment_id, covered, too_long, wrong_overlap, wrong_text): of each segment over the limit, the code points that its pieces cover without a gap, and how many pieces break a rule."""
    parts = split_segments(segments, limit, overlap)
    start = F.coalesce(F.try_element_at("locators", F.lit(1))["start"], F.col("char_start")).cast("bigint")
    large = segments.filter(F.char_length("text") > limit).select(F.col("id").alias("segment_id"), F.col("text").alias("whole"), F.coalesce(start, F.lit(0)).alias("base")).distinct()
    size = F.char_length("text").cast("bigint")
    listed = F.array_sort(F.collect_list(F.struct("piece_no", "char_start", "char_end", size.alias("size"), "text", "cut")))
    by = parts.withColumns({"char_start": F.coalesce("char_start", F.lit(0)), "char_end": F.coalesce("char_end", size)}).groupBy("segment_id").agg(listed.alias("p"))
    both = by.join(large, "segment_id")
    # Texts are compared at their own places: each piece where the one before it ends, less the overlap.
    step = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("bigint").alias("end"), F.lit("").alias("last"), F.lit(0).alias("bad"), F.lit(0).alias("off")),
        lambda a, x: F.struct(
            (a["end"] + x["size"] - F.when(x["piece_no"] > 0, overlap).otherwise(0)).cast("bigint").alias("end"),
            x["text"].alias("last"),
            (a["bad"] + F.when((x["piece_no"] > 0) & (F.right(a["last"], F.lit(overlap)) != F.substring(x["text"], 1, overlap)), 1).otherwise(0)).alias("bad"),
            (a["off"] + F.when(F.substr("whole", (a["end"] + 1 - F.when(x["piece_no"] > 0, overlap).otherwise(0)).cast("int"), x["size"].cast("int")) != x["text"], 1).otherwise(0)).alias("off"),
        ),
    )
    return both.select("segment_id", "p", step.alias("s")).select(
        "segment_id", F.col("s.end").alias("covered"), F.size(F.filter("p", lambda x: x["size"] > limit)).alias("too_long"), F.col("s.bad").alias("wrong_overlap"), F.col("s.off").alias("wrong_text")
    )
