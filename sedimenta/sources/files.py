"""Folders of files as tables: inventory, content kinds, and the text sections of many formats.

Files are read with Spark's binary source, so listing and reading are spread over the cluster; parsing runs in Arrow batches where the bytes are.
Each original has a budget of bytes, members and depth for what is unpacked from it.
"""

from __future__ import annotations

import bz2
import csv
import email
import email.policy
import gzip
import io
import json
import lzma
import re
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.session import ship

MAX_DEPTH, MAX_MEMBERS, MAX_BYTES = 8, 10_000, 256 << 20

#: First bytes of file kinds.
MAGIC = {"pdf": "25504446", "zip": "504B0304", "gzip": "1F8B", "png": "89504E47", "jpeg": "FFD8FF", "bzip2": "425A68", "xz": "FD377A585A00", "rtf": "7B5C727466", "ole": "D0CF11E0A1B11AE1", "7z": "377ABCAF271C"}


def _load(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder. Spark's reader passes over empty ones; the list of files that the driver holds for it has them too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = lambda p: re.sub(r"^([a-z0-9]+):/+", r"\1:/", unquote(p))
    paths = spark.createDataFrame([(plain(p),) for p in files.inputFiles()], "path string")
    seen = files.select(F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/").alias("path"))
    empty = paths.join(seen, "path", "left_anti").select(
        "path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("bigint").alias("length"), F.lit(b"").alias("content")
    )
    return files.unionByName(empty)


def inventory(spark: SparkSession, root: str, excluded: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(path, name, suffix, length, modified, sha256, status) of all files below a folder.

    excluded: shell patterns of names. Files above `limit` bytes keep their row with the status `too large`; empty ones are `empty`.
    """
    files = _load(spark, root)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("name", name)
    for pattern in excluded or []:
        files = files.filter(~F.col("name").rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"))
    too_large = F.col("length") > limit if limit is not None else F.lit(False)
    status = F.when(too_large, "too large").when(F.col("length") == 0, "empty").otherwise("ready")
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    return files.select("path", "name", suffix.alias("suffix"), "length", F.col("modificationTime").alias("modified"), F.when(~too_large, F.sha2("content", 256)).alias("sha256"), status.alias("status"))


def kind(content: Column) -> Column:
    """The kind of a file by its first bytes: a name of MAGIC, `utf-16`, or `text` if it has no null byte; else `binary`."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.when(F.instr(F.hex(F.substring(content, 1, 512)), "00") % 2 == 1, "binary").otherwise("text")
    out = F.when(head.startswith("FFFE") | head.startswith("FEFF"), "utf-16").otherwise(out)
    for k, magic in MAGIC.items():
        out = F.when(head.startswith(magic), k).otherwise(out)
    return out


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status) of two inventories: added, removed, changed or same."""
    a, b = before.select("path", F.col("sha256").alias("a"), F.lit(1).alias("x")), now.select("path", F.col("sha256").alias("b"), F.lit(1).alias("y"))
    j = a.join(b, "path", "full")
    status = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return j.select("path", status.alias("status"))


Section = tuple[str, str]  # kind, text


def decode(data: bytes) -> str:
    """Text of bytes: by byte order mark, else UTF-8, else Windows-1252 with what that lacks replaced."""
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(encoding, errors="replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", errors="replace")


class _Visible(HTMLParser):
    """The text of a page, with line breaks at blocks."""

    BLOCKS = frozenset("p div br li ul ol table tr h1 h2 h3 h4 h5 h6 section article header footer".split())
    HIDDEN = frozenset("script style template noscript".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs) -> None:
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag) -> None:
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.parts.append(data)


def html_text(text: str) -> str:
    """What a page shows, without scripts and styles; blank lines and spaces collapsed."""
    page = _Visible()
    page.feed(text)
    page.close()
    lines = (" ".join(x.split()) for x in "".join(page.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def rtf_text(text: str) -> str:
    """The text of RTF: control words dropped, paragraphs as lines, escaped characters resolved."""
    text = re.sub(r"\{\\\*[^{}]*\}|\{\\(?:fonttbl|colortbl|stylesheet|info)(?:[^{}]|\{[^{}]*\})*\}", "", text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), text)
    return re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", text).strip()


def ics_text(text: str) -> str:
    """Calendar lines, folded ones joined again."""
    return re.sub(r"\r?\n[ \t]", "", text)


def _plain(data: bytes) -> list[Section]:
    return [("text", decode(data))]


def _delimited(mark: str) -> Callable[[bytes], list[Section]]:
    return lambda data: [("row", json.dumps(row, ensure_ascii=False)) for row in csv.reader(io.StringIO(decode(data)), delimiter=mark)]


def _texts(root: ElementTree.Element, name: str) -> str:
    return "".join(e.text or "" for e in root.iter() if e.tag.rpartition("}")[2] == name)


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if z.getinfo(name).file_size > MAX_BYTES:
        raise ValueError(f"{name} is too large")
    return ElementTree.fromstring(z.read(name))


def _docx(data: bytes) -> list[Section]:
    """Paragraphs with their headings' level, and cells of tables as rows."""
    out: list[Section] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _part(z, "word/document.xml")
        local = lambda e: e.tag.rpartition("}")[2]
        inside = {p for t in body.iter() if local(t) == "tbl" for p in t.iter() if local(p) == "p"}
        for e in body.iter():
            if local(e) == "tr":
                out.append(("row", json.dumps([_texts(c, "t") for c in e if local(c) == "tc"], ensure_ascii=False)))
            elif local(e) == "p" and e not in inside and (text := _texts(e, "t")):
                style = next((v for s in e.iter() if local(s) == "pStyle" for k, v in s.attrib.items() if k.endswith("val")), "")
                out.append(("heading" if style.lower().startswith("heading") else "paragraph", text))
    return out


def _xlsx(data: bytes) -> list[Section]:
    """Each row of each sheet: values, with formulas after an equals sign."""
    out: list[Section] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [_texts(s, "t") for s in _part(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for row in (e for e in _part(z, name).iter() if e.tag.endswith("}row")):
                cells = []
                for c in row:
                    value, formula = _texts(c, "v"), _texts(c, "f")
                    value = shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else _texts(c, "t") if c.get("t") == "inlineStr" else value
                    cells.append(f"{value} (={formula})" if formula else value)
                out.append(("row", json.dumps(cells, ensure_ascii=False)))
    return out


def _parts(pattern: str, *tags: str) -> Callable[[bytes], list[Section]]:
    """A reader of zipped XML: one section for each part that matches."""

    def read(data: bytes) -> list[Section]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            found = []
            for name in sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]):
                if name.endswith("html"):
                    found.append(("part", html_text(decode(z.read(name)))))
                    continue
                root = _part(z, name)
                lines = ["".join(p.itertext()) for p in root.iter() if p.tag.rpartition("}")[2] in tags]
                found.append(("part", "\n".join(x for x in lines if x)))
            return found

    return read


READERS: dict[str, Callable[[bytes], list[Section]]] = {
    **dict.fromkeys(("txt", "md", "log", "json", "xml", "yaml", "yml", "py", "sql", "ini", "toml", "js", "ts", "css"), _plain),
    "csv": _delimited(","),
    "tsv": _delimited("\t"),
    **dict.fromkeys(("html", "htm", "xhtml"), lambda data: [("text", html_text(decode(data)))]),
    "rtf": lambda data: [("text", rtf_text(decode(data)))],
    "ics": lambda data: [("text", ics_text(decode(data)))],
    "docx": _docx,
    "xlsx": _xlsx,
    "pptx": _parts(r"ppt/slides/slide\d+\.xml", "p"),
    **dict.fromkeys(("odt", "ods", "odp"), _parts(r"content\.xml", "p", "h")),
    "epub": _parts(r".*\.x?html", "p"),
}


def _unpack(name: str, data: bytes) -> Iterator[tuple[str, bytes | None, str]]:
    """(name, content, why not) of each member of an archive, or of the one content of a compressed file: what can't be read has no content but a reason."""
    low = name.lower()
    large = f"larger than {MAX_BYTES} bytes"
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    why = "encrypted" if i.flag_bits & 1 else large if i.file_size > MAX_BYTES else ""
                    yield i.filename, None if why else z.read(i), why
    elif low.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if not m.isdir():
                    why = "not a regular file" if not m.isfile() else large if m.size > MAX_BYTES else ""
                    yield m.name, None if why else t.extractfile(m).read(), why
    else:
        opener = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}[low.rpartition(".")[2]]
        with opener(io.BytesIO(data)) as f:
            content = f.read(MAX_BYTES + 1)
            yield name.rpartition(".")[0], None if len(content) > MAX_BYTES else content, large if len(content) > MAX_BYTES else ""


#: Numbers of AppleDouble entries.
APPLE_ENTRIES = {1: "data fork", 2: "resource fork", 3: "real name", 4: "comment", 8: "dates", 9: "finder info", 10: "macintosh info", 14: "afp short name"}
ARCHIVES = ("zip", "tar", "gz", "tgz", "bz2", "xz")


def appledouble(data: bytes) -> list[Section]:
    """Entries of an AppleDouble file (`._name`): kinds and sizes, and the comment and real name as text."""
    magic, _, _, count = struct.unpack(">II16sH", data[:26])
    if magic != 0x00051607:
        raise ValueError("not AppleDouble")
    out: list[Section] = []
    for i in range(count):
        entry, start, size = struct.unpack(">III", data[26 + 12 * i : 38 + 12 * i])
        if start + size > len(data):
            raise ValueError("an entry ends beyond the file")
        kind = APPLE_ENTRIES.get(entry, f"entry {entry}")
        text = data[start : start + size].decode("utf-8", errors="replace") if entry in (3, 4) else str(size)
        out.append((kind, text))
    return out


def _mail(data: bytes) -> tuple[list[Section], list[tuple[str, bytes]]]:
    """Headers and text of an e-mail, and its attachments."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    out: list[Section] = [("header", f"{k}: {message[k]}") for k in ("From", "To", "Date", "Message-ID", "In-Reply-To", "References", "Subject") if message[k]]
    attached = []
    for part in message.walk():
        if part.is_multipart() and part.get_content_type() != "message/rfc822":
            continue
        content = part.get_payload(decode=True)
        if part.get_content_type() == "message/rfc822":
            attached.append((part.get_filename() or "message.eml", part.get_payload(0).as_bytes()))
        elif part.get_filename():
            attached.append((part.get_filename(), content or b""))
        elif part.get_content_type() == "text/plain":
            out.append(("mime_body", decode(content or b"")))
        elif part.get_content_type() == "text/html":
            out.append(("mime_body", html_text(decode(content or b""))))
    return out, attached


Row = tuple[str, int, str | None, str, str | None, str]  # part, ordinal, kind, text, status, warning


def read_file(name: str, data: bytes) -> list[tuple[str, int, str, str, str, str]]:
    """(part, ordinal, kind, text, status, warning) of a file and everything in it; part: the path of members, empty for the file itself.

    A file or member that can't be read, is encrypted or too large has one row with the status failed; one of an unknown format is unsupported, an empty one empty.
    """
    out: list[tuple[str, int, str, str, str, str]] = []
    budget = {"members": MAX_MEMBERS, "bytes": MAX_BYTES}

    def visit(part: str, name: str, data: bytes, depth: int) -> None:
        budget["members"] -= 1
        budget["bytes"] -= len(data)
        if depth > MAX_DEPTH or min(budget.values()) < 0:
            out.append((part, 0, "", "", "failed", "budget of the original is used up"))
            return
        suffix = name.lower().rpartition(".")[2]
        if not data:
            out.append((part, 0, "", "", "empty", ""))
            return
        try:
            members: Iterator | list[tuple[str, bytes | None, str]] = []
            if name.rpartition("/")[2].startswith("._"):
                sections = appledouble(data)
            elif suffix == "eml":
                sections, attached = _mail(data)
                members = [(n, x, "") for n, x in attached]
            elif suffix in ARCHIVES:
                sections, members = [], _unpack(name, data)
            elif suffix in READERS:
                sections = READERS[suffix](data)
            else:
                out.append((part, 0, "", "", "unsupported", ""))
                return
            out.extend((part, n, kind, text, "ready", "") for n, (kind, text) in enumerate(sections))
            for member, content, why in members:
                if content is None:
                    out.append((f"{part}/{member}".lstrip("/"), 0, "", "", "failed", why))
                elif member.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", member):
                    out.append((f"{part}/{member}".lstrip("/"), 0, "", "", "failed", "unsafe path"))
                else:
                    visit(f"{part}/{member}".lstrip("/"), member, content, depth + 1)
        except Exception as e:  # whatever a damaged file makes a parser raise
            out.append((part, 0, "", "", "failed", f"{type(e).__name__}: {e}"[:200]))

    visit("", name, data, 0)
    return out


_SECTIONS = "path string, part string, ordinal int, kind string, text string, status string, warning string"


def sections(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """(path, part, ordinal, kind, text, status, warning) of all files below a folder, archives and attachments unpacked."""
    ship(spark)
    files = _load(spark, root).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "part", "ordinal", "kind", "text", "status", "warning"]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 4]
        for b in batches:
            for i in range(b.num_rows):
                path = b.column(0)[i].as_py()
                rows = [(path, *r) for r in read_file(path.rpartition("/")[2], b.column(1)[i].as_py() or b"")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

    return (files.repartition(partitions) if partitions else files).mapInArrow(run, _SECTIONS)
