"""Readers of files, inventories and sinks."""

import gzip
import io
import json
import struct
import tarfile
import zipfile
from collections import deque

import pytest

from sedimenta.sources import files, sinks


def zipped(members, mode=zipfile.ZIP_DEFLATED):
    """The bytes of a ZIP archive with these members, in order."""
    with io.BytesIO() as target:
        archive = zipfile.ZipFile(target, mode="w", compression=mode)
        deque((archive.writestr(*member) for member in members.items()), maxlen=0)
        archive.close()
        return target.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = zipped({
    "xl/sharedStrings.xml": '<sst xmlns="x"><si><t>name</t></si></sst>',
    "xl/worksheets/sheet1.xml": '<worksheet xmlns="x"><sheetData><row><c t="s"><v>0</v></c><c><v>3</v><f>1+2</f></c></row></sheetData></worksheet>',
})
EML = b"From: a@b.c\r\nTo: d@e.f\r\nSubject: Hi\r\nMessage-ID: <1@x>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain\r\n\r\nBody text\r\n--q\r\nContent-Type: text/csv; name=t.csv\r\nContent-Disposition: attachment; filename=t.csv\r\n\r\na,b\r\n--q--\r\n"


@pytest.mark.parametrize(
    ("name", "data", "want"),
    [
        ("a.txt", "Grüße".encode(), [("text", "Grüße")]),
        ("a.txt", "Grüße".encode("utf-16"), [("text", "Grüße")]),
        ("a.txt", "Grüße".encode("cp1252"), [("text", "Grüße")]),
        ("a.csv", b'x,"y, z"\n1,2\n', [("row", '["x", "y, z"]'), ("row", '["1", "2"]')]),
        ("a.html", b"<p>One<script>x()</script> &amp; two</p><style>p{}</style><ul><li>three</ul>", [("text", "One & two\nthree")]),
        ("a.rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}\b Bold\b0  caf\'e9\par next}", [("text", "Bold café\nnext")]),
        ("a.ics", b"SUMMARY:long\r\n  line\r\n", [("text", "SUMMARY:long line\r\n")]),
        ("a.docx", DOCX, [("heading", "Title"), ("paragraph", "Some text"), ("row", '["a", "b"]')]),
        ("a.xlsx", XLSX, [("row", '["name", "3 (=1+2)"]')]),
        ("a.pptx", zipped({"ppt/slides/slide2.xml": "<s xmlns='x'><p>two</p></s>", "ppt/slides/slide1.xml": "<s xmlns='x'><p>one</p></s>"}), [("part", "one"), ("part", "two")]),
        ("a.odt", zipped({"content.xml": "<d xmlns='x'><h>H</h><p>P<i>!</i></p></d>"}), [("part", "H\nP!")]),
        ("a.epub", zipped({"c1.xhtml": "<p>chapter</p>"}), [("part", "chapter")]),
    ],
)
def test_readers(name, data, want):
    assert [(kind, text) for _, _, kind, text, status, _ in files.read_file(name, data)] == want


def test_mail_and_archives_are_unpacked():
    rows = files.read_file("m.eml", EML)
    assert [(r[0], r[2], r[3].strip()) for r in rows] == [("", "header", "From: a@b.c"), ("", "header", "To: d@e.f"), ("", "header", "Message-ID: <1@x>"), ("", "header", "Subject: Hi"), ("", "mime_body", "Body text"), ("t.csv", "row", '["a", "b"]')]
    inner = zipped({"in.txt": "deep", "../out.txt": "no", "e.txt": ""})
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("d/inner.zip")
        info.size = len(inner)
        t.addfile(info, io.BytesIO(inner))
    got = {r[0]: (r[3], r[4]) for r in files.read_file("x.tar.gz", tar.getvalue())}
    assert got == {"d/inner.zip/in.txt": ("deep", "ready"), "d/inner.zip/../out.txt": ("", "failed"), "d/inner.zip/e.txt": ("", "empty")}
    assert [r[3] for r in files.read_file("a.txt.gz", gzip.compress(b"packed"))] == ["packed"]
    nested = b"core"
    for _ in range(12):
        nested = zipped({"n.zip": nested})
    assert [r[4] for r in files.read_file("n.zip", nested)] == ["failed"]


def test_damaged_unknown_and_empty_files():
    assert [r[4] for r in files.read_file("a.docx", b"no zip")] == ["failed"]
    assert [r[4] for r in files.read_file("a.xyz", b"?")] == ["unsupported"]
    assert [r[4] for r in files.read_file("a.txt", b"")] == ["empty"]


def test_folder(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("Case: 123")
    (root / "sub" / "b.csv").write_text("x,y\n1,2\n")
    (root / "empty.md").write_text("")
    (root / "skip.tmp").write_text("x")
    (root / "p.pdf").write_bytes(b"%PDF-1.4")
    inventory = files.inventory(spark, str(root), ["*.tmp"], limit=8)
    got = {r.name: (r.suffix, r.status, r.sha256 is None) for r in inventory.collect()}
    assert got == {"a.txt": ("txt", "too large", True), "b.csv": ("csv", "ready", False), "empty.md": ("md", "empty", False), "p.pdf": ("pdf", "ready", False)}
    sections = {(r.path.rpartition("/")[2], r.ordinal): (r.kind, r.text, r.status) for r in files.sections(spark, str(root)).collect()}
    assert sections["a.txt", 0] == ("text", "Case: 123", "ready") and sections["b.csv", 1] == ("row", json.dumps(["1", "2"]), "ready")
    assert sections["p.pdf", 0][2] == "unsupported" and sections["empty.md", 0][2] == "empty"
    before = files.inventory(spark, str(root)).cache()
    before.count()
    (root / "a.txt").write_text("Case: 124")
    (root / "new.txt").write_text("n")
    (root / "skip.tmp").unlink()
    after = {r.path.rpartition("/")[2]: r.status for r in files.changes(before, files.inventory(spark, str(root))).collect()}
    assert after == {"a.txt": "changed", "new.txt": "added", "skip.tmp": "removed", "b.csv": "same", "empty.md": "same", "p.pdf": "same"}


def test_kinds(spark):
    from pyspark.sql import functions as F

    rows = [(bytearray(b"%PDF-1.4"),), (bytearray(b"PK\x03\x04aa"),), (bytearray("x".encode("utf-16")),), (bytearray(b"plain"),), (bytearray(b""),)]
    assert [r.k for r in spark.createDataFrame(rows, "c binary").select(files.kind(F.col("c")).alias("k")).collect()] == ["pdf", "zip", "utf-16", "text", "text"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1"), (2, "a|b\nc"), (3, None)], "k int, t string")
    assert sinks.write_verified(df, str(tmp_path / "t"), ["k"]) == 3
    assert sinks.differences(df, df.filter("k > 1")).count() == 1 and sinks.differences(df, df).isEmpty()
    sinks.write_csv(df, str(tmp_path / "c"))
    assert {r.t for r in spark.read.option("header", "true").option("multiLine", "true").csv(str(tmp_path / "c")).collect()} == {"'=1+1", "a|b\nc", None}
    sinks.write_markdown(df, str(tmp_path / "m"))
    assert {r.value for r in spark.read.text(str(tmp_path / "m")).collect()} == {"| 1 | =1+1 |", "| 2 | a\\|b c |", "| 3 |  |"}


def test_every_member_has_a_row_with_what_became_of_it(monkeypatch):
    monkeypatch.setattr(files, "MAX_BYTES", 1000)
    secret = bytearray(zipped({"a.txt": b"x", "b.txt": b"y"}, zipfile.ZIP_STORED))
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        secret[secret.index(mark) + at] |= 1  # the first member says that it is encrypted
    rows = {r[0]: (r[4], r[5]) for r in files.read_file("s.zip", bytes(secret))}
    assert rows["a.txt"] == ("failed", "encrypted") and rows["b.txt"][0] == "ready"
    rows = {r[0]: (r[4], r[5]) for r in files.read_file("l.zip", zipped({"big.txt": b"z" * 1001, "ok.txt": b"z"}))}
    assert rows["big.txt"] == ("failed", "larger than 1000 bytes") and rows["ok.txt"][0] == "ready"
    rows = files.read_file("x.txt.gz", gzip.compress(b"z" * 1001))
    assert [(r[0], r[4], r[5]) for r in rows] == [("x.txt", "failed", "larger than 1000 bytes")]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    monkeypatch.setattr(files, "MAX_BYTES", 1 << 20)
    assert [(r[0], r[4], r[5]) for r in files.read_file("t.tar", out.getvalue())] == [("link", "failed", "not a regular file")]


def test_appledouble():
    note = "Seen by Ann".encode()
    head = struct.pack(">II16sH", 0x00051607, 0x00020000, b"\0" * 16, 2)
    data = head + struct.pack(">III", 4, 50, len(note)) + struct.pack(">III", 9, 50 + len(note), 32) + note + b"\0" * 32
    assert files.appledouble(data) == [("comment", "Seen by Ann"), ("finder info", "32")]
    assert [(r[2], r[3], r[4]) for r in files.read_file("x/._a.txt", data)] == [("comment", "Seen by Ann", "ready"), ("finder info", "32", "ready")]
    assert files.read_file("._a.txt", data[:60])[0][4] == "failed" and files.read_file("._a.txt", b"no")[0][4] == "failed"
