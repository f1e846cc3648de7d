"""The text that the sender of an e-mail newly wrote: without quotations, forwarded mail, closings, signatures and notices.

Each mail is read once, in Arrow batches. Its marks (quotation signs, header blocks of forwarded mail, lines that introduce a quotation, rules,
the sender's name) say where text of others is likely to stand, and its text is put into sentences. What marks can't tell, repetition does:

* inherited: sentences, and runs of two of them, are looked up in all earlier mail, whoever wrote it to whom, quoted parts included. Exact copies meet by a
  hash. For the others, distinct texts meet in blocks of the same numbers and a class of lengths; what the parities of their character grams put beyond
  the accepted distance is left out, and of the rest the edit distance decides, so each pair is found. A match takes away a sentence in doubtful position (below quoted text, or marked as an
  answer inside it). Text in no such position needs more, as people use the same phrases: two sentences in a row that stand in a row in
  an earlier mail, and are rarer than such a coincidence would be (`CHANCE`).
* boilerplate: paragraphs that stand alone at either end of mails and hardly ever among other sentences, in a good share of the mails of those who use
  them; paragraphs near one of these, by the same blocks and edit distance, go with it.

Shuffled are the mails once, then distinct sentences and runs, then their parities by block; counts are combined before they are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.session import checkpoint, discard, ship

#: Most edits, as a share of the longer text.
EDITS = 0.04
#: Words from which on a sentence is compared with earlier ones.
LEAST = 5
#: SimHash: bits, in partitions of 16; so many tables are keyed by a partition each. Hashed character grams have so many places.
BITS, TABLES, PLACES, GRAM = 512, 16, 512, 3
#: Texts in a block up to which one task compares them with one another; larger ones are compared in parts of that size.
ENTRY = 20_000
#: Most keys of the smaller side that are sent to the workers in order to leave out what can't meet them; beyond that all keys are shuffled.
SENT_KEYS = 1_000_000
#: A run of two sentences isn't inherited if, by how often each is written in so many sentences or more, it would occur this often by chance.
CHANCE, BACKGROUND = 0.001, 100_000
#: Of a boilerplate paragraph, the least share of its occurrences that stand alone at the end of a mail (lower bound at 95 %), and of the mails of its users that have it.
ALONE, USED = 0.5, 0.1

# Words of the five languages by which mail programs and writers mark lines.
_FROM = r"(?:From|Von|De|Van)"
_SENT = r"(?:Sent|Date|Gesendet|Datum|Envoyé|Enviado|Fecha|Verzonden)"
_FIELD = r"(?:From|Sent|Date|To|Cc|Subject|Von|Gesendet|Datum|An|Kopie|Betreff|De|Envoyé|À|Objet|Enviado|Fecha|Para|Asunto|Van|Verzonden|Aan|Onderwerp)"
_WROTE = r"wrote|quoting|schrieb|zitat|a écrit|citation|escribió|citando|schreef|citaat"
_CLOSING = (
    r"best|best regards|kind regards|regards|cheers|thanks|many thanks|thanks and best|best wishes|yours|yours sincerely|sincerely|yours faithfully|"
    r"gruß|grüße|viele grüße|beste grüße|liebe grüße|mit freundlichen grüßen|freundliche grüße|mfg|vg|lg|hochachtungsvoll|"
    r"cordialement|bien cordialement|bien à vous|meilleures salutations|salutations distinguées|amicalement|"
    r"saludos|un saludo|saludos cordiales|atentamente|cordialmente|un abrazo|"
    r"groet|groeten|met vriendelijke groet|vriendelijke groeten|hartelijke groeten|mvg|hoogachtend"
)
_DEVICE = r"(?:sent (?:from|with)|gesendet (?:von|mit)|von unterwegs gesendet|envoyé (?:depuis|de)|enviado desde|verzonden (?:vanaf|met)|get the \w+ app)\b"
_POSTSCRIPT = r"(?:p\.? ?){1,3}s\b|p\.? ?d\b|n\.? ?b\b|nachtrag|posdata|post ?scriptum"
_NOTICE = r"confidential|vertraulich|confidentiel|confidencial|vertrouwelijk|outside (?:the|our)|von außen|von extern|de l'extérieur|del exterior|de fuera de|van buiten"

_QUOTED = re.compile(r"[ \t]*(?:>|»|&gt;|\|(?!.*\|\s*$)|:(?=[ \t>|»&]|$))")
_MARKS = re.compile(r"(?:[ \t]*(?:>|»|&gt;|\||:(?=[ \t>|»&]|$)))+[ \t]?")
_HEADER = re.compile(rf"\*?{_FROM} ?:\*? *\S")
_DATED = re.compile(rf"\*?{_SENT} ?:\*?")
_OTHER = re.compile(rf"\*?{_FIELD} ?:\*?(?:\s|$)")
_RULE = re.compile(r"[-_=*~—–\s]*[-_=*~—–][-_=*~—–\s]*")
_TITLED_RULE = re.compile(r"[-_=*~—–]{3,} ?\w[^.!?]{2,60}[-_=*~—–]{3,}")
_INTRODUCED = re.compile(rf"(?:{_WROTE})|\S@\S", re.I)
_CLOSED = re.compile(rf"(?:{_CLOSING})[ ,.!]*", re.I)
_DEVICE_LINE = re.compile(_DEVICE, re.I)
_PS = re.compile(rf"\W*(?:{_POSTSCRIPT})", re.I)
_CAUTION = re.compile(_NOTICE, re.I)
_BANNER = re.compile(r"\[[^\]]{3,40}\]|\*{2,}[^*]{3,60}\*{2,}")
_INITIALS = re.compile(r"(?:<(\w{1,3})>|\[(\w{1,3})\]|#+ (\w{1,3})\b|\((\w{1,3})\)|(\w{1,3}):)\s")
_CONTACT = re.compile(r"\b(?:tel|fax|mob|phone)\b|\+\d\d|^\S+@\S+$|^(?:www\.|https?:)\S+$|\b(?:p\.? ?o\.? box|postfach)\b", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+")
_WORD = re.compile(r"[^\W_]+")
_GAPS = re.compile(r"[\W_]+")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_ENDS = (".", "!", "?", "…", ":", '."', ".)")


@dataclass
class Unit:
    """Lines that stand or fall together. kind: own, doubt (below quoted text), marked (an answer inside), edge (a paragraph at either end), kept."""

    kind: str
    lines: list[int]
    text: str
    first: str = ""


def _name(address: str | None) -> tuple[str, ...]:
    """The parts of a correspondent's name, in lower case: from the display name, else from the address."""
    if not address:
        return ()
    shown, _, rest = address.partition("<")
    local = (rest or shown).partition("@")[0]
    return tuple(w.lower() for w in (_WORD.findall(shown) if rest and shown.strip() else re.split(r"[._-]", local)) if w)


def _signs(line: str, name: tuple[str, ...]) -> bool:
    """Whether a line is the sender's name, or part of it, alone."""
    if not name or len(line) > 100:
        return False
    words = [w.lower() for w in _WORD.findall(line)]
    if not words or len(words) > len(name) + 1:
        return False
    return words == list(name) or words == list(name[:1]) or words == ["".join(x[0] for x in name)]


def _headers(lines: list[str], quoted: list[bool]) -> tuple[int, int] | None:
    """Begin and end of the first header block of unquoted forwarded mail."""
    for k, line in enumerate(lines):
        if quoted[k] or not _HEADER.match(line):
            continue
        if any(_DATED.match(x) for x in lines[k + 1 : k + 3]) or sum(bool(_OTHER.match(x)) for x in lines[k + 1 : k + 4]) >= 2:
            end = k + 1
            while end < len(lines) and _OTHER.match(lines[end]):
                end += 1
            return k, end
    return None


def candidates(text: str, sender: str | None, receiver: str | None = None) -> list[Unit]:
    """The units of a mail that may be new, in order; all other non-blank lines surely aren't."""
    lines = [x.rstrip() for x in text.split("\n")]
    name, other = _name(sender), _name(receiver)
    blank = [not x or x.isspace() for x in lines]
    quoted = [bool(_QUOTED.match(x)) for x in lines]
    drop = quoted[:]
    doubt = [False] * len(lines)
    tail = len(lines)
    if found := _headers(lines, quoted):
        tail, _ = found
        before = tail - 1
        while before >= 0 and blank[before]:
            before -= 1
        if before >= 0 and not quoted[before] and (_RULE.fullmatch(lines[before]) or _TITLED_RULE.fullmatch(lines[before].strip()) or (lines[before].endswith(":") and len(lines[before]) < 60)):
            tail = before
    for k in range(1, tail):
        # Below quoted text, without a blank line between: what a wrapped quotation left without its sign, or an answer.
        if not blank[k] and not drop[k] and drop[k - 1] and not blank[k - 1]:
            above = _MARKS.sub("", lines[k - 1])
            if not above.endswith(_ENDS) or (k + 1 < tail and quoted[k + 1]):
                drop[k] = True
            else:
                doubt[k] = True
        elif not blank[k] and not drop[k] and doubt[k - 1]:
            doubt[k] = True
    for k in range(tail):
        if drop[k] or blank[k]:
            continue
        below = k + 1
        while below < tail and blank[below]:
            below += 1
        line = lines[k]
        if below < len(lines) and quoted[below] and line.endswith(":") and (_INTRODUCED.search(line) or (other and set(other) <= {w.lower() for w in _WORD.findall(line)})):
            drop[k] = True
            if k and not blank[k - 1] and not drop[k - 1] and len(lines[k - 1]) <= 100 and not lines[k - 1].endswith(_ENDS):
                drop[k - 1] = True
    # A banner above all else: one sentence, that may have been wrapped.
    top = next((k for k in range(tail) if not drop[k] and not blank[k]), tail)
    if top < tail and (_BANNER.fullmatch(lines[top].strip()) or (_CAUTION.search(lines[top]) and len(lines[top].split()) >= 5)):
        drop[top] = True
        while not _BANNER.fullmatch(lines[top].strip()) and not lines[top].endswith(_ENDS) and top + 1 < tail and not blank[top + 1] and not drop[top + 1]:
            top += 1
            drop[top] = True
    # Closings, signatures and what stands below rules.
    k = 0
    signed, closed = False, []
    while k < tail:
        if drop[k] or blank[k]:
            k += 1
            continue
        line = lines[k].strip()
        below = k + 1
        while below < tail and blank[below]:
            below += 1
        closes = bool(_CLOSED.fullmatch(line))
        if not closes and below < tail and not drop[below] and below <= k + 2 and _signs(lines[below], name):
            closes = len(line.split()) <= 5 and not line.endswith((".", "!", "?", ":")) and not _signs(line, name) and (k == 0 or blank[k - 1]) and k > 0
        if closes:
            drop[k] = signed = True
            closed.append(k)
            if below < tail and below <= k + 2 and _signs(lines[below], name):
                k = below
                continue
            k += 1
            continue
        if _RULE.fullmatch(line) or _signs(line, name):
            drop[k] = signed = True
            closed.append(k)
            k += 1
            while k < tail and not blank[k] and not quoted[k]:
                drop[k] = True
                k += 1
            continue
        if signed and _CONTACT.search(line) and len(line) < 60:
            drop[k] = True
        k += 1

    signed_at = closed[0] if closed else len(lines)
    units: list[Unit] = []
    blocks: list[list[int]] = []
    for k in range(tail):
        if drop[k] or blank[k]:
            continue
        # A salutation ends what stands above it.
        greets = len(blocks) == 1 and lines[k].endswith((",", ":", " -")) and len(lines[k].split()) <= 5
        if blocks and blocks[-1][-1] == k - 1 and doubt[k] == doubt[k - 1] and not greets:
            blocks[-1].append(k)
        else:
            blocks.append([k])
    for i, block in enumerate(blocks):
        words = sum(len(lines[k].split()) for k in block)
        joined = " ".join(lines[k].strip() for k in block)
        if _PS.match(joined):
            units.append(Unit("kept", block, joined))
            continue
        outer = i == 0 or i == len(blocks) - 1 or block[0] > signed_at
        if (_DEVICE_LINE.match(joined) and words <= 10) or (outer and 5 <= words and (words <= 60 or block[0] > signed_at) and _CAUTION.search(joined)):
            continue
        if len(blocks) > 1 and not doubt[block[0]] and outer and (i or words >= 6) and not joined.endswith((",", ":", "-")):
            units.append(Unit("edge", block, joined, _SENTENCE.split(joined)[0]))
        units.extend(_sentences([(k, lines[k].strip()) for k in block], "doubt" if doubt[block[0]] else "own"))
    initials = "".join(x[0] for x in name)
    k = tail
    while k < len(lines):
        mark = None if quoted[k] or blank[k] else _INITIALS.match(lines[k].lstrip())
        if mark and initials and next(x for x in mark.groups() if x).lower() == initials:
            block = [k]
            while k + 1 < len(lines) and not blank[k + 1] and not quoted[k + 1]:
                k += 1
                block.append(k)
            units.append(Unit("marked", block, " ".join(lines[x].strip() for x in block)[mark.end() :]))
        k += 1
    return units


def _sentences(block: list[tuple[int, str]], kind: str) -> list[Unit]:
    """The sentences of lines that follow one another, each with the lines it has part in."""
    joined = " ".join(x for _, x in block)
    ends, at = [], 0
    for k, x in block:
        at += len(x) + 1
        ends.append((at, k))
    out, start = [], 0
    for part in [*(m.end() for m in _SENTENCE.finditer(joined)), len(joined)]:
        if part > start:
            covered = [k for i, (end, k) in enumerate(ends) if end > start and (ends[i - 1][0] if i else 0) < part]
            out.append(Unit(kind, covered, joined[start:part].strip()))
        start = part
    return out


@cache
def _planes() -> np.ndarray:
    return np.random.default_rng(64).choice(np.array([-1, 1], np.float32), (PLACES, BITS))


def _grams(texts: list[str], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all grams of so many characters."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = max(len(codes) - gram + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(gram):
        h = (h ^ codes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    whole = owner[:n] == owner[gram - 1 :]
    return owner[:n][whole], h[whole]


def simhash(texts: list[str]) -> np.ndarray:
    """SimHash fingerprints over the character grams of each text: [texts, BITS / 16] partitions of 16 bits, as uint16. Texts shorter than a gram are filled up with spaces."""
    texts = [t.ljust(GRAM) for t in texts]
    owner, h = _grams(texts, GRAM)
    at = owner * PLACES + (h >> np.uint64(20) & np.uint64(PLACES - 1)).astype(np.int64)
    counts = np.bincount(at, minlength=len(texts) * PLACES).reshape(len(texts), PLACES).astype(np.float32)
    return np.packbits(counts @ _planes() > 0, axis=1).view(np.uint16)


def table_keys(partitions: np.ndarray) -> np.ndarray:
    """[texts, TABLES] as int64: the entry of each text in each table. The first 16 bits are the table's own partition, the rest three further ones."""
    wide = partitions.astype(np.uint64)
    n = wide.shape[1]
    own = [sum(wide[:, (t + step) % n] << np.uint64(48 - 16 * i) for i, step in enumerate((0, 7, 13, 22))) for t in range(TABLES)]
    return np.stack(own, axis=1).view(np.int64)


def _spread(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


#: Days and lengths in `meta` are capped at this; what is beyond compares as equal there, and exactly later.
_CAP = (1 << 20) - 1
#: Classes of lengths begin at these. Texts shorter than the first are near to none; each class is wider than near texts may differ in length.
_CLASSES = [24]
while _CLASSES[-1] < 1 << 31:
    _CLASSES.append(int(_CLASSES[-1] * 1.17) + 1)
_CLASSES = np.array(_CLASSES, np.int64)
#: Groups of texts up to this size are compared all at once, larger ones in tiles of so many texts by so many.
_SMALL, _TILE = 64, (64, 2048)
_BLOCK_SQL = "k bigint, class int, id bigint, meta bigint, print binary"


def _gram(cls: int) -> int:
    """Characters of a gram in the parities of a class of lengths."""
    return 2 if _CLASSES[cls] < 200 else 3 if _CLASSES[cls] < 3000 else 5


def _places(cls: int) -> int:
    """Parities of the texts of a class, a multiple of 128."""
    return max(256, -(-int(_CLASSES[cls]) * (_gram(cls) - 1) // 128) * 128)


def parities(texts: list[str], gram: int, places: int) -> np.ndarray:
    """[texts, places / 64] as uint64: for each of `places` hashed grams whether it occurs an odd number of times. An edit changes at most twice `gram` of these, one that changes the length one less."""
    out = [np.zeros((0, places // 64), np.uint64)]
    for start in range(0, len(texts), step := max(1, (1 << 20) // places)):
        some = texts[start : start + step]
        owner, h = _grams(some, gram)
        at = owner * places + (_spread(h) >> np.uint64(20)).astype(np.int64) % places
        odd = np.bincount(at, minlength=len(some) * places).reshape(len(some), places) & 1
        out.append(np.packbits(odd.astype(bool), axis=1).view(np.uint64))
    return np.concatenate(out)


def _block_keys(sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, class, key): the blocks of each text: that of its class of lengths, and that of the longest text it may be near to, if it is another."""
    own = np.searchsorted(_CLASSES, sizes, "right") - 1
    top = np.searchsorted(_CLASSES, (sizes / (1 - EDITS)).astype(np.int64) + 1, "right") - 1
    text = np.concatenate([np.flatnonzero(own >= 0), np.flatnonzero(top != own)])
    cls = np.concatenate([own[own >= 0], top[top != own]])
    return text, cls, _spread(cls.astype(np.uint64) ^ _spread(numbers[text].view(np.uint64))).view(np.int64)


def _blocks(numbers: bool, only=None, keys_alone: bool = False):
    """The blocks of (id, role, text, since, until): key, class of lengths, and in one number length, last and first day, and role; the parities. only: if given, the sorted keys of those that can meet anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 4000) for i in range(0, b.num_rows, 4000)):
                texts = part.column(2).to_pylist()
                sizes = np.array([len(t) for t in texts], np.int64)
                nums = np.array([_hash(_NOT_DIGITS.sub(" ", t).strip()) if numbers else 0 for t in texts], np.int64)
                text, cls, keys = _block_keys(sizes, nums)
                if keys_alone:
                    yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["k"])
                    continue
                if only is not None:
                    use = np.isin(keys, only.value)
                    text, cls, keys = text[use], cls[use], keys[use]
                order = np.argsort(cls, kind="stable")
                text, cls, keys = text[order], cls[order], keys[order]
                prints: list[bytes] = []
                for c in np.unique(cls):
                    prints += [x.tobytes() for x in parities([texts[i] for i in text[cls == c]], _gram(c), _places(c))]
                since, until = (np.clip(np.nan_to_num(part.column(i).to_numpy(zero_copy_only=False).astype(float)), 0, _CAP).astype(np.int64) for i in (3, 4))
                roles = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                meta = np.minimum(sizes, _CAP) << 42 | until << 22 | since << 2 | roles
                columns = [pa.array(keys), pa.array(cls.astype(np.int32)), part.column(0).take(pa.array(text)), pa.array(meta[text]), pa.array(prints, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "class", "id", "meta", "print"])

    return run


def _fitting(a: np.ndarray, b: np.ndarray, ids: np.ndarray, meta: np.ndarray, prints: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (a asks, b is asked for), by place, the ids of those whose roles, days, lengths and parities let them be near."""
    ma, mb = meta[a], meta[b]
    use = (ma & 1 > 0) & (mb & 2 > 0) & (mb >> 2 & _CAP <= ma >> 22 & _CAP) & (ids[a] != ids[b])
    a, b, size, other = a[use], b[use], ma[use] >> 42, mb[use] >> 42
    most = np.floor(np.maximum(size, other) * EDITS).astype(np.int64)
    apart = np.abs(size - other)
    # Lengths that are capped are compared later.
    open_ = np.maximum(size, other) >= _CAP
    use = (apart <= most) | open_
    a, b, most, apart, open_ = a[use], b[use], most[use], apart[use], open_[use]
    use = (np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64) <= 2 * gram * most - apart) | open_
    return ids[a[use]], ids[b[use]]


def _all_pairs(sizes: np.ndarray, *of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The fitting pairs within small groups, that follow one another in so many rows each."""
    ends = np.cumsum(sizes)
    # So many groups at once that the pairs stay a bounded number.
    for some in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes**2) // 1_000_000)) + 1):
        n = sizes[some]
        each = np.repeat(n, n)
        a = np.repeat(np.arange(ends[some[0]] - n[0], ends[some[-1]]), each)
        b = np.repeat(np.repeat(ends[some] - n, n), each) + np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each)
        yield _fitting(a, b, *of)


def _tiles(at: np.ndarray, ids: np.ndarray, meta: np.ndarray, prints: np.ndarray, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The fitting pairs within a large group: half of the parities leave out most, in tiles of texts of like length."""
    at = at[np.argsort(meta[at] >> 42, kind="stable")]
    asks, asked = at[meta[at] & 1 > 0], at[meta[at] & 2 > 0]
    half = max(1, prints.shape[1] // 2)
    lengths = meta[asked] >> 42
    theirs = np.ascontiguousarray(prints[asked, :half].T)
    high, wide = _TILE
    for i in range(0, len(asks), high):
        rows = asks[i : i + high]
        mine = prints[rows, :half]
        low, top = meta[rows[0]] >> 42, meta[rows[-1]] >> 42
        longest = int(top / (1 - EDITS)) + 1
        whole = top >= _CAP or longest >= _CAP
        begin, end = np.searchsorted(lengths, int(low * (1 - EDITS))), len(lengths) if whole else np.searchsorted(lengths, longest, "right")
        limit = 2 * gram * int(longest * EDITS)
        for j in range(begin, end, wide):
            stop = min(j + wide, end)
            if whole:
                a, b = (x.ravel() for x in np.indices((len(rows), stop - j)))
            else:
                apart = np.bitwise_count(mine[:, 0, None] ^ theirs[0, j:stop]).astype(np.uint8 if half < 4 else np.uint32)
                for w in range(1, half):
                    apart += np.bitwise_count(mine[:, w, None] ^ theirs[w, j:stop])
                a, b = np.divmod(np.flatnonzero(apart.ravel() <= limit), stop - j)
            if len(a):
                yield _fitting(rows[a], asked[j + b], ids, meta, prints, gram)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, old) of the fitting pairs within blocks, which come in order of class and key."""

    def pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cls, k, ids, meta = (table.column(n).to_numpy() for n in ("class", "k", "id", "meta"))
        for c in np.unique(cls):
            low, top = np.searchsorted(cls, [c, c + 1])
            prints = np.frombuffer(b"".join(table.column("print").slice(low, top - low).to_pylist()), np.uint64).reshape(top - low, -1)
            own = (ids[low:top], meta[low:top], prints, _gram(c))
            begins = np.flatnonzero(np.r_[True, k[low + 1 : top] != k[low : top - 1]])
            sizes = np.diff(np.r_[begins, top - low])
            for i in np.flatnonzero(sizes > _SMALL):
                yield from _tiles(np.arange(begins[i], begins[i] + sizes[i]), *own)
            small = np.flatnonzero(np.repeat(sizes <= _SMALL, sizes))
            if len(small):
                yield from _all_pairs(sizes[sizes <= _SMALL], own[0][small], own[1][small], prints[small], own[3])

    def groups() -> Iterator[pa.Table]:
        """Tables of whole blocks; the last block of a batch may go on in the next."""
        kept: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            new = pa.Table.from_batches([b])
            last = (b.column("class")[b.num_rows - 1], b.column("k")[b.num_rows - 1])
            ends = (b.column("class").to_numpy() != last[0].as_py()) | (b.column("k").to_numpy() != last[1].as_py())
            if ends.any() or (kept and (kept[-1].column("class")[-1], kept[-1].column("k")[-1]) != last):
                cut = int(np.flatnonzero(ends)[-1]) + 1 if ends.any() else 0
                yield pa.concat_tables([*kept, new.slice(0, cut)])
                kept = [new.slice(cut)]
            else:
                kept.append(new)
        if kept:
            yield pa.concat_tables(kept)

    for table in groups():
        for a, b in pairs(table.combine_chunks()):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["id", "old"])


#: Kinds of sentences that may be new.
_FRESH = ("own", "doubt", "marked", "kept")
#: Of a run, `lines` holds the numbers of its units.
_UNIT = pa.schema(
    [("segment_id", pa.string()), ("sender", pa.string()), ("receiver", pa.string()), ("at", pa.timestamp("us")), ("unit", pa.int32()), ("kind", pa.string()), ("lines", pa.list_(pa.int32())), ("text", pa.string()), ("first", pa.int64()), ("second", pa.int64()), ("words", pa.int32()), ("body", pa.int64())]
)
_UNIT_SQL = "segment_id string, sender string, receiver string, at timestamp_ntz, unit int, kind string, lines array<int>, text string, first bigint, second bigint, words int, body bigint"


def _address(shown: str | None) -> str:
    """The bare address of a correspondent, in lower case."""
    return (re.search(r"<([^>]*)>", shown) or re.match(r"()", ""))[1].strip().lower() or shown.strip().lower() if shown else ""


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _plain(text: str) -> str:
    """The words of a text, as they are compared."""
    return _GAPS.sub(" ", text.lower()).strip()


def _others(text: str, fresh: set[int]) -> list[list[Unit]]:
    """The sentences of the lines that aren't new, without their quotation signs: of each paragraph, in order."""
    out: list[list[Unit]] = []
    block: list[tuple[int, str]] = []
    for k, line in enumerate([*text.split("\n"), ""]):
        bare = "" if k in fresh else _MARKS.sub("", line, count=1).strip() if _QUOTED.match(line) else line.strip()
        if bare:
            block.append((k, bare))
        elif block:
            out.append(_sentences(block, "old"))
            block = []
    return out


def _runs(units: list[tuple[int, str]], kind: str) -> list[tuple]:
    """(kind, units, text, first, second) of each run of two long sentences, from (number, words); short ones between them are part of it. first and second: hashes of the two."""
    out: list[tuple] = []
    last: str | None = None
    covered: list[int] = []
    for n, plain in units:
        if plain.count(" ") + 1 < LEAST:
            covered.append(n)
            continue
        if last is not None:
            out.append((kind, [*covered, n], f"{last} {plain}", _hash(last), _hash(plain)))
        last, covered = plain, [n]
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in (b.slice(i, 2000) for i in range(0, b.num_rows, 2000)):
            rows = []
            for key, text, sender, receiver, at in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                who, whom, body = _address(sender), _address(receiver), _hash(text)
                units = candidates(text, sender, receiver)
                found = []
                for u in units:
                    plain = _plain(u.text)
                    found.append((u.kind, u.lines, plain, _hash(_plain(u.first) if u.first else plain), None))
                found += _runs([(n, f[2]) for n, f in enumerate(found) if f[0] == "own"], "run")
                old = [_plain(u.text) for x in _others(text, {k for u in units if u.kind != "edge" for k in u.lines}) for u in x]
                found += [("old", [], t, None, None) for t in old]
                found += _runs([(0, t) for t in old], "old run")
                rows += [(key, who, whom, at, n, kind, lines, plain, first, second, plain.count(" ") + 1 if plain else 0, body) for n, (kind, lines, plain, first, second) in enumerate(found)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_UNIT)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _UNIT, strict=True)], schema=_UNIT)


def mail_units(segments: DataFrame, headers: DataFrame) -> DataFrame:
    """The units of all e-mail bodies: segments with a row in headers, each once."""
    ship(segments.sparkSession)
    head = headers.filter("segment_id IS NOT NULL").groupBy("segment_id").agg(
        F.min(F.struct("from_addr", "to_addr", F.coalesce("sent_at", "received_at").cast("timestamp_ntz").alias("at"))).alias("h")
    )
    texts = segments.filter("text IS NOT NULL").select(F.col("id").alias("segment_id"), "text")
    mails = texts.join(head, "segment_id").dropDuplicates(["segment_id"]).select("segment_id", "text", "h.from_addr", "h.to_addr", "h.at")
    return mails.mapInArrow(_parse, _UNIT_SQL)


def _most(a: Column, b: Column) -> Column:
    """Edits that texts of these lengths may be apart."""
    return F.floor(F.greatest(a, b) * F.lit(EDITS)).cast("int")


def _near(a: Column, b: Column) -> Column:
    most = _most(F.length(a), F.length(b))
    return (a == b) | ((F.abs(F.length(a) - F.length(b)) <= most) & (F.call_function("levenshtein", a, b, most) >= 0))


def near_earlier(texts: DataFrame, numbers: bool = True, timed: bool = True) -> DataFrame:
    """(id, old, old_since): all pairs of different texts within `EDITS`, from `texts`: id, text, role (1 asks, 2 is asked for, 3 both). With `numbers`, texts with different
    numbers (by a hash of 64 bits) aren't near: they say something else. If `timed`, texts have the columns since and until, and the old text must have been
    there before the last use of the other.

    Each pair is found: texts meet in blocks of the same numbers and a class of lengths, and of the pairs in a block nothing is left out but what its lengths or
    the parities of its grams put beyond the accepted distance. Blocks of more than `ENTRY` texts are compared part by part, each part with each.
    """
    spark = texts.sparkSession
    ship(spark)
    days = [F.unix_date(F.col(t).cast("date")).alias(t) if timed else F.lit(0).alias(t) for t in ("since", "until")]
    given = texts.select("id", "role", "text", *days)
    counts = {r.role: r.n for r in texts.groupBy("role").agg(F.count("*").alias("n")).collect()}
    sides = {1: counts.get(1, 0) + counts.get(3, 0), 2: counts.get(2, 0) + counts.get(3, 0)}
    few = min(sides, key=sides.get)
    only = None
    if 2 * sides[few] <= SENT_KEYS:
        sent = given.filter(F.col("role").isin(few, 3)).mapInArrow(_blocks(numbers, keys_alone=True), "k bigint").distinct()
        only = spark.sparkContext.broadcast(np.unique(np.array(sent.toArrow().column(0).to_numpy(), np.int64)))
    rows = given.mapInArrow(_blocks(numbers, only), _BLOCK_SQL)
    by = W.partitionBy("k", "class")
    roles = F.bit_or(F.col("meta").bitwiseAND(F.lit(3).cast("bigint"))).over(by)
    counted = rows.withColumns({"n": F.count("*").over(by), "roles": roles}).filter("n > 1 AND roles = 3")
    parts = counted.withColumn("parts", F.ceil(F.col("n") / F.lit(ENTRY)).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    # Part i of those that ask meets part j of those that are asked for in the block (i, j).
    role = F.col("meta").bitwiseAND(F.lit(3).cast("bigint"))
    to = lambda i, j, bits: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), role.bitwiseAND(F.lit(bits).cast("bigint")).alias("role"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("part"))
    spread = F.concat(F.array(to(F.col("part"), F.col("part"), 3)), F.transform(others, lambda j: to(F.col("part"), j, 1)), F.transform(others, lambda j: to(j, F.col("part"), 2)))
    sent = parts.select(F.explode(spread).alias("to"), "k", "class", "id", "meta", "print").filter("to.role > 0")
    meta = (F.col("meta") - role + F.col("to.role")).alias("meta")
    blocks = sent.select(F.xxhash64("k", "to.i", "to.j").alias("k"), "class", "id", meta, "print")
    # A fixed number of partitions: by their bytes too few would be left for the comparisons in them.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(tasks, "k", "class").sortWithinPartitions("class", "k")
    met = checkpoint(blocks.mapInArrow(_compared, "id bigint, old bigint").distinct())
    own = texts.select("id", "text", *(["until"] if timed else []))
    old = texts.select(F.col("id").alias("old"), F.col("text").alias("old_text"), *([F.col("since").alias("old_since")] if timed else []))
    near = _near(F.col("text"), F.col("old_text"))
    pairs = met.join(own, "id").join(old, "old").filter((F.col("old_since") < F.col("until")) & near if timed else near)
    found = checkpoint(pairs.select("id", "old", *(["old_since"] if timed else [])))
    discard(met)
    return found


def _matches(units: DataFrame, asks: list[str], asked: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, old): texts of the kinds in `asks` and those of either kind that they are near to, themselves included if they occur again; and the occurrences of all (id, kind and the columns of units)."""
    of = units.filter(F.col("kind").isin(*asks, *asked) & (F.col("words") >= LEAST) & F.col("at").isNotNull()).withColumn("id", F.xxhash64("text"))
    until = F.max(F.when(F.col("kind").isin(*asks), F.col("at")))
    seen = checkpoint(of.groupBy("id").agg(F.min("at").alias("since"), until.alias("until"), F.first("text").alias("text")))
    near = near_earlier(seen.withColumn("role", F.when(F.col("until").isNull(), 2).otherwise(3).cast("tinyint")))
    again = seen.filter("since < until").select("id", F.col("id").alias("old"), "since")
    pairs = checkpoint(near.withColumnRenamed("old_since", "since").unionByName(again))
    discard(seen, near)
    return pairs, of


def inherited(units: DataFrame) -> DataFrame:
    """(segment_id, unit) of the sentences in doubtful position, and of those in runs, that stand in an earlier mail too."""
    doubtful = ["doubt", "marked"]
    # Only mails that one of the correspondents of a doubtful sentence wrote or got can have it.
    names = F.explode(F.array("sender", "receiver"))
    who = checkpoint(units.filter(F.col("kind").isin(*doubtful)).select(names.alias("who")).filter("who != ''").distinct())
    theirs = [units.join(who.withColumnRenamed("who", c), c, "left_semi") for c in ("sender", "receiver")]
    pairs, of = _matches(theirs[0].unionByName(theirs[1]), doubtful, ["own", "kept", "old"])
    met = of.select("id", "kind", "segment_id", "unit", "at", names.alias("who")).filter("who != ''")
    first = met.join(pairs.select(F.col("old").alias("id")).distinct(), "id", "left_semi").groupBy(F.col("id").alias("old"), "who").agg(F.min("at").alias("since"))
    asks = met.filter(F.col("kind").isin(*doubtful)).join(pairs.select("id", "old"), "id")
    alone = asks.join(first, ["old", "who"]).filter("since < at").select("segment_id", "unit")
    pairs, of = _matches(units, ["run"], ["old run"])
    runs = of.filter("kind = 'run'").join(pairs.groupBy("id").agg(F.min("since").alias("since")), "id").filter("since < at")
    # How often a sentence is written, in mails of different text.
    own = units.filter("kind = 'own'")
    written = own.groupBy("first").agg(F.countDistinct("body").alias("n"))
    total = own.agg(F.greatest(F.count("*"), F.lit(BACKGROUND)).alias("total"))
    both = runs.join(written.withColumnRenamed("n", "n1"), "first").join(written.select(F.col("first").alias("second"), F.col("n").alias("n2")), "second").join(F.broadcast(total))
    rare = both.filter(F.col("n1") * F.col("n2") < F.lit(CHANCE) * F.col("total"))
    return alone.unionByName(rare.select("segment_id", F.explode("lines").alias("unit"))).distinct()


def _lower(part: Column, whole: Column) -> Column:
    """Lower end of the 95 % interval of a share (Wilson)."""
    z = 1.96
    p = part / whole
    return (p + z * z / (2 * whole) - z * F.sqrt(p * (1 - p) / whole + z * z / (4 * whole * whole))) / (1 + z * z / whole)


def boilerplate(units: DataFrame) -> DataFrame:
    """(segment_id, lines) of the paragraphs at either end of mails that are boilerplate. Mails with the same text count once."""
    edges = units.filter("kind = 'edge'")
    own = units.filter(F.col("kind").isin(*_FRESH)).groupBy(F.col("first").alias("opening")).agg(F.countDistinct("body").alias("occurrences"))
    mails = units.groupBy("sender").agg(F.countDistinct("body").alias("mails"))
    used = edges.groupBy("text", "first", "sender").agg(F.countDistinct("body").alias("n")).join(mails, "sender")
    shared = used.groupBy("text", "first").agg(F.sum("n").alias("n"), F.sum("mails").alias("mails"))
    shared = shared.join(own, F.col("first") == F.col("opening"), "left").withColumn("all", F.greatest("n", F.coalesce("occurrences", F.lit(0))))
    known = (_lower(F.col("n"), F.col("all")) >= ALONE) & (F.col("n") >= F.lit(USED) * F.col("mails"))
    roles = checkpoint(shared.select(F.xxhash64("text").alias("id"), "text", F.when(known, 2).otherwise(1).cast("tinyint").alias("role")).dropDuplicates(["id"]))
    found = roles.filter("role = 2").select("id").unionByName(near_earlier(roles, numbers=False, timed=False).select("id").distinct())
    return edges.withColumn("id", F.xxhash64("text")).join(found, "id").select("segment_id", "lines")


def new_lines(segments: DataFrame, headers: DataFrame) -> DataFrame:
    """(segment_id, line_no) of each non-blank line that the sender of an e-mail newly wrote, counted from 0.

    Mails without a time inherit nothing. Null, empty and blank texts have no line, repeated rows count once, and without headers or segments the
    result is empty. A line with part in two sentences is new if one of them is.
    """
    units = checkpoint(mail_units(segments, headers))
    written = units.filter(F.col("kind").isin(*_FRESH)).select("segment_id", "unit", "lines")
    fresh = written.join(inherited(units), ["segment_id", "unit"], "left_anti").select("segment_id", F.explode("lines").alias("line_no")).distinct()
    stale = boilerplate(units).select("segment_id", F.explode("lines").alias("line_no")).distinct()
    return fresh.join(stale, ["segment_id", "line_no"], "left_anti")
