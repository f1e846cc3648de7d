"""Languages of documents and of the parts of mixed texts, with confidence.

A text is taken apart into sentences (quotation marks of e-mails removed, hard-wrapped lines joined, entries of lists and rows of tables
left apart). Each word has a score per language: the script of its letters narrows the candidates to the languages whose common words are in that script, and a
model of words and, for words it doesn't know, of their letter triples scores what is left. A script of none of them stands for its own language. A Viterbi path over all words of the text, on which a change of language costs much
inside a sentence and little between sentences, labels spans of one language; the scores within a span give its confidence.

The model is fitted to the sentences of all texts, labelled by the common words in them, so wrong or missing labels of documents don't matter. Words are
counted where the texts lie, and the counts of words and triples added up in tables; what the driver gets is a row for each word seen often enough and for
each triple. Every text is then labelled, whole, where it lies; only spans without their text are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.llm.hmm import switching_path
from sedimenta.session import checkpoint, discard, ship

#: Costs of another language within a sentence, and at the beginning of one.
INSIDE, BETWEEN = 9.0, 2.0
#: Words that make a sentence.
SENTENCE = 8
#: Characters that the longest line of wrapped text has at least.
NARROW = 38
#: Most that a single word can say for or against a language.
MOST = 4.0
#: Least share of a sentence's words that are common words of its language.
COMMON = 0.08
#: A common word counts as seen so often in its language; a word counts in its triples up to so often.
GIVEN, PER_WORD = 20, 5
#: Of words and of triples, what is added to a count (parted among the languages), and how often one has to occur in some language.
WORDS, TRIPLES = (1.0, 3), (2.0, 2)
#: Counts of words that a worker holds before it passes them on.
_HELD = 500_000
#: Words whose scores a worker remembers.
_REMEMBERED = 300_000
#: Texts labelled together.
_TOGETHER = 1000

#: A word stands by itself: parts of numbers, of identifiers, code and addresses aren't words.
_WORD = re.compile(r"(?<![^\s\"'’‘“„«»(。、！？])[^\W\d_]+(?:['’-][^\W\d_]+)*(?=[\s.,;:!?…\"'’”»)。、！？]|$)")
_ADDRESS = re.compile(r"[^\s<>]*@[^\s<>:,;]*|\b(?:www\.|https?:)\S*")
_QUOTE = re.compile(r"(?:[ \t]*(?:[>|»]|&gt;|:(?= )))+[ \t]?")
_ENTRY = re.compile(r"[ \t]*(?:[-*+•‣◦▪–—·☐☑☒✓]|\(?(?:\d{1,3}|[A-Za-z]|[ivxlc]{1,6})[.)])\s")
_CELLS = re.compile(r"\t|\||;\S|[^\s.!?]\s{2,}\S|,\S+,")
#: The point of a day of the month ends nothing.
_END = re.compile(r"(?<!\s\d)(?<!\s\d\d)[.!?…]+[\"'’”»)]*(?:\s|$)")
_STOP = (".", "!", "?", "…", ":", '."', ".”", ".»")
#: Of each script the ranges of its letters, and the language of a text in it where none of the modelled languages is written in it; "und" with the script's code where many are.
SCRIPTS = (
    ("Latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)), "und-Latn"),
    ("Greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "el"),
    ("Cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C88), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)), "und-Cyrl"),
    ("Armenian", ((0x531, 0x58F),), "hy"),
    ("Hebrew", ((0x5D0, 0x5EA), (0xFB1D, 0xFB4F)), "he"),
    ("Arabic", ((0x620, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)), "und-Arab"),
    ("Devanagari", ((0x900, 0x97F),), "und-Deva"),
    ("Bengali", ((0x980, 0x9FF),), "bn"),
    ("Tamil", ((0xB80, 0xBFF),), "ta"),
    ("Thai", ((0xE01, 0xE5B),), "th"),
    ("Georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)), "ka"),
    ("Hangul", ((0x1100, 0x11FF), (0x3131, 0x318E), (0xAC00, 0xD7A3)), "ko"),
    ("Kana", ((0x3041, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)), "ja"),
    ("Han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)), "zh"),
    ("other", (), "und"),
)
_LETTERS = ["".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) for _, ranges, _ in SCRIPTS[:-1]]
_SCRIPT = [re.compile(f"[{letters}]") for letters in _LETTERS]
_LATIN = re.compile(rf"[{_LETTERS[0]}'’\-]+")
_KANA = next(i for i, x in enumerate(SCRIPTS) if x[0] == "Kana")


def script_of(word: str) -> int:
    """The script of a word, as a place in SCRIPTS: that of most of its letters, of equally many the first; a word with kana is Japanese."""
    if _LATIN.fullmatch(word):
        return 0
    counts = [len(p.findall(word)) for p in _SCRIPT]
    if counts[_KANA]:
        return _KANA
    return counts.index(max(counts)) if any(counts) else len(SCRIPTS) - 1


def sentences(text: str) -> list[list[tuple[int, str]]]:
    """The sentences of a text, each as pieces (offset, piece): parts of lines that follow one another."""
    out: list[list[tuple[int, str]]] = []
    block: list[tuple[int, str]] = []

    def flush() -> None:
        """A block without blank lines: its lines are one run of text if each but the last is too full for the next word."""
        if len(block) > 1:
            widest = max(len(x.rstrip()) for _, x in block)
            full = sum(len(a.rstrip()) + 1 + len(b.split(None, 1)[0]) > widest for (_, a), (_, b) in zip(block, block[1:]))
            joined = widest >= NARROW and full >= 0.8 * (len(block) - 1)
        else:
            joined = True
        for part in [block] if joined else [[x] for x in block]:
            open_: list[tuple[int, str]] = []
            for at, line in part:
                begin = 0
                for m in _END.finditer(line):
                    out.append([*open_, (at + begin, line[begin : m.end()])])
                    open_, begin = [], m.end()
                if begin < len(line):
                    open_.append((at + begin, line[begin:]))
            if open_:
                out.append(open_)
        block.clear()

    at = 0
    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        if m := _QUOTE.match(line):
            start, line = start + m.end(), line[m.end() :]
        if not line or line.isspace():
            flush()
            continue
        if "@" in line or "www." in line or "http" in line:
            line = _ADDRESS.sub(lambda m: " " * len(m[0]), line)
            if line.isspace():
                continue
        if _ENTRY.match(line) or (len(line) < 200 and len(_CELLS.findall(line)) >= 2):
            flush()
            out.append([(start, line)])
            continue
        block.append((start, line))
        if line.rstrip().endswith(_STOP):
            flush()
    flush()
    return out


class Scores:
    """Rows of numbers by word or triple, which are kept as hashes of 64 bits."""

    def __init__(self, keys: list[str], rows: np.ndarray):
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], rows[order]

    def get(self, key: str) -> np.ndarray | None:
        h = np.uint64(xxhash.xxh64_intdigest(key))
        i = int(np.searchsorted(self.hashes, h))
        return self.rows[i] if i < len(self.hashes) and self.hashes[i] == h else None


class Model:
    """Scores of words by language. languages are in order; `unknown` is the index of words in other scripts."""

    def __init__(self, languages: list[str], words: Scores, triples: Scores, common: dict[str, frozenset[str]]):
        self.languages, self.words, self.triples, self.common = languages, words, triples, common
        self.unknown = len(languages)
        scripts = {x: Counter(map(script_of, common[x])).most_common(1)[0][0] for x in languages if common[x]}
        #: By script, which languages are not written in it; scripts of no language are left out.
        self.excluded = {s: np.array([scripts.get(x) != s for x in languages]) for s in set(scripts.values())}
        self._ids: dict[str, int] = {}
        self._rows: list[np.ndarray] = []
        self._often: list[list[bool]] = []
        self._scripts: list[int] = []

    def score(self, word: str) -> np.ndarray:
        excluded = self.excluded.get(script_of(word))
        if excluded is None:
            return np.array([-MOST] * self.unknown + [0.0])
        known = self.words.get(word)
        if known is None:
            marked = f" {word} "
            seen = [x for x in (self.triples.get(marked[i : i + 3]) for i in range(len(marked) - 2)) if x is not None]
            known = np.sum(seen, axis=0) * min(1.0, 4 / len(seen)) if seen else np.zeros(self.unknown)
            known = known - known.max()
        known = np.where(excluded, -np.inf, known)
        return np.append(np.clip(known - known.max() + MOST / 2, -MOST, MOST), -MOST)

    def ids(self, words: list[str]) -> list[int]:
        known = self._ids
        try:
            return [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = len(self._rows)
                    self._rows.append(self.score(w))
                    self._often.append([w in self.common[x] for x in self.languages] + [False])
                    self._scripts.append(script_of(w))
            return [known[w] for w in words]

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By id, the scores in each language, whether it is one of its common words, and the script."""
        shape = (len(self._rows), self.unknown + 1)
        return np.array(self._rows, float).reshape(shape), np.array(self._often, bool).reshape(shape), np.array(self._scripts, np.int64)

    def forget(self) -> None:
        if len(self._rows) > _REMEMBERED:
            self._ids, self._rows, self._often, self._scripts = {}, [], [], []


def _log_ratios(keys: list[str], counts: np.ndarray, totals: np.ndarray, smooth: float) -> Scores:
    """By key, the log of its frequency in each language, less the highest. counts: [keys, languages]."""
    if not keys:
        return Scores([], np.zeros((0, len(totals)), np.float32))
    totals = np.maximum(totals, 1).astype(float)
    v = np.log(counts / totals * totals.mean() + smooth / len(totals))
    return Scores(keys, (v - v.max(axis=1, keepdims=True)).astype(np.float32))


def labelled(texts: list[str | None], common: dict[str, frozenset[str]]) -> Iterator[tuple[str, list[str]]]:
    """(language, words) of the sentences in which the words of one language are clearly the most frequent."""
    languages = sorted(common)
    of: dict[str, list[int]] = {}
    for i, x in enumerate(languages):
        for w in common[x]:
            of.setdefault(w, []).append(i)
    for text in texts:
        for s in sentences(text) if text else []:
            found = _WORD.findall(" ".join(p for _, p in s).lower())
            if len(found) < SENTENCE:
                continue
            votes = [0] * len(languages)
            for w in found:
                for i in of.get(w, ()):
                    votes[i] += 1
            first = max(votes)
            best = votes.index(first)
            second = max((n for i, n in enumerate(votes) if i != best), default=0)
            if first >= 3 and first >= 1.5 * second and len({w for w in found if w in common[languages[best]]}) >= 2:
                yield languages[best], found


def fit(texts: list[str], common: dict[str, frozenset[str]]) -> Model:
    """A model of the common words' languages, from the sentences of texts at hand; `fit_all` does the same for a table."""
    languages = sorted(common)
    words: dict[str, Counter] = {x: Counter(dict.fromkeys(common[x], GIVEN)) for x in languages}
    triples: dict[str, Counter] = {x: Counter() for x in languages}
    for x, found in labelled(texts, common) if languages else ():
        words[x].update(found)
    for x in languages:
        for w, n in words[x].items():
            marked = f" {w} "
            for i in range(len(marked) - 2):
                triples[x][marked[i : i + 3]] += min(n, PER_WORD)

    def scores(counts: dict[str, Counter], smooth: float, least: int) -> Scores:
        keys = sorted({k for x in languages for k, n in counts[x].items() if n >= least})
        table = np.array([[counts[x][k] for x in languages] for k in keys], np.int64).reshape(len(keys), len(languages))
        return _log_ratios(keys, table, np.array([sum(counts[x].values()) for x in languages], np.int64), smooth)

    return Model(languages, scores(words, *WORDS), scores(triples, *TRIPLES), common)


def fit_all(segments: DataFrame, common: dict[str, frozenset[str]]) -> Model:
    """The model of `fit`, from the texts of all rows."""
    spark = segments.sparkSession
    languages = sorted(common)
    if not languages:
        return fit([], common)
    shared = spark.sparkContext.broadcast(common)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {x: Counter() for x in languages}

        def passed_on() -> pa.RecordBatch:
            columns = [[x for x in languages for _ in held[x]], [w for x in languages for w in held[x]], [n for x in languages for n in held[x].values()]]
            for x in languages:
                held[x].clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "key", "n"])

        for b in batches:
            for part in (b.slice(i, _TOGETHER) for i in range(0, b.num_rows, _TOGETHER)):
                for x, found in labelled(part.column(0).to_pylist(), shared.value):
                    held[x].update(found)
                if sum(map(len, held.values())) > _HELD:
                    yield passed_on()
        yield passed_on()

    counted = segments.filter("text IS NOT NULL").select("text").mapInArrow(count, "lang string, key string, n bigint")
    given = spark.createDataFrame([(x, w, GIVEN) for x in languages for w in sorted(common[x])], "lang string, key string, n bigint")
    words = checkpoint(counted.unionByName(given).groupBy("lang", "key").agg(F.sum("n").alias("n")))
    marked = F.concat(F.lit(" "), "key", F.lit(" "))
    each = F.transform(F.sequence(F.lit(1), F.length(marked) - 2), lambda i: F.substring(marked, i, F.lit(3)))
    triples = words.select("lang", F.explode(each).alias("key"), F.least("n", F.lit(PER_WORD)).alias("n")).groupBy("lang", "key").agg(F.sum("n").alias("n"))

    def scores(counts: DataFrame, smooth: float, least: int) -> Scores:
        total = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        by_language = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)]
        rows = counts.groupBy("key").agg(F.max("n").alias("most"), *by_language).filter(F.col("most") >= least).drop("most").toArrow()
        table = np.stack([rows.column(f"n{i}").to_numpy() for i in range(len(languages))], axis=1)
        return _log_ratios(rows.column("key").to_pylist(), table, np.array([total[x] for x in languages], np.int64), smooth)

    model = Model(languages, scores(words, *WORDS), scores(triples, *TRIPLES), common)
    discard(words)
    return model


def spans(texts: list[str | None], model: Model) -> list[list[tuple[str, int, int, int, int, float]]]:
    """Of each text, its spans (language, start, end, words, words of its longest sentence, confidence). Words in a script of no modelled language are in a span of that script's language, with a longest sentence of 0."""
    units: list[list[list[tuple[int, str]]]] = []
    ids: list[int] = []
    sizes: list[list[int]] = []
    for text in texts:
        own = sentences(text) if text else []
        counted = []
        for s in own:
            found = [w for _, p in s for w in _WORD.findall(p.lower())]
            ids.extend(model.ids(found))
            counted.append(len(found))
        units.append(own)
        sizes.append(counted)
    table, often, scripts = model.table()
    index = np.array(ids, np.int64)
    scores = table[index]
    sentence = np.repeat(np.arange(sum(map(len, sizes))), [n for x in sizes for n in x])
    begins = np.ones(len(ids), bool)
    begins[1:] = sentence[1:] != sentence[:-1]
    lengths = np.array([sum(x) for x in sizes], np.int64)
    path = switching_path(scores, lengths, np.where(begins, BETWEEN, INSIDE))
    text_of = np.repeat(np.arange(len(texts)), lengths)
    # Runs of one language (or script) in one sentence, then spans of one in one text.
    of = np.where(path == model.unknown, model.unknown + scripts[index], path.astype(np.int64)) if len(ids) else path
    cut = np.ones(len(ids), bool)
    cut[1:] = begins[1:] | (of[1:] != of[:-1])
    run_at = np.flatnonzero(cut)
    run_n = np.diff(np.append(run_at, len(ids)))
    if not len(run_at):
        return [[] for _ in texts]
    known = np.add.reduceat(often[index, path].astype(np.int64), run_at)
    prose = np.where(known >= COMMON * run_n, run_n, 0)
    fresh = np.ones(len(run_at), bool)
    fresh[1:] = (of[run_at][1:] != of[run_at][:-1]) | (text_of[run_at][1:] != text_of[run_at][:-1])
    out: list[list[tuple[str, int, int, int, int, float]]] = [[] for _ in texts]
    span_at = np.flatnonzero(fresh)
    total = np.add.reduceat(scores, run_at[span_at], axis=0)
    total[of[run_at[span_at]] < model.unknown, model.unknown] = -np.inf
    words = np.add.reduceat(run_n, span_at)
    longest = np.maximum.reduceat(prose, span_at)
    scaled = total / np.sqrt(words)[:, None]
    odds = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    sure = odds / odds.sum(axis=1, keepdims=True)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for i, r in enumerate(span_at):
        lang, where = int(of[run_at[r]]), int(text_of[run_at[r]])
        name = model.languages[lang] if lang < model.unknown else SCRIPTS[lang - model.unknown][2]
        first, n = int(run_at[r] - starts[where]), int(words[i])
        out[where].append((name, first, first + n, n, int(longest[i]), float(sure[i, min(lang, model.unknown)])))
    for where, found in enumerate(out):
        if found:
            out[where] = _located(texts[where], units[where], sizes[where], found)
    return out


def _located(text: str, own: list, counts: list[int], found: list) -> list:
    """The spans with offsets in the text for numbers of words; a text of one language is one span from end to end."""
    if len(found) == 1 and found[0][3] == sum(counts):
        lang, _, _, n, longest, sure = found[0]
        return [(lang, 0, len(text), n, longest, sure)]
    edges = sorted({x for s in found for x in (s[1], s[2] - 1)})
    places: dict[int, tuple[int, int]] = {}
    seen = k = 0
    for s, n in zip(own, counts, strict=True):
        if k < len(edges) and edges[k] < seen + n:
            at = [(o + m.start(), o + m.end()) for o, p in s for m in _WORD.finditer(p.lower())]
            while k < len(edges) and edges[k] < seen + n:
                places[edges[k]] = at[edges[k] - seen]
                k += 1
        seen += n
    return [(lang, places[a][0], places[b - 1][1], n, longest, sure) for lang, a, b, n, longest, sure in found]


def common_by_language(words: DataFrame, most: int = 100_000) -> dict[str, frozenset[str]]:
    """The words of each language of the table; it is small by definition, and a larger one is refused."""
    rows = words.filter("word IS NOT NULL AND lang IS NOT NULL").select("lang", F.lower("word").alias("word")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} common words")
    return {x: frozenset(r.word for r in rows if r.lang == x) for x in sorted({r.lang for r in rows})}


_SPAN = "id string, document_version_id string, lang string, start int, end int, words int, longest int, confidence double"


def language_spans(segments: DataFrame, words: DataFrame) -> DataFrame:
    """(id, document_version_id, lang, start, end, words, longest, confidence): the spans of one language in each segment, offsets within its text.

    `longest` is the number of words of the span's longest sentence, 0 if there is none with common words. Texts without words, null and empty ones have no
    span; repeated rows count once. Languages are those of the table of common words. If that is empty, so is the result.
    """
    spark = segments.sparkSession
    ship(spark)
    common = common_by_language(words)
    shared = spark.sparkContext.broadcast(fit_all(segments, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for part in (b.slice(i, _TOGETHER) for i in range(0, b.num_rows, _TOGETHER)):
                found = spans(part.column(2).to_pylist(), model) if model.languages else [[] for _ in range(part.num_rows)]
                model.forget()
                at = np.repeat(np.arange(len(found)), [len(x) for x in found])
                rows = [s for x in found for s in x]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                    names=["id", "document_version_id", "lang", "start", "end", "words", "longest", "confidence"],
                )

    return segments.select("id", "document_version_id", "text").mapInArrow(run, _SPAN).distinct()


def declared(versions: DataFrame, tags: DataFrame) -> DataFrame:
    """(document_version_id, declared): the language that a version's tag means; null for none. One row for each version."""
    meaning = tags.filter("tag IS NOT NULL").groupBy("tag").agg(F.max("lang").alias("declared"))
    own = versions.filter("id IS NOT NULL").select(F.col("id").alias("document_version_id"), F.col("lang").alias("tag"))
    return own.join(meaning, "tag", "left").groupBy("document_version_id").agg(F.max("declared").alias("declared"))


def undeclared_languages(segments: DataFrame, versions: DataFrame, tags: DataFrame, words: DataFrame) -> DataFrame:
    """(segment_id, lang) for each language of which a segment holds a sentence of `SENTENCE` or more words, if that isn't the declared one."""
    found = language_spans(segments, words).filter(F.col("longest") >= SENTENCE).select("id", "document_version_id", "lang").distinct()
    told = found.join(declared(versions, tags), "document_version_id", "left")
    return told.filter("declared IS NULL OR declared != lang").select(F.col("id").alias("segment_id"), "lang").distinct()


def document_languages(segments: DataFrame, words: DataFrame) -> DataFrame:
    """(document_version_id, lang, confidence, words): the language of most words of each version with a word of a known language; of
    equal ones the first by code. confidence: its share of the words, times the mean confidence of its spans."""
    totals = language_spans(segments, words).groupBy("document_version_id", "lang").agg(F.sum("words").alias("words"), (F.sum(F.col("words") * F.col("confidence")) / F.sum("words")).alias("sure"))
    by = W.partitionBy("document_version_id")
    ranked = totals.withColumns({"all": F.sum("words").over(by), "rank": F.row_number().over(by.orderBy(F.desc("words"), "lang"))})
    return ranked.filter("rank = 1").select("document_version_id", "lang", (F.col("sure") * F.col("words") / F.col("all")).alias("confidence"), "words")
