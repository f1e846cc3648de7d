"""Splitting, tokens, packing, quality and languages."""

import random
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.llm import hmm, language, packing, quality, splitting, tokens

SEGMENT = "id string, document_version_id string, text string, char_start int, char_end int, locators array<struct<kind string, line int, page int, start int, end int>>"


# Splitting


def check_pieces(text, limit=2000, overlap=150):
    found = splitting.pieces(text, limit, overlap)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for i, (start, end, _) in enumerate(found):
        assert 0 <= end - start <= limit
        if i:
            assert start == max(0, found[i - 1][1] - overlap) and end > found[i - 1][1]
    return found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "word ", ". ", "! ", "\n", "\r\n", "\n\n", " \n \n", "# h\n", "- x\n", "w" * 30, "é", " "]), max_size=200), st.integers(10, 60), st.integers(0, 9))
def test_pieces_cover_the_text_within_the_limit(parts, limit, overlap):
    check_pieces("".join(parts), limit, overlap)


def test_cuts_are_at_the_coarsest_boundaries():
    text = "a" * 1500 + "\n\n" + "b" * 1500 + "\n\n" + "c" * 200
    assert splitting.pieces(text) == [(0, 1502, "paragraph"), (1352, 3204, "end")]
    assert [k for *_, k in splitting.pieces("x" * 4100)] == ["none", "none", "end"]
    assert [k for *_, k in splitting.pieces("word " * 900)] == ["word", "word", "end"]
    assert splitting.pieces("# one\n" + "a b. " * 300 + "\n# two\n" + "c d. " * 300)[0][2] == "section"


@pytest.mark.parametrize(
    ("text", "kind"),
    [("\n\n a b. c\n", "sentence"), ("a\n \t\nb", "paragraph"), ("a\r\n\r\nb", "paragraph"), ("a\nb. c", "line"), ("a.b c", "word"), ("  abc\n\n", "none"), ("", "none"), ("a\rb", "word")],
)
def test_coarsest_boundary(text, kind):
    assert splitting.boundary(text, splitting.tree(text)) == kind


def shape(node):
    return (node.kind, [shape(c) for c in node.children]) if node.children else node.kind


def test_tree_of_headings_lists_and_markup():
    text = "# a\nx\n## b\n- one\n  more\n  - inner\n- two\n\n# c\n<ul>\n<li>p</li>\n<li>q</li>\n</ul>\nlast\n"
    b = ("section", ["line", ("paragraph", [("entry", ["line", "line", ("entry", ["line"])]), ("entry", ["line"])])])
    a = ("section", ["line", ("paragraph", ["line"]), b])
    c = ("section", ["line", ("block", ["line", ("paragraph", ["line", "line", "line"])]), ("paragraph", ["line"])])
    root = splitting.tree(text)
    assert shape(root) == ("section", [a, c])
    assert [(n.start, n.end) for n in root.children] == [(0, text.index("# c")), (text.index("# c"), len(text))]


def test_siblings_are_merged_bottom_up_and_only_oversized_nodes_are_parted():
    parts = [f"## {i}\n" + "word. " * n + "\n" for i, n in enumerate((40, 40, 40, 700, 20, 20))]
    text = "# all\n" + "".join(parts)
    found = check_pieces(text)
    ends = [e for _, e, _ in found]
    begins = [text.index(p) for p in parts]
    assert begins[3] in ends and found[0][2] == "section"  # three small sections stay together, before the large one
    assert {k for *_, k in found[1:-1]} == {"sentence"} and not any(b in ends for b in (*begins[:3], begins[5]))
    deep = "\n".join(" " * i + "- x" for i in range(3000))
    check_pieces(deep)


def test_piece_checks(spark):
    long = "Some words here. " * 300
    df = spark.createDataFrame([("a", "d", long, 5, 9, None), ("b", "d", "x\n" * 1500, None, None, None), ("c", "d", "y", 0, 1, None)], SEGMENT)
    assert {tuple(r) for r in splitting.piece_checks(df).collect()} == {("a", len(long), 0, 0, 0), ("b", 3000, 0, 0, 0)}


def test_split_segments(spark):
    long = "Some words here. " * 300
    where = [("s", 0, None, 70, 70 + len(long))]
    rows = [("a", "d", long, 5, 9, where), ("a", "d", long, 5, 9, where), ("b", "d", long, 11, 12, None), ("c", None, long, None, None, None), ("d", "d", "short", 0, 5, None), ("e", "d", None, 0, 5, None), (None, "d", "z" * 2001, 3, 4, None)]
    df = spark.createDataFrame(rows, SEGMENT).selectExpr("*", "1 AS piece_no", "'x' AS start", "id AS segment_id")
    got = splitting.split_segments(df).collect()
    by = {k: sorted((r for r in got if r.segment_id == k), key=lambda r: r.piece_no) for k in ("a", "b", "c", None)}
    assert len(got) == sum(map(len, by.values())) and len(by["a"]) == 3
    assert by["a"][0].char_start == 70 and by["a"][-1].char_end == 70 + len(long) and by["b"][0].char_start == 11 and by["c"][0].char_start is None
    assert all(r.text == long[r.char_start - 70 : r.char_end - 70] for r in by["a"])
    assert all(b.text[:150] == a.text[-150:] for a, b in zip(by["a"], by["a"][1:]))
    assert {tuple(r) for r in splitting.oversized_boundaries(df).collect()} == {("a", "sentence"), ("b", "sentence"), ("c", "sentence"), (None, "none")}
    assert splitting.split_segments(df.limit(0)).collect() == []


# Tokens


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.read_ranks())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300))
def test_tokens_round_trip(text):
    e = tokens.encoder(tokens.read_ranks())
    assert tokens.decode(e, tokens.encode(e, text)) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "  ", "\n", "'s", "é", "12", "!?", "　", "<|endoftext|>"]), max_size=400), st.integers(1, 30))
def test_runs_give_the_ids_of_the_whole(parts, limit):
    e, text = tokens.encoder(tokens.read_ranks()), "".join(parts)
    runs = list(tokens.runs(text, limit))
    assert "".join(runs) == text and [i for r in runs for i in e.encode_ordinary(r)] == e.encode_ordinary(text)


def test_token_ids(spark, enc):
    rows = [(1, "Hello world"), (2, ""), (3, None), (1, "Hello world"), (4, "<|endoftext|>"), (5, "word " * 60_000), (6, "x" * 200_000), (None, "a\x00b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "7 AS ids", "'t' AS _text", "0 AS n_tokens")
    got = tokens.token_ids(df, "doc_id").collect()
    want = sorted(((k, enc.encode_ordinary(t) if t else []) for k, t in rows), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == want
    assert {(r.doc_id, r.n_tokens) for r in tokens.token_counts(df, "doc_id").collect()} == {(k, len(x)) for k, x in want}
    back = tokens.token_texts(tokens.token_ids(df, "doc_id"), "doc_id").collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((k, t or "") for k, t in rows), key=repr)
    assert tokens.token_ids(df.limit(0), "doc_id").collect() == []


# Packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 3), st.integers(0, 50)), max_size=120))
def test_containers_keep_their_limits(items):
    limits = np.array([50, 6, 60])
    demands = np.array(items, np.int64).reshape(-1, 3)
    at = packing.fill(demands, limits)
    assert len(at) == len(items)
    for c in set(at.tolist()):
        assert (demands[at == c].sum(axis=0) <= limits).all()
    if len(items):
        assert set(at.tolist()) == set(range(max(at) + 1))


def test_packing_wastes_little():
    rng = np.random.default_rng(3)
    n = rng.integers(5, 900, 5000)
    at = packing.fill(np.stack([n, np.ones_like(n), n - 1], axis=1), np.array([2048, 64, 2048]))
    assert (at.max() + 1) <= 1.01 * n.sum() / 2048 + 1


def test_pack(spark):
    rows = [("a", 5000), ("b", 0), ("c", None), ("d", 2048), ("e", 1), ("f", 900), ("f", 900), (None, 10), ("g", 2049)]
    df = spark.createDataFrame(rows, "k string, n_tokens bigint").selectExpr("*", "1 AS shard", "2 AS piece", "3 AS item", "4 AS container_id")
    got = packing.pack(df, "k").collect()
    assert sorted((r.k or "", r.n_tokens) for r in got) == [("", 10), ("a", 904), ("a", 2048), ("a", 2048), ("d", 2048), ("e", 1), ("f", 900), ("f", 900), ("g", 1), ("g", 2048)]
    assert sorted(r.token_start for r in got if r.k == "a") == [0, 2048, 4096]
    room = {}
    for r in got:
        room[r.container_id] = room.get(r.container_id, 0) + r.n_tokens
    assert max(room.values()) <= 2048 and len(room) == 6
    assert packing.pack(df.limit(0), "k").collect() == []
    tight = packing.pack(spark.createDataFrame([(i, 10, 10) for i in range(9)] + [(9, 30, 30)], "k int, n_tokens int, n_loss int"), "k", 40, 3, 20).collect()
    for c in {r.container_id for r in tight}:
        assert sum(r.n_tokens for r in tight if r.container_id == c) <= 20


def test_all_three_limits_bind(spark):
    rows = [(i, "p " * 40 + "\n" + "word " * (50 + i % 7 * 30)) for i in range(400)] + [(400 + i, "tiny") for i in range(60)] + [(900, "say " * 700), (901, None), (902, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 AS piece_no")
    sizes = {r.doc_id: (r.n_tokens, r.n_loss) for r in packing.instruction_sizes(df).collect()}
    got = packing.pack_instructions(df, 1000, 5, 600).collect()
    inside = {}
    for r in got:
        n, loss = sizes[r.doc_id]
        assert r.n_tokens == n or r.doc_id == 900
        now = inside.setdefault(r.container_id, [0, 0, 0])
        for k, x in enumerate((r.n_tokens, 1, loss if r.n_tokens == n else r.n_tokens)):
            now[k] += x
    assert {r.doc_id for r in got} == {r[0] for r in rows if r[1]} and all(a <= 1000 and b <= 5 and c <= 600 for a, b, c in inside.values())
    # Each limit leaves room in the other two somewhere.
    assert any(b == 5 and a < 900 and c < 500 for a, b, c in inside.values()) and any(c > 500 and b < 5 and a < 950 for a, b, c in inside.values())
    assert [tuple(r) for r in packing.pack_checks(df).collect()] == [(461, 0, 0, 0)]


# Hidden Markov models


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_against_all_paths(seed):
    from itertools import product

    rng = np.random.default_rng(seed)
    lengths = [3, 0, 1, 5, 4]
    scores, t, pen = rng.normal(size=(sum(lengths), 3)), rng.normal(size=(3, 3)), rng.random(sum(lengths)) * 2
    best, moved, at = [], [], 0
    for n in lengths:
        s, p = scores[at : at + n], pen[at : at + n]
        value = lambda x: sum(s[i, x[i]] for i in range(n)) + sum(t[x[i - 1], x[i]] for i in range(1, n))  # noqa: B023, E731
        cost = lambda x: sum(s[i, x[i]] for i in range(n)) - sum(p[i] for i in range(1, n) if x[i] != x[i - 1])  # noqa: B023, E731
        best += max(product(range(3), repeat=n), key=value)
        moved += max(product(range(3), repeat=n), key=cost)
        at += n
    assert hmm.viterbi(scores, np.array(lengths), t).tolist() == best
    assert hmm.switching_path(scores, np.array(lengths), pen).tolist() == moved
    assert hmm.viterbi(np.zeros((0, 3)), np.array([0, 0]), t).tolist() == []


# Quality

COMMON = frozenset("the of and to in is was that for it with as on by at be this not are from have had an but they were".split())


@pytest.mark.parametrize(
    ("text", "shape"),
    [
        ("This is the story of a house that was built on the hill, and it was not a small one.", "prose"),
        ("this is the story of a house that was built\non the hill and it was not a small one but\nthey were happy in it for many years to come", "prose"),
        ("- milk\n- bread\n- a pound of butter\n- eggs, 12 x", "list"),
        ("survey sketch\nwater reading: AX-2211\nclaim register 12 x\nlease annex\nrepair estimate, REF-99102", "list"),
        ("- This is the story of a house that was built on the hill.\n- They were not happy in it for many years.\n* It was not theirs, and they had to be there.", "list"),
        ("day;qty;ref\n2031-01-02;12;AX-1\n2031-01-03;13;AX-2\n", "table"),
        ("| a | b |\n|---|---|\n| 12 | x |\n| 13 | y |", "table"),
        ("qty   lot     site\n12    AX-1    north\n13    AX-2    south", "table"),
        ("print " * 80, "junk"),
        ("aGVsbG8gd29ybGQhIHRoaXMgaXMgYmFzZTY0IGRhdGEgd2l0aG91dCBtZWFuaW5n" * 3, "junk"),
        ('<td class="c1">&nbsp;<br/><div class="c2">0</div><span class="c3"></td>' * 3, "junk"),
        ("\x0b \n\t", "blank"),
        ("", "blank"),
        (None, None),
    ],
)
def test_shapes(text, shape):
    assert quality.statistics([text], COMMON)[0][-1] == shape


def test_fitting_keeps_what_is_plain_and_learns_the_rest():
    prose = "This is the story of a house that was built on the hill, and it was not a small one."
    texts = [prose, "- milk\n- bread\n- eggs, 12 x", "day;qty;ref\n2031-01-02;12;AX-1\n2031-01-03;13;AX-2\n", "print " * 80, ""] * 40
    fitted = quality.fit(texts, COMMON)
    assert [x[-1] for x in quality.statistics(texts[:5], COMMON, fitted)] == ["prose", "list", "table", "junk", "blank"]
    names = list(quality.START)
    assert fitted.shape == (len(names), 4) and fitted[names.index("mark"), 1] > 0.5 > fitted[names.index("mark"), 0] and ((0 < fitted) & (fitted < 1)).all()
    assert (quality.fit([], COMMON) == np.array(list(quality.START.values()))).all()


def test_text_statistics(spark):
    rows = [(1, "The cat sat.\n\nIt was on the mat; (12)"), (1, "The cat sat.\n\nIt was on the mat; (12)"), (2, None), (3, " \n"), (None, "It was the cat."), (4, "word " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n_words", "2 AS shape")
    words = spark.createDataFrame([("en", "the"), ("en", "was"), ("en", None), (None, "on")], "lang string, word string")
    got = sorted(quality.text_statistics(df, words).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    first = got[0]
    assert len(got) == 6 and first.n_words == 8 and first.mean_word_length == 22 / 8 and first.end_punctuation == 0.5
    assert first.common_share == 4 / 8 and abs(first.symbol_ratio - 4 / 28) < 1e-9
    assert [r["shape"] for r in got if r.doc_id in (2, 3)] == [None, "blank"]
    assert {tuple(r) for r in quality.unnatural(df.filter("doc_id IS NULL OR doc_id > 1"), words).collect()} == {(4, "junk")}
    assert quality.text_statistics(df.limit(0), words.limit(0)).collect() == []


# Languages

SENTENCES = {
    "en": "The clerk has not found the letter that was in the folder on the table.",
    "de": "Der Hausmeister hat den Karton nicht gefunden und er ist auf dem Tisch.",
    "fr": "Le gardien ne sait pas qui a pris la lettre dans le dossier de la salle.",
}
WORDS = {
    "en": "the of and to in is was that for it with as on by has not".split(),
    "de": "der die das und in zu den mit ist von auf für nicht er dem hat".split(),
    "fr": "le la les de des et en un une du que est pour qui dans ne pas a".split(),
}


def test_spans_of_mixed_text(spark):
    mixed = f"{SENTENCES['en']} {SENTENCES['en']}\n\n> {SENTENCES['de']}\n> {SENTENCES['de']}"
    rows = [("a", "v1", SENTENCES["en"]), ("a", "v1", SENTENCES["en"]), ("b", "v1", mixed), ("c", "v2", SENTENCES["fr"] * 30), ("d", None, None), ("e", "v3", ""), ("f", "v3", "Протокол осмотра места"), ("g", "v3", "AX-1 | 12 | 3\nAX-2 | 13 | 4"), ("h", "v4", f"{SENTENCES['de'].lower().strip('.')} " * 3)]
    segments = spark.createDataFrame(rows, "id string, document_version_id string, text string").selectExpr("*", "1 AS lang", "2 AS start")
    words = spark.createDataFrame([(k, w) for k, x in WORDS.items() for w in x], "lang string, word string")
    spans = {r.id: [] for r in segments.collect()}
    for r in language.language_spans(segments, words).collect():
        spans[r.id].append(r)
        assert 0 <= r.confidence <= 1
    assert [r.lang for r in spans["a"]] == ["en"] and [r.lang for r in spans["c"]] == ["fr"] and [r.lang for r in spans["h"]] == ["de"]
    b = sorted(spans["b"], key=lambda r: r.start)
    assert [r.lang for r in b] == ["en", "de"] and mixed[b[1].start : b[1].end].startswith("Der") and mixed[b[0].start : b[0].end].endswith("table")
    assert not spans["d"] and not spans["e"] and [(r.lang, r.longest) for r in spans["f"]] == [("und-Cyrl", 0)]
    versions = spark.createDataFrame([("v1", "en-GB"), ("v1", "en-GB"), ("v2", "??"), ("v4", None)], "id string, lang string")
    tags = spark.createDataFrame([("en-GB", "en"), ("xx", None), (None, "de")], "tag string, lang string")
    assert {tuple(r) for r in language.undeclared_languages(segments, versions, tags, words).collect()} == {("b", "de"), ("c", "fr"), ("h", "de")}
    assert {(r.document_version_id, r.lang) for r in language.document_languages(segments, words).collect()} >= {("v1", "en"), ("v2", "fr"), ("v4", "de")}
    for empty in (segments.limit(0), segments):
        assert language.language_spans(empty, words.limit(0)).collect() == []


def test_held_out_accuracy():
    common = {k: frozenset(v) for k, v in WORDS.items()}
    model = language.fit([s for s in SENTENCES.values() for _ in range(5)], common)
    for lang, text in {"en": "It is not that the letter was found by the clerk in the hall.", "de": "Er ist nicht auf dem Tisch und der Hausmeister hat den Karton.", "fr": "Le dossier de la salle est dans la lettre qui ne sait pas."}.items():
        assert [s[0] for s in language.spans([text], model)[0]] == [lang]


def test_list_entries_and_addresses_are_no_sentences():
    assert all(len(language._WORD.findall(" ".join(p for _, p in s))) < 8 for s in language.sentences("1. one of the two\n2. three of the four\n3. five of the six\nx@y.z of the and to in is was that"[:60]))
    assert len(language.sentences("a b c\n\nd e f. g h")) == 3
    assert random and datetime


@pytest.mark.parametrize(
    ("word", "script"),
    [("straße", "Latin"), ("aujourd'hui", "Latin"), ("слово", "Cyrillic"), ("λόγος", "Greek"), ("שלום", "Hebrew"), ("كلمة", "Arabic"), ("शब्द", "Devanagari"), ("คำ", "Thai"), ("단어", "Hangul"), ("文字です", "Kana"), ("文字", "Han"), ("ᚠᚢ", "other"), ("xслово", "Cyrillic")],
)
def test_scripts(word, script):
    assert language.SCRIPTS[language.script_of(word)][0] == script


def test_scripts_narrow_the_candidates():
    common = {x: frozenset(WORDS[x]) for x in WORDS} | {"ru": frozenset("и в не на что он с как это по но из".split())}
    model = language.fit(list(SENTENCES.values()) * 5, common)
    assert np.argmax(model.score("неизвестное")) == model.languages.index("ru") and model.score("letter")[model.languages.index("ru")] == -language.MOST
    text = f"{SENTENCES['en']} Это письмо не было в папке на столе и он это знал. Η επιστολή δεν ήταν εδώ. {SENTENCES['de']}"
    found = language.spans([text, "手紙はありませんでした。", None], model)
    assert [x[0] for x in found[0]] == ["en", "ru", "el", "de"] and [x[0] for x in found[1]] == ["ja"] and found[2] == []
    assert all(0 <= x[5] <= 1 for x in found[0]) and text[found[0][2][1] : found[0][2][2]].startswith("Η") and found[0][2][4] == 0


def test_the_model_is_fitted_to_all_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "_HELD", 50)
    common = {k: frozenset(v) for k, v in WORDS.items()}
    texts = [f"{SENTENCES[x]} {SENTENCES[x].replace(old, new)}" for x, old, new in (("en", "clerk", "warden"), ("de", "Karton", "Ordner"), ("fr", "lettre", "clé"))] * 1500
    # What three of 4503 texts alone say counts as well.
    rare = ["The quorvath has not been on the table that was in the hall.", "It is the quorvath that was not in the hall for the day.", "The quorvath was with the clerk and has not been in the hall."]
    texts += rare
    segments = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate([*texts, None, ""])], "id string, text string").repartition(7)
    model, whole = language.fit_all(segments, common), language.fit(texts, common)
    assert model.languages == whole.languages
    for a, b in ((model.words, whole.words), (model.triples, whole.triples)):
        assert (a.hashes == b.hashes).all() and (a.rows == b.rows).all()
    assert model.words.get("quorvath") is not None and model.words.get("nowhere") is None
    for one in ({"en": common["en"]}, {}):
        assert language.fit_all(segments, one).languages == sorted(one)
    assert language.fit_all(segments.limit(0), common).words.get("the") is not None


def test_spans_depend_on_words_of_all_texts(spark):
    # "vandrel" stands in two German texts of 9000, so that a part of them leaves it unknown.
    rows = [(f"s{i}", "v", SENTENCES["fr"]) for i in range(9000)] + [(f"d{i}", "v", f"Der vandrel ist nicht auf dem Tisch und er hat den vandrel nicht. {i}") for i in range(2)]
    segments = spark.createDataFrame(rows, "id string, document_version_id string, text string")
    common = {k: frozenset(v) for k, v in WORDS.items()}
    score = language.fit_all(segments, common).score("vandrel")
    assert score[1] < score[0] and score[2] < score[0]
    words = spark.createDataFrame([(k, w) for k, x in WORDS.items() for w in x], "lang string, word string")
    assert {(r.id, r.lang) for r in language.language_spans(segments, words).filter("id LIKE 'd%'").collect()} == {("d0", "de"), ("d1", "de")}
