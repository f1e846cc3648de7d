"""Newly written lines of e-mails."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import mail

ANN, BOB = "Ann Lee <ann.lee@here.test>", "bob.roe@there.test"
P1 = "We have checked the register against the copy and both agree on every line of it."
P2 = "Please send the estimate to the depot as soon as the missing pages have been signed."
P3 = "The key of the cabinet was returned by the caretaker before the second meeting began."


def lines(text, sender=ANN, receiver=BOB):
    return sorted({k for u in mail.candidates(text, sender, receiver) if u.kind != "edge" for k in u.lines})


@pytest.mark.parametrize(
    ("text", "new"),
    [
        (f"Hi Bob,\n\n{P1}\n\nKind regards,\nAnn Lee\nRecords\nTel. +1 555", [0, 2]),
        (f"Hi Bob,\n\n{P1}\n\nCheers\n\nPS {P2}", [0, 2, 6]),
        (f"{P1}\n\n-- \nAnn Lee\nann.lee@here.test\n\nP.S. {P2}", [0, 6]),
        (f"{P1}\n\nOn 2 May 2031 at 10:00, Bob Roe\n<bob.roe@there.test> wrote:\n> {P2}\n>\n> {P3}", [0]),
        (f"Bob Roe wrote:\n» {P2}\n\n{P1}\n\n» {P3}\n\nAnn", [3]),
        (f"{P1}\n\n-----Original Message-----\nFrom: Bob Roe\nSent: 2031-01-01\nTo: Ann\nSubject: x\n\n{P2}\n\n<AL> {P3}\n\n<BR> {P1}", [0, 10]),
        (f"From: our side there is nothing to add, because the folder wrote itself.\n\n{P1}\n\nAnn", [0, 2]),
        (f"> The claim register was found by the\ncaretaker in the hall.\n\n{P1}", [3]),
        (f"[EXTERNAL]\n{P1}\n\nSent from my phone", [1]),
        (f"{P1}\n\nThis message is confidential; if it reached you by mistake, please delete it.", [0]),
        (f"{P1}\r\n\r\n&gt; {P2}\r\n: {P3}", [0]),
        ("| a | b |\n| 1 | 2 |", [0, 1]),
        ("", []),
        (" \n\t", []),
        ("Cheers\nAnn", []),
    ],
)
def test_marks(text, new):
    assert lines(text) == new


def test_unknown_senders_and_long_mails():
    assert lines(f"{P1}\n\nCheers\nSomebody", None, None) == [0, 3]
    text = "\n\n".join([P1, f"> {P2}"] * 20_000)
    assert len(lines(text)) == 20_000


def test_simhash():
    prints = mail.simhash([P1, P1.replace("register", "rcgister"), P2, "", P1])
    apart = lambda i, j: sum(bin(int(x)).count("1") for x in prints[i] ^ prints[j])
    assert prints.shape == (5, mail.BITS // 16) and apart(0, 4) == 0 < apart(0, 1) < mail.BITS * 0.15 < mail.BITS * 0.3 < apart(0, 2)
    assert mail.table_keys(prints).shape == (5, mail.TABLES) and mail.simhash([]).shape == (0, mail.BITS // 16)


SEGMENTS = "id string, text string"
HEADERS = "segment_id string, message_id string, in_reply_to string, from_addr string, to_addr string, sent_at timestamp_ntz, received_at timestamp_ntz"


def frames(spark, mails):
    segments = [(k, text) for k, text, *_ in mails]
    headers = [(k, None, None, sender, receiver, at, None) for k, _, sender, receiver, at in mails]
    return spark.createDataFrame(segments, SEGMENTS).selectExpr("*", "1 AS line_no", "2 AS unit", "'t' AS at"), spark.createDataFrame(headers, HEADERS)


def test_answers_quoted_again_are_inherited(spark):
    day = lambda n: datetime(2031, 1, n)
    head = "From: Bob Roe\nSent: 2031-01-02\nTo: Ann Lee\nSubject: x"
    first = f"{head}\n\n{P2}\n\nAL: {P1}"
    later = f"{P3}\n\n{head}\n\n{P2}\n\nAL: {P1}\n\nAL: Nobody has asked for the witness statement since the third week."
    mails = [("a", first, ANN, BOB, day(3)), ("b", later, ANN, BOB, day(5)), ("c", later, ANN, "else@there.test", day(6)), ("d", later, ANN, BOB, None), ("a", first, ANN, BOB, day(3)), ("e", None, ANN, BOB, day(1)), ("f", "", None, None, day(1))]
    segments, headers = frames(spark, mails)
    got = {}
    for r in mail.new_lines(segments, headers).collect():
        got.setdefault(r.segment_id, []).append(r.line_no)
    assert {k: sorted(v) for k, v in got.items()} == {"a": [7], "b": [0, 11], "c": [0], "d": [0, 9, 11]}


def fresh(spark, mails):
    return {(r.segment_id, r.line_no) for r in mail.new_lines(*frames(spark, mails)).collect()}


def test_runs_of_inherited_sentences_go_and_single_ones_stay(spark):
    mails = [("a", f"{P1} {P2}", ANN, BOB, datetime(2031, 1, 1)), ("b", f"{P1} {P2}\n\n{P3}", BOB, ANN, datetime(2031, 1, 2)), ("c", f"All of it was moved to the new hall in the spring.\n\n{P2}\n\nIt is done.", BOB, ANN, datetime(2031, 1, 1))]
    assert fresh(spark, mails) == {("a", 0), ("b", 2), ("c", 0), ("c", 2), ("c", 4)}


def test_text_without_marks_is_inherited_whoever_wrote_it_to_whom(spark):
    body = f"{P1}\n\n{P2} Fine.\n\n{P3}"
    misread = body.replace("register", "reg1ster".replace("1", "l")).replace("missing", "rnissing")
    mails = [("a", body, ANN, BOB, datetime(2031, 1, 1)), ("b", f"Dear Cy,\n\n{misread}\n\nIs that what you have been told by them?", BOB, "cy@else.test", datetime(2031, 1, 2))]
    mails.append(("c", f"Nothing of what they say can be found in our own books.\n\n{body}", "dee@far.test", "eve@far.test", datetime(2031, 1, 3)))
    mails.append(("d", body, "dee@far.test", "eve@far.test", None))
    assert fresh(spark, mails) == {("a", 0), ("a", 2), ("a", 4), ("b", 0), ("b", 8), ("c", 0), ("d", 0), ("d", 2), ("d", 4)}


def test_other_numbers_are_new_text(spark):
    body = "The first of the readings came to {} units at the gate. The second of the readings came to {} units at the hall."
    mails = [("a", body.format(250, 1044), ANN, BOB, datetime(2031, 1, 1)), ("b", body.format(250, 1045), ANN, BOB, datetime(2031, 1, 2)), ("c", body.format(250, 1044), ANN, BOB, datetime(2031, 1, 3))]
    assert fresh(spark, mails) == {("a", 0), ("b", 0)}


def test_phrases_that_many_use_in_a_row_are_not_inherited(spark):
    words = ["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega", "iota", "theta", "zeta", "rho", "tau", "chi"]
    mails = [(f"m{i}", f"The {w} of the old shed was seen by nobody at all. {P1} {P2}", f"{w}@here.test", BOB, datetime(2031, 1, 1 + i)) for i, w in enumerate(words)]
    assert {(f"m{i}", 0) for i in range(13)} == fresh(spark, mails)


def test_boilerplate_is_what_many_mails_end_with(spark):
    slogan = "Better storage for better days with our friendly teams."
    own = ["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega"]
    mails = [(f"m{i}", f"{P1.replace('register', w)}\n\nCheers\nAnn\n\n{slogan}", f"{w}@here.test", BOB, datetime(2031, 1, 1)) for i, w in enumerate(own)]
    got = {(r.segment_id, r.line_no) for r in mail.new_lines(*frames(spark, mails)).collect()}
    assert not any(n == 5 for _, n in got) and {(f"m{i}", 0) for i in range(7)} <= got


def test_copies_of_a_mail_make_no_boilerplate(spark):
    text = f"{P1}\n\nCheers\nAnn\n\nThe second copy of the letter is in the folder on the shelf."
    got = {(r.segment_id, r.line_no) for r in mail.new_lines(*frames(spark, [(f"m{i}", text, ANN, BOB, None) for i in range(9)])).collect()}
    assert got == {(f"m{i}", k) for i in range(9) for k in (0, 5)}


def test_empty_tables(spark):
    segments, headers = frames(spark, [("a", P1, ANN, BOB, None)])
    assert mail.new_lines(segments.limit(0), headers).collect() == [] and mail.new_lines(segments, headers.limit(0)).collect() == []
    assert [tuple(r) for r in mail.new_lines(segments, headers).collect()] == [("a", 0)]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _misread(rng, text, n):
    """The text with up to n letters or digits replaced, left out or put in."""
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        chars[k : k + 1] = rng.choice([["x"], ["7"], [], [chars[k], "q"]])
    return "".join(chars)


WORDS = [w.lower().strip(".") for w in f"{P1} {P2} {P3} 1047 grüße".split()]


def test_most_texts_within_the_edits_are_found(spark):
    rng = random.Random(7)
    old = [" ".join(rng.choices(WORDS, k=rng.randrange(8, 40))) for _ in range(1500)]
    asked = [(i, t, _misread(rng, t, max(1, int(len(t) * mail.EDITS * (i % 3 + 1) / 3)))) for i, t in enumerate(old)]
    wanted = {i for i, t, m in asked if t != m and [w for w in m if w.isdigit()] == [w for w in t if w.isdigit()] and _distance(t, m) <= int(max(len(t), len(m)) * mail.EDITS)}
    day = datetime(2031, 1, 1)
    rows = [(i, t, 2, day, None) for i, t, _ in asked] + [(10_000 + i, m, 3, datetime(2031, 1, 2), datetime(2031, 1, 2)) for i, _, m in asked if i in wanted]
    texts = spark.createDataFrame(rows, "id bigint, text string, role tinyint, since timestamp_ntz, until timestamp_ntz")
    found = {(r.id, r.old) for r in mail.near_earlier(texts).collect()}
    assert len(wanted) > 600 and len([i for i in wanted if (10_000 + i, i) in found]) >= 0.9 * len(wanted)


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_crowded_entries_are_parted_and_give_the_same_kind_of_result(spark, monkeypatch, sent):
    monkeypatch.setattr(mail, "ENTRY", 4)
    monkeypatch.setattr(mail, "SENT_KEYS", sent)
    rng = random.Random(9)
    old = [f"{' '.join(rng.choices(WORDS, k=3))} {P1.lower()} {P2.lower()}" for _ in range(300)]
    day = datetime(2031, 1, 1)
    rows = [(i, t, 2, day, None) for i, t in enumerate(old)] + [(10_000 + i, _misread(random.Random(i), t.replace("1047", "x"), 1).replace("7", "x"), 3, datetime(2031, 1, 2), datetime(2031, 1, 2)) for i, t in enumerate(old) if "1047" not in t]
    texts = spark.createDataFrame(rows, "id bigint, text string, role tinyint, since timestamp_ntz, until timestamp_ntz")
    found = {r.id for r in mail.near_earlier(texts).collect()}
    assert len(found) >= 0.9 * sum(r[2] == 3 for r in rows)


@pytest.mark.parametrize(("entry", "small"), [(20_000, 64), (40, 64), (100, 8)])
def test_every_text_within_the_edits_is_found(spark, monkeypatch, entry, small):
    monkeypatch.setattr(mail, "ENTRY", entry)
    monkeypatch.setattr(mail, "_SMALL", small)
    rng = random.Random(11)
    old = [" ".join(rng.choices(WORDS, k=k)) for k in [4, 5, 6, 7, 8, 9, 10, 12, 16, 20, 26, 33, 40, 52, 70, 90, 150] * 6 + [700]]
    texts = {}
    for t in old:
        # As many edits as there may be, far apart; letters alone.
        chars, most = list(t), int(len(t) * mail.EDITS)
        for i in range(most):
            at = next(j for j in range(i * len(t) // most, len(t)) if t[j].isalpha())
            chars[at] = rng.choice(["x", "", chars[at] + "q"])
        texts |= dict.fromkeys(["".join(chars), t])
    texts |= dict.fromkeys(["12 boxes of the old papers were found", "q12 boxes of the old papers were found", "13 boxes of the old papers were found", "twelve letters and more.", "twelve letters and more..", "ten letters and no more.", "ten letters and no mores"])
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").selectExpr("*", "CAST(3 AS tinyint) AS role").cache()
    pairs = rows.alias("a").join(rows.alias("b"), F.expr("a.id != b.id AND abs(length(a.text) - length(b.text)) <= 0.04 * greatest(length(a.text), length(b.text)) AND regexp_extract_all(a.text, '[0-9]+', 0) = regexp_extract_all(b.text, '[0-9]+', 0)"))
    wanted = pairs.filter("levenshtein(a.text, b.text) <= floor(greatest(length(a.text), length(b.text)) * 0.04D)").selectExpr("a.id", "b.id AS old")
    wanted = {tuple(r) for r in wanted.collect()}
    found = [tuple(r) for r in mail.near_earlier(rows, timed=False).collect()]
    assert len(wanted) > 150 and set(found) == wanted and len(found) == len(wanted)


def test_texts_that_share_all_but_a_word_are_compared_with_each_other(spark):
    body = " and ".join([P1.lower().strip("."), P2.lower().strip("."), P3.lower().strip(".")])
    texts = [f"{body} {a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "id bigint, text string, role tinyint")
    assert mail.near_earlier(rows, timed=False).count() == 100 * 99


def test_an_edit_changes_few_parities():
    rng = random.Random(5)
    for gram in (2, 3, 5):
        for _ in range(60):
            text = " ".join(rng.choices(WORDS, k=20))
            n = rng.randrange(1, 6)
            a, b = mail.parities([text, _misread(rng, text, n)], gram, 256)
            assert np.bitwise_count(a ^ b).sum() <= 2 * gram * n
