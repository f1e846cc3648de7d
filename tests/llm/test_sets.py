"""Near-duplicate sets and connected components against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from sedimenta.llm import components, golay, neardup

POSTINGS = "feature string, member string"
LINKS = "id string, from_node string, to_node string, status string"


def test_golay_code_is_perfect_and_near_words_share_an_index():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000).astype(np.int32)
    index = golay.decode(words)
    codewords = words ^ golay.ERRORS[golay.syndromes(words)]
    assert (golay.syndromes(codewords) == 0).all() and (codewords >> 11 == index).all()
    assert max(bin(x).count("1") for x in golay.ERRORS.tolist()) == 3 and len(set(golay.ERRORS.tolist())) == 2048
    a, b = rng.integers(0, 23, 2000), rng.integers(0, 23, 2000)
    other = words ^ (1 << a).astype(np.int32) ^ (1 << b).astype(np.int32)
    for x, y in zip(golay.neighbour_indices(words), golay.neighbour_indices(other), strict=True):
        assert set(x) & set(y)


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.9])
def test_segments_suffice_for_the_pigeonhole(threshold):
    for total in range(2, 400):
        differ = total - 2 * neardup.least_overlap(total, threshold)
        assert differ // neardup.segments_for(total, threshold) <= 2
    for a in (*range(1, 60), 900, 5000):
        for b in {a, int(a * 1.1), int(a / threshold)}:
            m = neardup.segments_for(a + b, threshold)
            assert m in neardup.levels(a, threshold) or b < a * threshold or a < b * threshold
            assert m in neardup.levels(b, threshold) or b < a * threshold or a < b * threshold


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.75, 0.8, 0.9])
def test_levels_are_those_of_all_totals(threshold):
    import math

    for size in (*range(1, 300), 999, 1000, 4321):
        totals = range(size + math.ceil(round(size * threshold, 9)), size + math.floor(round(size / threshold, 9)) + 1)
        assert set(neardup.levels(size, threshold)) == {neardup.segments_for(t, threshold) for t in totals}


def brute(rows, threshold):
    sets = {}
    for feature, member in rows:
        if feature is not None and member is not None and feature.strip():
            sets.setdefault(member, set()).add(feature.strip().lower())
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("seed", range(3))
def test_all_similar_pairs_are_found(spark, seed):
    rng = random.Random(seed)
    rows = []
    for family in range(60):
        base = [f"f{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 6, 9, 12, 20, 45]))]
        for copy in range(rng.randrange(1, 7)):
            own = [f for f in base if rng.random() > 0.1] + [f"g{rng.randrange(9999)}" for _ in range(rng.randrange(0, 3))]
            rows += [(rng.choice([f, f" {f}\t", f.upper()]), f"m{family:03}-{copy}") for f in [*own, "hot"]]
    rows += rows[:50] + [(None, "m1"), ("x", None), (" \t", "blank"), (None, None)]
    rng.shuffle(rows)
    found = [tuple(r) for r in neardup.similar_members(spark.createDataFrame(rows, POSTINGS)).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, 0.75)


def test_large_sets_copies_and_classes(spark):
    rng = random.Random(9)
    big = [f"b{i}" for i in range(3000)]
    rows = [(f, "big1") for f in big] + [(f, "big2") for f in big[200:]] + [(f, "big3") for f in big[: 3000 // 2]]
    rows += [(f, f"copy{i}") for i in range(40) for f in ("a", "b", "c", "d")] + [(f, "near") for f in ("a", "b", "c")]
    rng.shuffle(rows)
    postings = spark.createDataFrame(rows, POSTINGS)
    assert {tuple(r) for r in neardup.similar_members(postings).collect()} == brute(rows, 0.75)
    assert {tuple(r) for r in neardup.class_links(postings).collect()} == {("big1", "big2"), ("copy0", "near")}
    reps = {r.member: r.rep for r in neardup.class_members(postings).collect()}
    assert reps["copy7"] == "copy0" and reps["near"] == "near" and len(reps) == 44


def test_empty_postings(spark):
    empty = spark.createDataFrame([], POSTINGS)
    assert neardup.similar_members(empty).collect() == [] and neardup.class_members(empty).collect() == []


def test_common_features_alone(spark):
    rows = [(f"c{j}", f"m{i:04}") for i in range(300) for j in range(6) if (i >> j) & 1 or j == 0]
    found = {tuple(r) for r in neardup.similar_members(spark.createDataFrame(rows, POSTINGS)).collect()}
    assert found == brute(rows, 0.75)


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in list(parent)}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    name = lambda i: f"n{(i * 7919) % 10007:05}"
    chain = [(name(i), name(i + 1)) for i in range(300)]
    sorted_chain = [(f"c{i:04}", f"c{i + 1:04}") for i in range(200)]
    star = [("star", f"s{i}") for i in range(200)]
    noise = [(name(rng.randrange(400, 3000)), name(rng.randrange(400, 3000))) for _ in range(400)]
    edges = [*chain, *sorted_chain, *star, *noise, ("self", "self"), (None, "x"), ("y", None), *[(b, a) for a, b in chain[:50]], *star[:20]]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a string, b string").selectExpr("*", "1 AS node", "2 AS label")
    got = [tuple(r) for r in components.connected_components(df).collect()]
    assert len(got) == len(set(got)) and set(got) == union_find(edges)


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a string, b string")).collect() == []
    assert components.connected_components(spark.createDataFrame([("a", "a")], "a string, b string")).columns == ["node", "label"]


def test_member_groups_count_only_resolved_links_between_members(spark):
    links = spark.createDataFrame(
        [("1", " a ", "b", "resolved"), ("2", "b", "c", "ambiguous"), ("3", "c", "d", None), ("4", "d", "nowhere", "resolved"), ("5", "e", "e ", "resolved"), ("6", None, "a", "resolved"), ("1", "b", "a", "resolved")], LINKS
    )
    postings = spark.createDataFrame([("f", m) for m in ("a", "b", "c", "d", "e", None)], POSTINGS)
    assert {tuple(r) for r in components.member_groups(links, postings).collect()} == {("a", "a"), ("b", "a")}
