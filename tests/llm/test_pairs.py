"""Near duplicates of vectors, similar shingle sets and components, against brute force."""

import random
import re

import numpy as np
import pytest

from gatehouse.llm import jaccard_join
from gatehouse.llm.components import components
from gatehouse.llm.embedding_dedup import near_duplicates
from gatehouse.llm.jaccard_join import similar_classes, similar_links


def parts(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(100, 140)]
    star = [(7, k) for k in range(200, 260)]
    rows = path + star + [(5, 5), (None, 3), (101, 100)]
    found = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    nodes = {n for e in path + star for n in e}
    assert found == parts(nodes, path + star)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors_fixture():
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for _ in range(12):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 25)):
            rows.append((k, (centre + rng.normal(size=16) * rng.choice([0.05, 0.2])).tolist()))
            k += 1
    rows.append((k, rows[3][1]))
    rows.append((k + 1, [x * 1e-200 for x in rows[3][1]]))
    rows.append((k + 2, [x * 1e200 for x in rows[4][1]]))
    return rows


def brute_vectors(rows, threshold=0.95):
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= threshold]
    root = parts(unit, links)
    return {i: (sum(i in e for e in links), root[i], root[i] == i) for i in unit}


def test_vectors_against_brute_force(spark):
    rows = vectors_fixture()
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None] * 8), (904, [float("nan")] * 16), (905, [float("inf")] * 16)]
    short = [(910, [1.0, 2.0]), (911, [2.0, 4.0])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows + odd + short], "vec_id long, embedding array<double>, kept int")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(frame.repartition(3)).collect()}
    expected = brute_vectors(rows + short) | {i: (0, i, True) for i, _ in odd}
    assert found == expected
    assert max(n for n, _, _ in expected.values()) > 5


def test_vectors_without_or_with_repeated_identifier(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<double>")
    found = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in near_duplicates(frame).collect())
    assert found == [(-1, 0, None, True), (2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False)]


def test_no_vectors(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < size else [tuple(words[i : i + size]) for i in range(len(words) - size + 1)])


def brute_sets(rows, size, percent):
    sets = {d: shingles(t, size) for d, t in rows}
    links = []
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                links.append((a, b))
    root = parts(sets, links)
    return {d: (len(sets[d]), root[d]) for d in sets}


def texts_fixture():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    line = " ".join(rng.choices(vocabulary, k=60))
    rows, k = [], 0
    for _ in range(15):
        base = rng.choices(vocabulary, k=rng.randint(3, 90))
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((k, rng.choice([" ", "\n", "  "]).join(words)))
            k += 1
    for n in range(20):
        # One passage in many documents, with a share of own words around the limit.
        rows.append((k + n, line + " " + " ".join(rng.choices(vocabulary, k=n))))
    k += 20
    rows += [(k, None), (k + 1, ""), (k + 2, " \t\n"), (k + 3, "One"), (k + 4, "one"), (k + 5, "ONE two"), (k + 6, "É é É é É"), (k + 7, "é é é é é")]
    rows.append((k + 8, " ".join(rng.choices(vocabulary, k=30_000))))
    rows.append((k + 9, rows[-1][1].upper()))
    return rows


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_sets_against_brute_force(spark, size, percent):
    rows = texts_fixture()
    frame = spark.createDataFrame([(t, d, "x", 1) for d, t in rows], "text string, doc_id long, n_shingles string, sig int")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_classes(frame.repartition(5), size=size, percent=percent).collect()}
    assert found == brute_sets(rows, size, percent)


def test_sets_of_rows_without_or_with_repeated_identifier(spark):
    rows = [(None, "a b c d e"), (8, "a b c d e"), (8, "a b c d e"), (3, "a  b c d e"), (8, "x y z x y")]
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(d, c) for d, _, c in found] == [(-1, None), (3, 3), (8, 3), (8, 3), (8, 8)]


def test_no_sets(spark):
    assert similar_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_links_at_the_threshold(spark):
    """17 common shingles of 20 in all are just enough, 16 of 19 are not."""
    twenty = [f"t{k}" for k in range(23)]
    enough, short = twenty[:20], ["z", *twenty[3:19], "y"]
    rows = [(1, " ".join(twenty)), (2, " ".join(enough)), (30, " ".join(short))]
    found = {r.doc_id: r.component_id for r in similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {d: c for d, (_, c) in brute_sets(rows, 4, 85).items()}
    assert found[2] == 1 and found[30] == 30


@pytest.mark.parametrize(("size", "percent", "sets"), [(4, 85, 256), (5, 80, 4)])
def test_numbers_of_links_against_brute_force(spark, monkeypatch, size, percent, sets):
    """All links of a row, also between sets that other links connect already; blocks of a component too."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", sets)
    rows = texts_fixture()
    every = {d: shingles(t, size) for d, t in rows}
    links = {d: 0 for d in every}
    for a in every:
        for b in every:
            common = len(every[a] & every[b])
            links[a] += a != b and common > 0 and 100 * common >= percent * (len(every[a]) + len(every[b]) - common)
    expected = {d: (n, links[d], c) for d, (n, c) in brute_sets(rows, size, percent).items()}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in similar_links(frame, size=size, percent=percent).collect()}
    assert found == expected and max(links.values()) > 5


def test_links_of_rows_without_or_with_repeated_identifier(spark):
    rows = [(None, "a b c d e"), (8, "a b c d e"), (8, "a b c d e"), (3, "a  b c d e"), (8, "x y z x y")]
    found = similar_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_links, r.component_id) for r in found if r.doc_id) == [(3, 2, 3), (8, 0, 8), (8, 2, 3), (8, 2, 3)]
    assert [(r.n_links, r.component_id) for r in found if r.doc_id is None] == [(0, None)]
    assert similar_links(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sets_of_one_identifier_do_not_connect_their_components(spark):
    long = [f"t{k}" for k in range(40)]
    rows = [(5, " ".join(long)), (8, " ".join(long[:39])), (8, "x y z x y"), (9, "x y z x y")]
    found = similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == [(5, 37, 5), (8, 2, 8), (8, 36, 5), (9, 2, 8)]
