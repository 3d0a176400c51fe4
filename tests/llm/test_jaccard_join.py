import random

import numpy as np
import pytest

from loomery.llm.components import components
from loomery.llm.jaccard_join import Parts, _stars, _unsettled, family_edges, jaccard_classes, jaccard_links, linked, parities, ties


def brute_sets(sets, percent):
    """component (least key) by links of every pair"""
    above = {k: k for k in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def shingles(text, words):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


@pytest.mark.parametrize("percent", [60, 80, 85, 100])
def test_linked_equals_brute_force(percent):
    rng = np.random.default_rng(percent)
    base = [rng.choice(400, 60, replace=False) for _ in range(4)]
    sets = []
    for i in range(70):
        keep = rng.random(60) > rng.choice([0.0, 0.03, 0.08, 0.2])
        sets.append(np.unique(np.r_[base[i % 4][keep], rng.integers(0, 400, 3)]).astype(np.uint64))
    links = linked(list(range(70)), sets, percent)
    assert len(links) < 70
    want = brute_sets({i: set(s.tolist()) for i, s in enumerate(sets)}, percent)
    above = dict.fromkeys(range(70))
    from collections import defaultdict

    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for i in range(70):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        above[i] = min(seen)
    assert above == want


@pytest.mark.parametrize("percent", [60, 80, 85, 100])
def test_every_pair(percent):
    rng = np.random.default_rng(percent + 1)
    base = [rng.choice(300, 50, replace=False) for _ in range(3)]
    sets = [np.unique(np.r_[base[i % 3][rng.random(50) > rng.choice([0.0, 0.04, 0.1])], rng.integers(0, 300, 2)]).astype(np.uint64) for i in range(60)]
    plain = [set(s.tolist()) for s in sets]
    similar = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    want = {(i, j) for i in range(60) for j in range(i) if similar(plain[i], plain[j])}
    assert {(max(p), min(p)) for p in linked(list(range(60)), sets, percent, every=True)} == want


def test_five_thousand_near_copies():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    sets = []
    for i in range(5000):
        s = base.copy()
        s[rng.integers(0, 40, i % 4)] = rng.integers(0, 1 << 62, 1).astype(np.uint64)[0]
        sets.append(np.unique(s))
    links = linked(list(range(5000)), sets, 80)
    assert len(links) < 5000
    above = list(range(5000))

    def root(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for a, b in links:
        above[root(a)] = root(b)
    # brute force: every set against every other, by the incidence of their shingles
    values, which = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.flatnonzero(np.bincount(which) > 1)
    held = np.zeros((5000, len(common)), np.float32)
    for i, s in enumerate(sets):
        held[i] = np.isin(values[common], s)
    both, n = held @ held.T, np.array([len(s) for s in sets])
    similar = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    seen, todo = np.zeros(5000, bool), [0]
    seen[0] = True
    while todo:
        more = similar[todo].any(0) & ~seen
        seen |= more
        todo = np.flatnonzero(more).tolist()
    assert {root(i) == root(0) for i in np.flatnonzero(seen)} == {True} and not any(root(i) == root(0) for i in np.flatnonzero(~seen))


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(60)]
    docs, originals = [], [[rng.choice(vocab) for _ in range(rng.randint(3, 120))] for _ in range(12)]
    for i in range(150):
        w = list(rng.choice(originals))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w += passage
        docs.append((i + 10, rng.choice([" ".join, "\n".join, "  ".join])(w).upper() if i % 7 == 0 else " ".join(w)))
    return docs


@pytest.mark.parametrize("family_shingles", [4_000_000, 200])
def test_classes_equal_brute_force(spark, family_shingles):
    docs = corpus() + [(900, None), (901, ""), (902, " \n\t "), (903, "one two"), (904, "ONE  two"), (905, "two one"), (906, docs_one()), (907, docs_one())]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, doc string")
    out = {r.doc: (r.n_shingles, r.component_id) for r in jaccard_classes(frame, words=4, percent=85, family_shingles=family_shingles).collect()}
    sets = {i: shingles(t, 4) for i, t in docs}
    want = brute_sets(sets, 85)
    assert out == {i: (len(sets[i]), want[i]) for i in sets}


@pytest.mark.parametrize("family_shingles", [2_000_000, 200])
def test_links_equal_brute_force(spark, family_shingles):
    docs = corpus()[:90] + [(900, None), (901, "one two"), (902, "ONE two"), (903, "two"), (None, "one two")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows, pairs = jaccard_links(frame, words=4, percent=85, family_shingles=family_shingles)
    sets = {i: shingles(t, 4) for i, t in docs if i is not None}
    similar = lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)
    links = {i: sum(similar(sets[i], sets[j]) for j in sets if j != i) for i in sets}
    least = {i: min(j for j in sets if sets[j] == sets[i]) if sets[i] else None for i in sets}
    got = {r.doc: (r.class_id, r.n_shingles, r.n_links) for r in rows.collect()}
    assert got.pop(None) == (None, 1, 0)
    assert got == {i: (least[i], len(sets[i]), links[i]) for i in sets}
    want = {(least[i], least[j]) for i in sets for j in sets if i != j and similar(sets[i], sets[j]) and least[i] < least[j]}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def docs_one():
    return " ".join(f"long{i % 977}" for i in range(30_000))


def test_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (9, b), (7, a), (7, a), (None, a), (None, None), (3, "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc, r.n_shingles, r.component_id) for r in jaccard_classes(frame).collect()), key=str)
    assert out == sorted([(5, 36, 5), (5, 36, 5), (9, 36, 5), (7, 36, 5), (7, 36, 5), (None, 36, None), (None, 0, None), (3, 1, 3)], key=str)
    assert jaccard_classes(frame.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            above[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in list(above)}


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_ties_join_all_that_link(percent):
    rng = np.random.default_rng(percent + 2)
    base = [np.unique(rng.integers(0, 1 << 62, n)) for n in (30, 500, 511, 520, 1500, 2100)]
    sets = [np.unique(np.r_[base[i % 6][rng.random(len(base[i % 6])) > rng.choice([0.0, 0.03, 0.1])], rng.integers(0, 1 << 62, 2)]).astype(np.uint64) for i in range(120)]
    sets.sort(key=len)
    found = ties(list(range(120)), [len(s) for s in sets], [parities(s) for s in sets], percent)
    want = brute_sets({i: set(s.tolist()) for i, s in enumerate(sets)}, percent)
    parts = Parts(120)
    for a, b in found:
        parts.join(a, b)
    assert len(found) < 120 and all(parts.root(i) == parts.root(j) for i, j in want.items())


def test_chance_meetings_of_long_sets_tie_no_family(spark):
    """Long documents that share a rare shingle and nothing else stay apart, on small lists and on large ones."""
    rng = np.random.default_rng(4)
    sets = [np.unique(np.r_[rng.integers(0, 1 << 62, 1200 + 3 * i), [7]]).astype(np.uint64) for i in range(40)]
    rows = [(i, i, len(s), [int(x) for x in parities(s)]) for i, s in enumerate(sets)]
    classes = spark.createDataFrame(rows, "d1 long, d2 long, n long, parity array<long>")
    entries = [(7, i, len(s)) for i, s in enumerate(sets)] + [(100 + i, j, len(sets[j])) for i in range(39) for j in (i, i + 1)]
    lists = spark.createDataFrame(entries, "token long, cls long, n long")
    assert family_edges(lists, classes, 85).count() == 0
    # the same in blocks, with a near copy to be found
    near = np.unique(np.r_[sets[3][:-40], rng.integers(0, 1 << 62, 30).astype(np.uint64)])
    classes = classes.unionByName(spark.createDataFrame([(77, 77, len(near), [int(x) for x in parities(near)])], classes.schema))
    lists = lists.unionByName(spark.createDataFrame([(7, 77, len(near))], lists.schema))
    assert {tuple(sorted(r)) for r in family_edges(lists, classes, 85, list_block=16).collect()} == {(3, 77)}


def test_a_large_family_is_searched_in_stars_first(spark):
    """Lists of a family beyond the bound that lie in one part by the first search are not dealt again."""
    rng = random.Random(8)
    words = [f"x{i}" for i in range(120)]
    docs = []
    for i in range(60):
        w = list(words)
        w[rng.randrange(120)] = f"y{i}"
        docs.append((i, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {(r.doc, r.component_id) for r in jaccard_classes(frame, words=4, percent=85, family_shingles=2000).collect()} == {(i, 0) for i in range(60)}
    large = spark.createDataFrame([(i, 100 + i, 117) for i in range(60)], "doc long, cls long, n long")
    lists = spark.createDataFrame([(t, 100 + i, 117) for t in range(3) for i in range(t, 60)] + [(9, 100, 117), (9, 159, 117)], "token long, cls long, n long")
    stars = [(r.g1, r.g3, r.doc) for r in _stars(large, lists, 2000).collect()]
    assert {d for _, _, d in stars} == set(range(60)) and max(sum(s[:2] == k[:2] for s in stars) for k in stars) * 117 < 4000
    found = spark.createDataFrame([(0, i) for i in range(1, 59)], "a long, b long")
    assert {r.token for r in _unsettled(large, lists, found).select("token").distinct().collect()} == {0, 1, 2, 9}
    found = spark.createDataFrame([(0, i) for i in range(1, 60)], "a long, b long")
    assert _unsettled(large, lists, found).count() == 0
