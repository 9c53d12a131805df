import random

import numpy as np
import pytest

from larder.llm import near_dedup
from larder.llm.components import components
from larder.llm.near_dedup import connecting_links, drop_near_duplicates, near_duplicates
from larder.llm.words import shingle_sets, word_hashes


def _shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)) if w else frozenset()


def _brute(rows, size, percent=80):
    """(id -> component) over (id, text)."""
    sets = [_shingles(t, size) for _, t in rows]
    least = list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            linked = common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common)
            if linked or rows[i][0] == rows[j][0]:
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    out = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(root(i), []).append(d)
    return {d: min(ds) for ds in out.values() for d in ds}


def _corpus(seed, groups=12, copies=9, words=60, hot=0):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the"] * 200
    rows = []
    for g in range(groups):
        base = [draw.choice(vocabulary) for _ in range(words)]
        for _ in range(copies if g else copies + hot):
            text = [w if draw.random() > 0.035 else draw.choice(vocabulary) for w in base]
            rows.append((len(rows) * 3 + 1, " ".join(text)))
    draw.shuffle(rows)
    return rows


def test_words_and_shingles():
    text = "A bC\x0bD\te\r\nF  g H Éé"
    assert len(word_hashes(text.encode())[1]) == len(text.encode().split())
    sets = list(shingle_sets([text, None, "", "one", "ONE", "a b", "b a", "x " * 5, "long " * 400_000], 2))
    assert [len(s) for s in sets] == [len(_shingles(t, 2)) for t in (text, None, "", "one", "ONE", "a b", "b a", "x " * 5, "l l l")]
    assert (sets[3] == sets[4]).all() and sets[5][0] != sets[6][0]
    big = "w" * 3_000_000 + " tail"
    assert len(next(shingle_sets([big], 1))) == 2


def test_components_against_union_find(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 480)]
    edges += [(500, i) for i in range(501, 900)] + [(3, 3), (None, 4), (1, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {}

    def root(x):
        while low.get(x, x) != x:
            x = low[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            low[max(a, b)] = min(a, b)
    nodes = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    assert got == {x: root(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("size, long_list", [(2, 128), (2, 4), (5, 128)])
def test_against_brute_force(spark, size, long_list):
    rows = _corpus(7, hot=25)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_duplicates(docs, size=size, long_list=long_list).collect()
    want = _brute(rows, size)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(_shingles(t, size)) for d, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = drop_near_duplicates(docs, size=size, long_list=long_list)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_connecting_links_over_slabs(monkeypatch):
    import larder.llm.near_dedup as module

    monkeypatch.setattr(module, "_SLAB", 3)
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 30, 12)) for _ in range(40)]
    for cut in (0, 15):
        links = connecting_links(list(range(40)), list(range(40)), sets, 50, cut)
        rows = range(40) if not cut else range(cut)
        exact = {(i, j) for i in rows for j in range(cut, 40) if i != j and 2 * len(np.intersect1d(sets[i], sets[j])) >= len(np.union1d(sets[i], sets[j]))}
        assert set(links) <= exact

        def classes(pairs):
            group = list(range(40))
            for a, b in pairs:
                group = [group[a] if x == group[b] else x for x in group]
            return [[x == y for y in group] for x in group]

        assert classes(links) == classes(sorted(exact))


def test_rows_of_every_kind(spark):
    rows = [
        (5, "a b c d e f g h i j", 1, "k"), (3, "A b c d e f\ng h i  j", 1, "k"), (None, "a b c d e f g h i j", 1, None),
        (8, None, None, "k"), (9, "", 1, "k"), (10, " \n\t", 1, "k"), (11, "one", 1, "k"), (12, "ONE", 1, "k"),
        (13, "x y " * 50_000, 1, "k"), (14, "x y " * 40_000, 1, "k"), (20, "q r s t u v", 1, "k"), (20, "m n o p", 1, "k"), (21, "m n o p", 1, "k"),
        (22, "q r s t u v", 1, "k"), (5, "a b c d e f g h i j", 1, "k"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, component_id string")
    got = near_duplicates(docs, size=2).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == {5: 3, 3: 3, None: None, 8: 8, 9: 9, 10: 10, 11: 11, 12: 11, 13: 13, 14: 13, 20: 20, 21: 20, 22: 20}
    kept = drop_near_duplicates(docs, size=2)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, None, 8, 9, 10, 11, 13, 20}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_connected_cluster_is_not_compared_with_itself(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_CHUNK", 10)
    rows = [(i, 0, 0, 5) for i in range(400)] + [(400, 0, 400, 5)] + [(500 + i, 1, 500, 5) for i in range(50)]
    chunked = near_dedup._chunked(spark.createDataFrame(rows, "node long, cluster long, component long, n long")).collect()
    pairs = {(r.cluster, min(r.chunk, o), max(r.chunk, o)) for r in chunked for o in r.others}
    assert sum(len(r.others) for r in chunked) == 400 + 41 and pairs == {(0, 0, i) for i in range(41)}


@pytest.mark.parametrize("long_list", [128, 4])
def test_a_full_bitmap_gives_way_to_a_join(spark, monkeypatch, long_list):
    monkeypatch.setattr(near_dedup, "_FULL", 0)
    rows = _corpus(11, groups=6, hot=15) + [(None, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_duplicates(docs, size=2, long_list=long_list).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == _brute([r for r in rows if r[0] is not None], 2)


def test_the_join_makes_only_the_sets_asked_for(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_FULL", 0)
    docs = spark.createDataFrame([(i, f"a b c {i}") for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([(3,), (3,), (41,), (999,)], "doc_id long")
    assert sorted(r.node for r in near_dedup._sets_of(asked, docs, 2).collect()) == [3, 41]
