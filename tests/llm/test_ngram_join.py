import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from sediment.llm import blobs
from sediment.llm import ngram_join as J
from sediment.llm.text import word_list


def grams(text, n):
    w = word_list(text or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, t):
    out = {}
    for (a, x), (b, y) in itertools.combinations([(i, grams(s, n)) for i, s in rows if i is not None], 2):
        if a != b and x and y and (j := len(x & y) / len(x | y)) >= t:
            k = (min(a, b), max(a, b))
            out[k] = max(out.get(k, 0), round(j, 9))
    return out


def corpus(seed, n=90, words=12):
    """Short texts over few words, with copies, near copies, chains and boilerplate."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            w = (r.choice(out) or "a").split()
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [r.choice(vocab)], [w[k], r.choice(vocab)]]) or ["z"]
        else:
            w = [r.choice(vocab) for _ in range(r.randint(1, 40))]
        out.append(" ".join(w) + r.choice(["", ".", "!"]))
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, set string, A int").repartition(3)


@pytest.mark.parametrize("frequent,t,n,small", [(256, 0.5, 3, False), (2, 0.5, 2, True), (0, 0.5, 1, True), (3, 0.7, 2, True), (1, 0.3, 3, False)])
def test_pairs_equal_brute_force(spark, monkeypatch, frequent, t, n, small):
    # the functions are sent by value, so that a worker sees these settings
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(J)
    try:
        monkeypatch.setattr(J, "FREQUENT", frequent)
        if small:
            monkeypatch.setattr(J, "RANGE", 300)
            monkeypatch.setattr(J, "FLUSH", 200)
            monkeypatch.setattr(J, "BLOCK", 5)
            monkeypatch.setattr(J, "MANY", 3)
        rows = corpus(n * 10 + frequent, words=12 if n < 3 else 6)
        got = {(r.doc_a, r.doc_b): round(r.jaccard, 9) for r in J.similar_pairs(frame(spark, rows), n, t).collect()}
        assert got == brute(rows, n, t)
    finally:
        cloudpickle.unregister_pickle_by_value(J)


@pytest.mark.parametrize("seed", range(25))
def test_prefixes_of_similar_sets_meet(seed, monkeypatch):
    r = np.random.default_rng(seed)
    monkeypatch.setattr(J, "FREQUENT", 3)
    t = float(r.choice([0.3, 0.5, 0.8, 1.0]))
    base = [r.choice(5000, int(r.integers(1, 300)), replace=False) for _ in range(4)]
    sets = []
    for _ in range(30):
        s = set(base[r.integers(4)].tolist())
        for x in list(s):
            if r.random() < (1 - t) * 0.4:
                s.discard(x)
                s.add(int(r.integers(5000)))
        sets.append(s)
    df = Counter(x for s in sets for x in s)
    keys = []
    for s in sets:
        shared = sorted((x for x in s if df[x] > 1), key=lambda x: (df[x], x))
        k, rest = J.prefix_keys(np.array(shared, np.uint64), len(s), sum(df[x] <= 3 for x in shared), t)
        keys.append(dict(zip(k.tolist(), rest.tolist(), strict=True)))
    for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2):
        if len(x & y) / len(x | y) >= t:
            need = math.ceil(t / (1 + t) * (len(x) + len(y)) - 1e-9)
            assert any(min(keys[i][k], keys[j][k]) >= need for k in keys[i].keys() & keys[j].keys())


@pytest.mark.parametrize("n,top", [(0, 2**64), (1, 2**64), (1000, 2**64), (1000, 50), (5000, 2**20)])
def test_order_is_stable(n, top):
    r = random.Random(n)
    x = np.array([r.randrange(top) for _ in range(n)], np.uint64)
    assert J._order(x).tolist() == np.argsort(x, kind="stable").tolist()


def test_blobs():
    a = [np.arange(5000, dtype=np.uint32) % 7, np.arange(5, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.uint32), np.array([-1, 7], np.int64)]
    for x, y in zip(a, blobs.unpack(blobs.pack(*a)), strict=True):
        assert x.dtype == y.dtype and x.tolist() == y.tolist()


LONG = " ".join(f"q{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " .. "), (4, " .. "), (5, "One, two three four"), (6, "one two THREE four"), (6, "one two THREE four"), (7, "one two three four"), (None, "one two three four"), (8, LONG), (9, LONG + " end"), (10, "a"), (11, "A!"), (12, "lone words that nobody repeats")]


def test_edge_cases(spark):
    d = frame(spark, ODD)
    got = {(r.doc_a, r.doc_b): round(r.jaccard, 3) for r in J.similar_pairs(d).collect()}
    assert got == {(5, 6): 1.0, (5, 7): 1.0, (6, 7): 1.0, (8, 9): 1.0, (10, 11): 1.0}
    kept = J.one_of_each(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect())) == [1, 2, 3, 4, 5, 8, 10, 12]
    empty = d.limit(0)
    assert J.similar_pairs(empty).count() == 0 and J.one_of_each(empty).count() == 0


def test_repeated_rows_and_null_ids(spark):
    d = frame(spark, [(None, "some words here"), (3, "some words here"), (3, "some words here"), (4, None), (4, None), (None, "only this one")])
    assert sorted(((r.doc_id or -1, r.text or "") for r in J.one_of_each(d).collect())) == [(-1, "only this one"), (3, "some words here"), (4, ""), (4, "")]


def test_clashing_names_and_rows_that_differ_in_other_columns(spark):
    cols = ("row", "doc", "set", "d", "s", "lot", "group", "first", "stays", "n", "__set", "a", "b")
    rows = [(2, "some words here", *["z"] * 13), (1, "Some words, here", *["y"] * 13), (1, "Some words, here", *["x"] * 13), (5, None, *["w"] * 13)]
    d = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in cols))
    kept = J.one_of_each(d)
    assert kept.columns == d.columns
    assert sorted(tuple(r)[:3] for r in kept.collect()) == [(1, "Some words, here", "x"), (5, None, "w")]
    assert [(r.doc_a, r.doc_b) for r in J.similar_pairs(d).collect()] == [(1, 2)]


def test_copies_in_several_lots(spark, monkeypatch):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(J)
    try:
        monkeypatch.setattr(J, "FLUSH", 5)
        rows = [(i, "one two three four five six") for i in range(30)] + [(30 + i, f"one two three four five seven {'x' * i}") for i in range(3)]
        for most in (0, 10):
            monkeypatch.setattr(J, "BROADCAST_ROWS", most)
            got = {(r.doc_a, r.doc_b): round(r.jaccard, 9) for r in J.similar_pairs(frame(spark, rows), 2, 0.5).collect()}
            assert got == brute(rows, 2, 0.5)
            assert [r.doc_id for r in J.one_of_each(frame(spark, rows), 2, 0.5).collect()] == [0]
    finally:
        cloudpickle.unregister_pickle_by_value(J)


def test_groups_are_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (100, 301)]
    got = {r.set: r.group for r in J.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 200, 300, 301), 100)}


@pytest.mark.parametrize("seed", range(20))
def test_lists_give_all_their_pairs(seed):
    r = random.Random(seed)
    groups = [list(range(0, 30)), list(range(25, 60)), list(range(60, 64))]
    lists = [np.array(sorted({x for x in r.choice(groups) if r.random() < r.choice([0.2, 0.6, 0.95])} | {r.randrange(64)}), np.int64) for _ in range(40)]
    lists.sort(key=len, reverse=r.random() < 0.7)
    got = [(min(x, y), max(x, y)) for a, b in J._pairs_of_lists(iter(lists), 64) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert all(x != y for x, y in got)
    assert set(got) >= {p for m in lists for p in itertools.combinations(m.tolist(), 2)}


def near_copies(seed, n, words=60):
    """Near copies of two texts, of which few have equal sets, among others."""
    r = random.Random(seed)
    bases = [[f"{b}{i}" for i in range(words)] for b in "xy"]
    out = []
    for i in range(n):
        w = list(r.choice(bases)) if r.random() < 0.9 else [f"o{r.randrange(40)}" for _ in range(20)]
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = f"z{r.randrange(9)}"
        out.append(" ".join(w))
    return list(enumerate(out))


@pytest.mark.parametrize("seed,crowd", [(1, 4096), (2, 20)])
def test_crowds_of_near_copies_equal_brute_force(spark, monkeypatch, seed, crowd):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(J)
    try:
        monkeypatch.setattr(J, "FREQUENT", 12)
        monkeypatch.setattr(J, "CROWD", crowd)
        rows = near_copies(seed, 160)
        pairs = brute(rows, 3, 0.5)
        d = frame(spark, rows)
        assert {(r.doc_a, r.doc_b): round(r.jaccard, 9) for r in J.similar_pairs(d).collect()} == pairs
        # the pairs that only connect are far fewer, and connect the same
        few = J.similar_sets(d, every=False).where("b IS NOT NULL").count()
        assert few < len(pairs) / 2
        root = {i: i for i, _ in rows}
        for a, b in sorted(pairs):
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
        assert sorted(r.doc_id for r in J.one_of_each(d).collect()) == sorted(set(root.values()))
    finally:
        cloudpickle.unregister_pickle_by_value(J)


def test_classes_hold_every_link(spark, monkeypatch):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(J)
    try:
        monkeypatch.setattr(J, "FREQUENT", 12)
        monkeypatch.setattr(J, "CROWD", 50)
        rows = near_copies(3, 130)
        rows += [(200 + k, rows[k][1]) for k in range(0, 60, 2)] + [(200, "a text of its own"), (None, rows[0][1]), (301, None), (302, " . ")]
        sets = [grams(t, 3) for _, t in rows]
        links, root = [0] * len(rows), list(range(len(rows)))
        for i, j in itertools.combinations(range(len(rows)), 2):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5:
                links[i] += 1
                links[j] += 1
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
        got = J.classes(frame(spark, rows)).collect()
        assert Counter((r.doc_id, r.links) for r in got) == Counter((d, n) for (d, _), n in zip(rows, links, strict=True))
        members = lambda pairs: Counter(tuple(sorted(m, key=str)) for m in pairs.values())
        want, have = {}, {}
        for (d, _), c, s in zip(rows, root, sets, strict=True):
            if s:
                want.setdefault(c, []).append(d)
        for r in got:
            if r.class_id is not None:
                have.setdefault(r.class_id, []).append(r.doc_id)
        assert members(have) == members(want)
        assert {r.doc_id for r in got if r.class_id is None} == {301, 302}
        assert J.classes(frame(spark, rows).limit(0)).count() == 0
    finally:
        cloudpickle.unregister_pickle_by_value(J)


def test_a_range_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(1)
    draw = lambda: np.diff(np.sort(r.integers(0, 2**62, 50_000, dtype=np.uint64)), prepend=np.uint64(0))
    blob = [blobs.pack(draw(), r.integers(0, 9999, 50_000).astype(np.uint32)) for _ in range(20)]
    table = pa.table({"lot": list(range(20)), "range": [0] * 20, "blob": pa.array(blob, pa.binary())})
    tracemalloc.start()
    try:
        J._shared(1)(table)
        assert tracemalloc.get_traced_memory()[1] < 38 * 1_000_000  # bytes a posting; it was 44
    finally:
        tracemalloc.stop()
