import random

import pytest

from sediment.llm import decontam as D
from sediment.llm.text import word_list


def brute(items, words, limits):
    """Every run that some item has, by looking at all of them."""
    out = []
    for i in range(len(words)):
        for j in range(i + limits.floor, len(words) + 1):
            has = [it for it in items if any(it[k : k + j - i] == words[i:j] for k in range(len(it) - (j - i) + 1))]
            if has and (j - i >= limits.length or j - i >= limits.coverage * min(map(len, has))):
                out.append((i, j))
    marked = set()
    for i, j in out:
        marked |= set(range(i, j))
    return marked


@pytest.mark.parametrize("seed", range(6))
def test_spans_equal_brute_force(seed):
    r = random.Random(seed)
    items = [[r.choice("abcd") for _ in range(r.randint(1, 9))] for _ in range(6)]
    lim = D.Limits(length=6, coverage=0.75, floor=3, drop=0.5)
    index = D.Index(list(enumerate(items)), lim)
    for _ in range(40):
        words = [r.choice("abcde") for _ in range(r.randint(0, 40))]
        spans, _, _ = index.spans([index.number.get(w, 0) for w in words])
        assert {k for a, b in spans for k in range(a, b)} == brute(items, words, lim)


BENCH = [(1, "One two, three four five six seven eight nine ten eleven twelve thirteen fourteen."), (2, "short item"), (3, None), (4, "")]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep string, Words int")


def test_edge_cases(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    leak = "one two three FOUR five -- six seven eight nine ten eleven twelve thirteen fourteen"
    clean = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, clean, "en", "s", 1, "x", 1),
        (2, f"  {clean} {leak} {clean}", "en", "s", 1, "x", 1),
        (2, f"  {clean} {leak} {clean}", "en", "s", 1, "x", 1),
        (3, leak, "en", "s", 1, "x", 1),
        (4, None, None, None, None, None, None),
        (5, "", "en", "s", 0, "x", 1),
        (None, clean, "en", "s", 1, "x", 1),
        (6, "one two three four five six", "en", "s", 1, "x", 1),
        (7, (clean + "\n") * 3000 + leak, "en", "s", 1, "x", 1),
    ]
    d = docs(spark, rows)
    got = {(r.doc_id, r.text) for r in D.remove_spans(d, bench).collect()}
    assert got == {(1, clean), (2, f"  {clean} {clean}"), (4, None), (5, ""), (None, clean), (6, "one two three four five six"), (7, ((clean + "\n") * 3000)[:-1])}
    rep = {r.doc_id: r for r in D.report(d, bench).collect()}
    assert D.report(d, bench).count() == len(rows) and D.remove_spans(d, bench).columns == d.columns
    assert not rep[3].keep and rep[3].text is None and rep[3].items == [1]
    assert (rep[2].n_spans, rep[2].n_removed, rep[2].longest) == (1, 14, 14) and rep[1].keep and rep[4].keep and rep[4].text is None
    assert {r.n_chars for r in D.remove_spans(d, bench).where("doc_id = 2").collect()} == {len(f"  {clean} {clean}")}


def test_empty_tables(spark):
    bench, d = spark.createDataFrame(BENCH, "item_id long, text string"), docs(spark, [(1, "a b", "en", "s", 3, "x", 1)])
    assert D.report(d.limit(0), bench).count() == 0 and D.remove_spans(d.limit(0), bench).count() == 0
    assert D.report(d, bench.limit(0)).first().n_words == 2 and D.remove_spans(d, bench.limit(0)).count() == 1


def test_further_passes(spark, monkeypatch):
    monkeypatch.setattr(D, "PASS_WORDS", 5)
    bench = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n")], "item_id long, text string")
    assert len(D.read_items(bench)) == 2
    d = docs(spark, [(1, "x " * 40 + "a b c d e f g y y y h i j k l m n", "en", "s", 3, "x", 1)])
    r = D.report(d, bench).first()
    assert r.items == [1, 2] and r.n_removed == 14 and word_list(D.remove_spans(d, bench).first().text) == ["x"] * 40 + ["y"] * 3


@pytest.mark.parametrize("seed", range(3))
def test_lots_change_nothing(spark, monkeypatch, seed):
    r = random.Random(seed)
    bench = spark.createDataFrame([(k, " ".join(r.choice("abcd") for _ in range(r.randint(4, 9)))) for k in range(8)], "item_id long, text string")
    d = docs(spark, [(i, " ".join(r.choice("aabbccddx") for _ in range(r.randint(0, 60))), "en", "s", 3, "x", 1) for i in range(60)])
    lim = D.Limits(length=6, coverage=0.75, floor=3, drop=0.5)
    both = lambda: [sorted(map(str, f(d, bench, lim).collect())) for f in (D.report, D.remove_spans)]
    one = both()
    monkeypatch.setattr(D, "PASS_WORDS", 9)
    assert len(D.read_items(bench)) > 3 and both() == one


def test_drop_sums_over_lots(spark, monkeypatch):
    monkeypatch.setattr(D, "PASS_WORDS", 5)
    bench = spark.createDataFrame([(1, "a b c d e f g"), (2, "f g h i j k l")], "item_id long, text string")
    d = docs(spark, [(1, "x " * 9 + "a b c d e f g h i j k l", "en", "s", 3, "x", 1)])
    r = D.report(d, bench).first()
    assert (r.n_spans, r.n_removed, r.items, r.keep) == (1, 12, [1, 2], False) and D.remove_spans(d, bench).count() == 0


@pytest.mark.parametrize("limits", [D.Limits(), D.Limits(length=6, coverage=0.75, floor=3)])
def test_longest_equals_brute_force(spark, limits):
    r = random.Random(7)
    items = [[r.choice("abcdefgh") for _ in range(20)] for _ in range(5)]
    held = {tuple(it[i:j]) for it in items for i in range(20) for j in range(i + 1, 21)}
    texts = [[r.choice("abcdefghxy") for _ in range(r.randint(0, 50))] + items[k % 5][3 : 3 + k % 14] + ["x", "zz"] for k in range(60)] + [["zz"], ["a"], []]
    d = docs(spark, [(k, " ".join(t), "en", "s", 3, "x", 1) for k, t in enumerate(texts)])
    got = {x.doc_id: x.longest for x in D.report(d, spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string"), limits).collect()}
    assert got == {k: max((j - i for i in range(len(t)) for j in range(i + 1, min(len(t), i + 20) + 1) if tuple(t[i:j]) in held), default=0) for k, t in enumerate(texts)}


def test_items_without_identifier(spark):
    bench = spark.createDataFrame([(None, "a b c d e f g"), (None, "h i j k l m n"), (3, "o p q r s t u")], "item_id long, text string")
    d = docs(spark, [(1, "x " * 40 + "a b c d e f g y o p q r s t u", "en", "s", 3, "x", 1), (2, "x " * 40 + "h i j k l m n", "en", "s", 3, "x", 1)])
    got = {r.doc_id: (r.n_removed, r.items) for r in D.report(d, bench).collect()}
    assert got == {1: (14, [3]), 2: (7, [])} and {word_list(r.text)[-1] for r in D.remove_spans(d, bench).collect()} == {"x", "y"}


def test_more_texts_in_a_batch_than_a_slice(spark):
    from sediment.llm import decontam

    item = " ".join(f"word{k}" for k in range(20))
    docs = spark.createDataFrame([(i, f"text {i} of many {'x' * (i % 50)}" + (f" {item} end" if i % 7 == 0 else ""), 1) for i in range(1300)], "doc_id long, text string, n int").coalesce(1)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    want = {i: None if i % 7 == 0 else f"text {i} of many {'x' * (i % 50)}" for i in range(1300)}
    assert {r.doc_id: r.text for r in decontam.report(docs, bench).collect()} == want
    assert {r.doc_id: r.text for r in decontam.remove_spans(docs, bench).collect()} == {i: t for i, t in want.items() if t}
