import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sediment.llm import quality_classifier as Q
from sediment.llm.tables import table


@pytest.mark.parametrize("seed", range(3))
def test_descent_closes_the_duality_gap(seed):
    r = np.random.default_rng(seed)
    rows = [np.sort(r.choice(20, 6, replace=False)) for _ in range(80)]
    values = [r.normal(size=6) for _ in rows]
    y = np.where(r.random(80) < 0.4, 1.0, -1.0)
    cost = np.where(y > 0, 2.0, 0.5)
    w, alpha = Q.descend(rows, values, y, cost, 20, epochs=3000, seed=seed)
    hinge = np.array([max(0.0, 1 - y[i] * (w[x] @ v + w[20])) for i, (x, v) in enumerate(zip(rows, values, strict=True))])
    primal, dual = w @ w / 2 + cost @ hinge, alpha.sum() - w @ w / 2
    assert dual <= primal + 1e-9 and primal - dual < 1e-2 * primal
    assert ((alpha >= 0) & (alpha <= cost)).all()


def test_ratio_is_the_log_count_ratio():
    flat, begins = np.array([1, 2, 1, 3, 3]), np.array([0, 2, 3, 4, 5])
    ratio = Q.log_count_ratio(flat, begins, np.array([1, 1, -1, -1]))
    s, size = Q.SMOOTHING, (1 << Q.BITS) * Q.SMOOTHING
    assert np.isclose(ratio[1], np.log(((2 + s) / (3 + size)) / (s / (2 + size)))) and ratio[2] == 0 and ratio[3] < 0


def test_features_are_indicators():
    flat, begins = Q.features(pa.array(["the cat the cat", "the cat", "", "X!! X!! X!! X!!"]))
    parts = [set(flat[a:b].tolist()) for a, b in zip(begins, begins[1:], strict=False)]
    assert len(flat) == sum(map(len, parts)) and parts[1] < parts[0] and not parts[2] and 0xBEAD in parts[3] and 0xBEAD not in parts[0]


def plain_features(text):
    """What a text has, as tuples instead of hashes."""
    import re

    import regex

    runs = text.split()
    word = lambda r: regex.sub(r"[^\p{L}\p{M}\p{N}]+", "", r.lower())
    shape = lambda r: regex.sub(r"\p{N}+", "0", regex.sub(r"[\p{Lu}\p{Lt}]a", "Aa", regex.sub(r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "a", regex.sub(r"\p{Lu}{2,}", "AA", r))))
    out = {("w", word(r)) for r in runs if word(r)} | {("s", shape(r)) for r in runs}
    out |= {("ww", word(a), word(b)) for a, b in zip(runs, runs[1:]) if word(a) and word(b)} | {("ss", shape(a), shape(b)) for a, b in zip(runs, runs[1:])}
    return out | ({("four",)} if re.search(r"(?<!\S)(\S+)(\s+\1){3}(?!\S)", text) else set())


def test_fit_equals_brute_force():
    r = np.random.default_rng(5)
    good, bad = "the quiet river ran past a Small house and its garden".split(), "BUY now!!! cheap 100 pills win win win win CASH".split()
    y = np.array([1.0 if r.random() < 0.6 else -1.0 for _ in range(60)])
    texts = [" ".join(r.choice(good if (r.random() < 0.8) == (v > 0) else bad) for _ in range(12)) for v in y]
    flat, begins = Q.features(pa.array(texts))
    plain = [plain_features(t) for t in texts]
    assert [len(p) for p in plain] == np.diff(begins).tolist()
    # each plain feature is one number and the other way round
    number = {}
    for k, p in enumerate(plain):
        mine = set(flat[begins[k] : begins[k + 1]].tolist())
        for f in p:
            number[f] = number.get(f, mine) & mine
    left = dict(number)
    while left:
        sure = {f: next(iter(n)) for f, n in left.items() if len(n) == 1}
        if not sure:
            break
        number |= {f: {n} for f, n in sure.items()}
        left = {f: n - set(sure.values()) for f, n in left.items() if f not in sure}
    assert all(number.values())

    def plain_weights(rows):
        """Ratios, the fit by the primal's subgradient in place of the dual, and the blend, over tuples."""
        counts = {}
        for k in rows:
            for f in plain[k]:
                counts.setdefault(f, [0, 0])[int(y[k] < 0)] += 1
        total = [sum(c[j] for c in counts.values()) + Q.SMOOTHING * (1 << Q.BITS) for j in (0, 1)]
        ratio = {f: np.log((c[0] + Q.SMOOTHING) / total[0]) - np.log((c[1] + Q.SMOOTHING) / total[1]) if sum(c) >= Q.LEAST else 0.0 for f, c in counts.items()}
        names = sorted(ratio)
        x = np.array([[ratio[f] / len(plain[k]) ** 0.5 if f in plain[k] else 0.0 for f in names] + [1.0] for k in rows])
        cost = np.where(y[rows] > 0, 0.5 / (y[rows] > 0).mean(), 0.5 / (y[rows] < 0).mean()) * Q.COST
        w, mean = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
        for step in range(1, 60_001):
            slope = w - ((cost * y[rows] * (y[rows] * (x @ w) < 1)) @ x)
            w = w - slope / (step + 50)
            mean += (w - mean) * 2 / (step + 1)
        mean = mean[:-1]
        return {f: ratio[f] * ((1 - Q.BLEND) * np.abs(mean).sum() / (1 << Q.BITS) + Q.BLEND * v) for f, v in zip(names, mean)}

    labels = np.where(y > 0, 1, 0)
    for left_out in (-1, 1):
        w, scores = Q.fit([flat[begins[k] : begins[k + 1]] for k in range(len(y))], labels, left_out)
        fold = Q.folds(y)
        rows = np.flatnonzero(fold != left_out)
        want = plain_weights(rows)
        mine = [w[flat[begins[k] : begins[k + 1]]].sum() for k in rows]
        theirs = [sum(want.get(f, 0.0) for f in plain[k]) for k in rows]
        assert np.corrcoef(mine, theirs)[0, 1] > 0.999 and np.abs(np.array(mine) - theirs).max() < 0.05 * np.abs(theirs).max()
        assert len(scores) == (fold == left_out).sum()


@pytest.mark.parametrize("seed", range(20))
def test_bound_is_the_best_of_all(seed):
    r = np.random.default_rng(seed)
    y = np.where(r.random(30) < 0.4, 1.0, -1.0)
    y[:2] = 1, -1
    scores = np.round(r.normal(size=30) + y * r.choice([0, 1, 3]), r.choice([0, 1, 3]))
    rates = lambda b: ((scores + b >= 0) & (y > 0)).sum() / (y > 0).sum() - ((scores + b >= 0) & (y < 0)).sum() / (y < 0).sum()
    best = max(rates(-c) for c in [*scores, scores.max() + 1, scores.min() - 1])
    assert rates(Q.bias(scores, y)) == pytest.approx(best) or best == 0


def test_the_model_doesnt_depend_on_the_order_of_rows(spark):
    docs = spark.createDataFrame([(i % 40, f"{'good words here' if i % 3 else 'BAD!! WORDS!!'} {i}") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    one, two = Q.train(docs, labels), Q.train(docs.repartition(7).orderBy(F.desc("text")), labels.orderBy(F.desc("doc_id")))
    assert all((a == b).all() and a.any() for a, b in zip(one, two, strict=True))


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    learn = F.pmod(F.xxhash64("doc_id"), F.lit(10)) > 0
    model = Q.train(docs, labels.where(learn))
    held = Q.score(docs.join(labels.where(~learn).select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").toPandas()
    assert len(held) > 300
    assert ((held.quality_score >= 0) == (held.quality == 1)).mean() > 0.98
    toxic = held.toxic_score >= 0
    assert toxic[held.toxic == 1].mean() > 0.85 and toxic[held.toxic == 0].mean() < 0.05
    assert held.keep[(held.toxic == 0) & (held.quality == 1)].mean() > 0.93


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good words", "x"), (1, "good words", "x"), (2, None, "x"), (None, "", "x"), (3, "BAD!! BAD!! " * 30_000, "x"), (4, "bad bad", None)], "doc_id long, text string, keep string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, None), (4, 0, 1), (4, 1, 0), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[1].keep and not by[3].keep and len({r.quality_score for r in got if r.doc_id == 1}) == 1
    none = Q.classify(docs, labels.limit(0)).collect()
    assert all(r.keep and r.quality_score == r.toxic_score == 0 for r in none)
    assert Q.classify(docs.limit(0), labels).count() == 0
