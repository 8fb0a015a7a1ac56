"""Quality and toxicity by naive Bayes support vectors.

Features are hashed indicators of word one- and two-grams and of one- and two-grams of the runs' shapes (case, digits,
punctuation). Each indicator is scaled by its class log-count ratio, and a linear hinge-loss model with a bias is fit to
the scaled indicators by dual coordinate descent, with both classes given the same total cost. The weights are blended
with their mean magnitude, as is usual for this model, and folded with the ratios into one vector of fixed size.

The fit reads a bounded sample of the labelled rows: the ``SAMPLE`` labelled documents first in the order of a hash of
their identifier, of documents that repeat an identifier the least text. Each head is fit once and once without each of
``FOLDS`` parts, every fit a task of its own, whose size doesn't grow with the corpus. Only the weights (8 MB a head) and
the left-out scores of the sample come to the driver, and the weights go to the executors. All documents are then scored
in one scan, without a shuffle.

Defined results:

* ``keep`` means a quality score of at least 0 and a toxicity score below 0; of bounds that separate the classes equally
  well, the middle one counts;
* a head without labels, or with labels of one class only, scores everything 0 and rejects nothing;
* null labels are left out, each head by itself; of several labels of a document the worse one counts;
* null, empty and blank texts have no features, only the bias; very long texts are read whole;
* repeated rows each give a row with equal scores; an empty table gives an empty result;
* extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import release, releasing
from .tables import discard, written
from .text import hashes, mix, runs, strings, words_of

BITS = 21
SAMPLE = 12_000
COST = 1.0
EPOCHS = 15
SMOOTHING = 0.05
LEAST = 2  #: features of fewer documents of the sample have ratio 0
BLEND = 0.25  #: share of the fitted weights beside their mean magnitude
FOLDS = 4
SLICE = 1000  #: documents whose features are in memory at once


def _shapes(distinct: pa.Array) -> pa.Array:
    s = pc.replace_substring_regex(distinct, r"\p{Lu}{2,}", "AA")
    s = pc.replace_substring_regex(s, r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "a")
    s = pc.replace_substring_regex(s, r"[\p{Lu}\p{Lt}]a", "Aa")
    return pc.replace_substring_regex(s, r"\p{N}+", "0")


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of all texts, sorted by text, and where each text begins (one more at the end)."""
    distinct, at, offsets = runs(texts)
    n = len(texts)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    text = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets)) << np.uint64(BITS)
    raw = hashes(distinct)
    word, shape = hashes(words_of(distinct))[at], hashes(_shapes(distinct))[at]
    raw = raw[at]
    top = np.uint64(64 - BITS)
    near = text[1:] == text[:-1]
    repeats = near[2:] & near[1:-1] & near[:-2] & (raw[3:] == raw[2:-1]) & (raw[2:-1] == raw[1:-2]) & (raw[1:-2] == raw[:-3]) & (raw[3:] != 0) if len(at) > 3 else np.zeros(0, bool)
    has, both = word != 0, near & (word[1:] != 0) & (word[:-1] != 0)
    drawn = near & (shape[1:] != 0) & (shape[:-1] != 0)
    two = lambda h: mix(h[:-1] * np.uint64(3) + h[1:])
    keys = [
        text[has] | (mix(word[has]) >> top),
        text[1:][both] | (two(word)[both] >> top),
        text[shape != 0] | (mix(shape[shape != 0] ^ np.uint64(0x5AD)) >> top),
        text[1:][drawn] | (mix(two(shape)[drawn] ^ np.uint64(0x5AD)) >> top),
        text[3:][repeats] | np.uint64(0xBEAD) if len(repeats) else text[:0],
    ]
    found = np.unique(np.concatenate(keys))
    begins = np.searchsorted(found, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS))
    return (found & np.uint64((1 << BITS) - 1)).astype(np.int64), begins


def log_count_ratio(flat: np.ndarray, begins: np.ndarray, y: np.ndarray) -> np.ndarray:
    sizes = np.diff(begins)
    yes = np.repeat(y > 0, sizes)
    p, q = np.bincount(flat[yes], minlength=1 << BITS), np.bincount(flat[~yes], minlength=1 << BITS)
    ratio = np.log((p + SMOOTHING) / (p + SMOOTHING).sum()) - np.log((q + SMOOTHING) / (q + SMOOTHING).sum())
    return np.where(p + q >= LEAST, ratio, 0.0)


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and dual variables of the linear hinge-loss machine; the last weight is the bias.

    Minimises ``|w|^2 / 2 + sum_i cost_i * max(0, 1 - y_i w x_i)`` through its dual, one variable at a time in a random
    order, each clipped to [0, cost_i].
    """
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            r, v = rows[i], values[i]
            slope = y[i] * (w[r] @ v + w[size]) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0.0:
                alpha[i] = new
                w[r] += step * y[i] * v
                w[size] += step * y[i]
                moved = max(moved, abs(step) * norm[i])
        if moved < 1e-3:
            break
    return w, alpha


def _weights(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Weight of each feature, without a bias."""
    ratio = log_count_ratio(np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows]))), y)
    values = [(ratio[r] / max(1.0, len(r)) ** 0.5).astype(np.float32) for r in rows]
    share = (y > 0).mean()
    w, _ = descend(rows, values, y, COST * np.where(y > 0, 0.5 / share, 0.5 / (1 - share)), 1 << BITS)
    return ratio * ((1 - BLEND) * np.abs(w[:-1]).mean() + BLEND * w[:-1])


def folds(y: np.ndarray) -> np.ndarray:
    """The part of each row, both classes dealt out evenly."""
    out = np.zeros(len(y), np.int64)
    for c in (y > 0, y < 0):
        out[c] = np.arange(c.sum()) % FOLDS
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, left_out: int) -> tuple[np.ndarray, np.ndarray]:
    """The weight of each feature, fit without a part, or with all for -1; and the scores of that part, without a bias.

    ``rows`` are the features of each text; labels are 1, 0, or negative for none.
    """
    use = np.flatnonzero(labels >= 0)
    y = np.where(labels[use] > 0, 1.0, -1.0)
    if min((y > 0).sum(), (y < 0).sum()) == 0:
        return np.zeros(0), np.zeros(0)
    rows = [rows[i] for i in use]
    fold = folds(y)
    rest = np.flatnonzero(fold != left_out)
    if abs(y[rest].sum()) == len(rest):  # a class has one row only
        rest = np.arange(len(y))
    w = _weights([rows[k] for k in rest], y[rest])
    return w, np.array([w[rows[k]].sum() / max(1.0, len(rows[k])) ** 0.5 for k in np.flatnonzero(fold == left_out)])


def bias(scores: np.ndarray, y: np.ndarray) -> float:
    """Less the bound at which the scores have the largest difference between the two classes' rates.

    The blend shifts the scores, so the bias of the fit doesn't serve.
    """
    order = np.argsort(scores, kind="stable")
    gain = np.concatenate(([0.0], np.cumsum(np.where(y[order] > 0, -1 / (y > 0).sum(), 1 / (y < 0).sum()))))
    gain[1:-1][scores[order[1:]] == scores[order[:-1]]] = -np.inf  # equal scores are on one side
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    k = int(best[len(best) // 2])
    return -(scores[order[max(k - 1, 0)]] + scores[order[min(k, len(order) - 1)]]) / 2


class Model(NamedTuple):
    quality: np.ndarray
    toxic: np.ndarray


HEADS = ("quality", "toxic")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = one.withColumn("spread", F.xxhash64("doc_id")).orderBy("spread", "doc_id").limit(sample)
    # the sample is bounded, so it may go to every executor whatever the corpus
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "spread", *HEADS).agg(F.min("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches):
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                part = b.slice(k, SLICE)
                flat, begins = features(strings(part.column("text")))
                found = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.record_batch([*[part.column(c) for c in ("doc_id", "spread", *HEADS)], found], names=["doc_id", "spread", *HEADS, "found"])
            release()

    @releasing
    def learn(table: pa.Table) -> pa.Table:
        head, left_out = table.column("head")[0].as_py(), table.column("left_out")[0].as_py()
        order = pc.sort_indices(table.select(["spread", "doc_id"]), sort_keys=[("spread", "ascending"), ("doc_id", "ascending")]).to_numpy()
        found = table.column("found").combine_chunks()
        flat, at = found.values.to_numpy(), found.offsets.to_numpy()
        w, scores = fit([flat[at[i] : at[i + 1]] for i in order], pc.fill_null(table.column(head), -1).to_numpy()[order], left_out)
        return pa.table({"head": [head], "left_out": pa.array([left_out], pa.int32()), "weights": pa.array([w.astype("<f4").tobytes() if left_out < 0 else b""], pa.binary()), "scores": pa.array([scores.astype("<f8").tobytes()], pa.binary())})

    known = written(rows.mapInArrow(read, f"doc_id {kind}, spread long, quality int, toxic int, found array<int>"), "labelled")
    tasks = docs.sparkSession.createDataFrame([(h, k) for h in HEADS for k in range(-1, FOLDS)], "head string, left_out int")
    got = {(r["head"], r["left_out"]): r for r in known.crossJoin(F.broadcast(tasks)).groupBy("head", "left_out").applyInArrow(learn, "head string, left_out int, weights binary, scores binary").collect()}
    label = {h: np.array([r[h] for r in known.where(F.col(h).isNotNull()).select("spread", "doc_id", h).orderBy("spread", "doc_id").collect()]) for h in HEADS}
    discard(known)

    def head(h: str) -> np.ndarray:
        out = np.zeros((1 << BITS) + 1, np.float32)
        if (h, -1) in got and (w := np.frombuffer(bytes(got[h, -1]["weights"]), "<f4")).size:
            y = np.where(label[h] > 0, 1.0, -1.0)
            scores, fold = np.zeros(len(y)), folds(y)
            for k in range(FOLDS):
                scores[fold == k] = np.frombuffer(bytes(got[h, k]["scores"]), "<f8")
            out[:-1], out[-1] = w, bias(scores, y)
        return out

    return Model(*map(head, HEADS))


def score_texts(texts: pa.Array, heads: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    out = [np.zeros(len(texts)) for _ in heads]
    for k in range(0, len(texts), SLICE):
        flat, begins = features(texts.slice(k, SLICE))
        scale = np.maximum(1.0, np.diff(begins)) ** 0.5
        for o, w in zip(out, heads, strict=True):
            sums = np.concatenate(([0.0], np.cumsum(w[flat], dtype=np.float64)))[begins]
            o[k : k + SLICE] = np.diff(sums) / scale + w[-1]
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``quality_score``, ``toxic_score`` and ``keep``: one row for each input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            q, t = score_texts(strings(b.column(1)), (m.quality, m.toxic))
            keep = (q >= 0) & ((t < 0) | (not m.toxic.any()))
            yield pa.record_batch([b.column(0), pa.array(q), pa.array(t), pa.array(keep)], names=["doc_id", "quality_score", "toxic_score", "keep"])
            release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality_score double, toxic_score double, keep boolean")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample))
