"""Packing by minimum bin slack.

Documents are cut to windows of ``capacity`` tokens. A longer document gives full windows of its own first; what is left
of each document is packed. For each window, a bitset subset-sum program over the multiset of remaining lengths finds
the filling closest to the capacity: the bitset after each distinct length says which totals are reachable, and
backtracking through them gives how many pieces of each length the best total takes. The longest remaining piece always
goes in, so that every window makes progress, and a filling is repeated as long as the counts allow.

Tokens are those of the byte-level vocabulary in ``tokenizer``, counted whole: texts are cut only before white space that
follows something else, where the vocabulary's pre-tokens end too, so that a text's count is the sum over its pieces.
Distinct pieces of a slice of texts are encoded once in a worker.

Lengths are packed in lots of about ``LOT`` documents, chosen by a hash of the row; a lot is one task's work, so packing
is linear in the corpus and no task grows with it. Only identifiers, lengths and how often they stand are shuffled, never
texts, and copies of a row are spread over the lots. A lot's last windows may stay open, at most a few in tens of thousands.

Defined results:

* each document is followed by one separator token;
* null and empty texts have no tokens and are in no window; blank ones have the tokens of their white space;
* repeated rows are pieces of their own; equal lengths are filled in order of ``doc_id``, nulls first;
* very long texts are cut at window bounds, none of their tokens is lost;
* an empty table gives no windows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import strings
from .tokens import TOKENIZER, lengths

CAPACITY = 2048
LOT = 20_000


def best_filling(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths and how many of each, with the largest total that is at most ``room``."""
    lengths = sorted((s for s in counts if 0 < s <= room), reverse=True)
    full = (1 << (room + 1)) - 1
    reach, before = 1, []
    for s in lengths:
        before.append(reach)
        left, step = min(counts[s], room // s), 1
        while left > 0:  # counts in powers of two, the last with the rest
            take = min(step, left)
            reach |= (reach << (s * take)) & full
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    out = []
    for s, was in zip(reversed(lengths[: len(before)]), reversed(before), strict=True):
        n = 0
        while not was >> total & 1:  # fewest of this length that lead to a total reachable without it
            total -= s
            n += 1
        if n:
            out.append((s, n))
    return out


def fillings(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """All windows of a multiset of lengths, as fillings and how often each is used."""
    left = {s: n for s, n in counts.items() if n > 0}
    out = []
    while left:
        top = max(left)
        left[top] -= 1
        fill = defaultdict(int, best_filling(left, capacity - top))
        left[top] += 1
        fill[top] += 1
        times = min(left[s] // n for s, n in fill.items())
        for s, n in fill.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        out.append((sorted(fill.items(), reverse=True), times))
    return out


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``n`` (tokens and the separator) and ``spread``, a hash of the row; without documents that have no tokens."""

    def count(batches):
        for b in batches:
            n = lengths(strings(b.column("text")), tokenizer)
            yield pa.record_batch([b.column("doc_id"), pa.array(n + 1, pa.int64()), b.column("spread")], names=["doc_id", "n", "spread"]).filter(pa.array(n > 0))

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("spread")).where("text <> ''")
    return rows.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, spread long")


def _packed(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        lot = table.column("lot")[0].as_py()
        often = np.repeat(np.arange(table.num_rows), table.column("times").to_numpy())
        ids, n = table.column("doc_id").take(pa.array(often)).to_pylist(), table.column("n").to_numpy()[often].tolist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, n[i]))
        windows: list[tuple[list, list[int], list[int]]] = []
        pieces: dict[int, list[tuple]] = defaultdict(list)
        for i in order:
            start = 0
            while n[i] - start >= capacity:
                windows.append(([ids[i]], [start], [capacity]))
                start += capacity
            if n[i] > start:
                pieces[n[i] - start].append((ids[i], start))
        for p in pieces.values():
            p.reverse()
        for fill, times in fillings({s: len(p) for s, p in pieces.items()}, capacity):
            for _ in range(times):
                took = [(*pieces[s].pop(), s) for s, k in fill for _ in range(k)]
                windows.append(([t[0] for t in took], [t[1] for t in took], [t[2] for t in took]))
        used = np.array([sum(w[2]) for w in windows], np.int64)
        return pa.table(
            {
                "lot": pa.array([lot] * len(windows), pa.int64()),
                "window": pa.array(np.arange(len(windows), dtype=np.int64)),
                "doc_ids": pa.array([w[0] for w in windows], pa.list_(table.schema.field("doc_id").type)),
                "starts": pa.array([w[1] for w in windows], pa.list_(pa.int64())),
                "lengths": pa.array([w[2] for w in windows], pa.list_(pa.int64())),
                "used": pa.array(used),
                "slack": pa.array(capacity - used),
            }
        )

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, lot: int = LOT, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each window: its lot and number, and of each piece the document, its first token and its length."""
    if capacity < 2:
        raise ValueError("a window holds two tokens at least")
    kind = docs.schema["doc_id"].dataType.simpleString()
    lots = F.lit(max(1, -(-docs.count() // lot)))
    rows = token_counts(docs, tokenizer).groupBy("doc_id", "n", "spread").agg(F.count(F.lit(1)).alias("times"))
    # copies of a row go to successive lots, the same number to each and one more to the first ones
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least("times", lots) - 1)))
    rows = rows.select("doc_id", "n", F.pmod(F.pmod("spread", lots) + F.col("k"), lots).alias("lot"), (F.floor(F.col("times") / lots) + (F.col("k") < F.pmod("times", lots)).cast("long")).alias("times"))
    return rows.groupBy("lot").applyInArrow(_packed(capacity), f"lot long, window long, doc_ids array<{kind}>, starts array<bigint>, lengths array<bigint>, used long, slack long")
