"""N-gram Jaccard join with token-combination prefixes.

A document is its set of word n-grams, and all pairs of documents whose sets have a Jaccard similarity of at least
``threshold`` are found, exactly, without a cap on partners. Equal texts share one set, known by a 64-bit hash of the
text, and are joined as one; n-grams are known by a 64-bit hash at every size of the corpus (that two sets of 1,000
n-grams have one collision between them, which would alter their similarity by a thousandth, has a chance of 5 * 10^-14).

1. Each text is read once, in Arrow batches, into (n-gram, set) postings of a lot of sets, in which a set is known by its
   place. They are shuffled by ranges of the n-gram hash, sorted and packed in about 7 bytes a posting, however many
   ranges there are, and give every n-gram's frequency. Texts that several lots have count once in each, which
   moves them in the order of n-grams and so can't change a result.
2. N-grams of one set can't be shared. The others go back to their lot as their rank by frequency within the range. A set
   keeps on only if enough of its n-grams are shared to reach the threshold. Its shared n-grams are ordered by rank, those
   of at most ``FREQUENT`` sets first; those of one set come before all of them.
3. Prefixes. Two similar sets share an n-gram of both prefixes of ``size - ceil(t * size) + 1`` n-grams. N-grams of at
   most ``FREQUENT`` sets are indexed singly. More frequent ones fall into classes by hash, and only pairs of n-grams of
   one class are indexed; the prefix is extended until its n-grams, each class counted less one, are as many as before.
   A set that has all that in common with another one but shares no single and no pair would need more differences
   than the threshold allows. The number of classes grows with the sets' sizes: a small set must be able to reach its
   count. It is taken from the smaller set's size band, so a set is indexed for its own band and those below that can
   hold partners.
4. Sets that share an index key and pass the bounds on size and on remaining n-grams are candidates. Groups of copies
   share hundreds of keys, so long lists of sets under one key are compared with groups that were paired before, and only
   what is new in them is paired; this may add candidates, never take one away. Each later set's candidates are verified
   where its least partner is at home, so that the sets of a group of copies come together once; a home with many sets is
   cut into blocks.
5. The pairs of n near copies are n * n / 2, so they aren't formed one by one. Sets that are mostly n-grams of more than
   ``FREQUENT`` sets are gathered into crowds, of ``CROWD`` sets at most, around one that they are similar to. A crowd is
   indexed as one, and candidates are pairs of crowds and single sets. Within a crowd, and between it and others, a bound
   settles most pairs without a look at them and the others are counted in bits (see ``_verify_crowd``). Which sets make
   up a crowd can't change a result.

Memory in each task is bounded by the sizes of ranges and blocks, which don't depend on the corpus; only the numbers of
ranges and blocks do. A side is broadcast only if it has at most ``BROADCAST_ROWS`` rows. ``docs`` is read again where a
task is lost and must come in the same order then, as files do; parts of two different orders stop the job.

Defined results:

* words are compared in lower case and without punctuation (see ``text``); a text of fewer than n words has one gram, all
  of them; null, empty and blank texts, and those without a word, have no grams and are in no pair, not even of copies;
* ``classes`` has a row for each row of ``docs``, also where ``doc_id`` is null or repeated; ``class_id`` is the least text
  hash of the class and null for texts without a word, which have no links; equal texts are links of one another;
* in ``similar_pairs`` a pair is given once, lesser ``doc_id`` first; equal texts have similarity 1; rows that repeat a ``doc_id`` add no pair
  of it with itself; rows with a null ``doc_id`` are in no pair;
* in ``one_of_each`` one row of each group that pairs connect stays, the one with the least ``doc_id`` (nulls last), then
  the least text hash; of rows that repeat both, the one whose other columns come first as JSON; documents without grams
  all stay;
* very long texts are read whole; an empty table gives no pairs and no documents;
* extra columns are kept by ``one_of_each``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import pack, release, releasing, unpack
from .tables import arrow_batches, discard, written
from .text import mix, ngrams, strings, word_hashes

N = 3
THRESHOLD = 0.5
FREQUENT = 256  #: n-grams of more sets are indexed in pairs only
RANGE = 8_000_000  #: about so many postings are in memory at once in a task
FLUSH = 1_500_000  #: postings gathered before they are packed
MANY = 16  #: sets under one key from which on lists are compared with groups before they are paired
BATCH = 1000  #: texts, or sets, that go to Python at once
BLOCK = 2048  #: sets of a home that are verified together
CROWD = 4096  #: sets of one crowd at most, and about so many that are compared with a crowd at once

_U = np.uint64
_OFTEN = _U(1 << 63)  #: set in the numbers of n-grams of more than FREQUENT sets, so that they come after all others


def _concat(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts).astype(dtype, copy=False) if parts else np.zeros(0, dtype)


def _order(x: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit numbers: their high bits are sorted with the places in the low ones, which is far faster."""
    if len(x) < 2:
        return np.arange(len(x))
    width = _U((len(x) - 1).bit_length())
    same = 64 - int(x.min() ^ x.max()).bit_length()
    # in place and by slices, as this is where a range's task needs most memory
    key = x << _U(same) if same < 64 else x.copy()
    key >>= width
    key <<= width
    key |= np.arange(len(x), dtype=_U)
    key.sort()
    order = (key & ((_U(1) << width) - _U(1))).view(np.int64)
    step = 1 << 20
    wrong = np.concatenate([a + np.flatnonzero((y := x[order[a : a + step + 1]])[1:] < y[:-1]) for a in range(0, len(x) - 1, step)])
    if len(wrong):  # different numbers with the same high bits
        key >>= width
        for a, b in zip(np.unique(np.searchsorted(key, key[wrong])).tolist(), np.unique(np.searchsorted(key, key[wrong], "right")).tolist(), strict=True):
            order[a:b] = order[a:b][np.argsort(x[order[a:b]], kind="stable")]
    return order


# -- 1: postings by range of the n-gram hash ------------------------------------------------------------------------


def _postings(n: int, ranges: int):
    """Texts with their hashes -> in lots of sets: packed postings by range, and the sets' names and sizes."""
    from pyspark import TaskContext

    shift = _U(64 - (ranges - 1).bit_length())

    def flush(grams: list[np.ndarray], owners: list[np.ndarray], sets: list[np.ndarray], number: int) -> pa.RecordBatch:
        gram, owner, ids = _concat(grams, _U), _concat(owners, np.int64), _concat(sets, _U)
        first = np.zeros(len(ids), bool)
        first[np.unique(ids, return_index=True)[1]] = True
        if not first.all():  # equal texts are one set
            here = first[owner]
            gram, owner, ids = gram[here], (np.cumsum(first) - 1)[owner[here]], ids[first]
        order = _order(gram)
        gram, owner = gram[order], owner[order].astype(np.uint32)
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
        gram, owner = gram[new], owner[new]
        ends = np.searchsorted(gram >> shift if ranges > 1 else np.zeros(len(gram), _U), np.arange(ranges + 1, dtype=_U))
        # the name depends on what is in the lot, so that lots of a task that ran twice are never taken for one another
        lot = mix(np.array([np.bitwise_xor.reduce(mix(ids + np.arange(len(ids), dtype=_U))) ^ _U(TaskContext.get().partitionId() << 32 | number)]))
        numbers = np.flatnonzero(np.diff(ends))
        blobs = [pack(np.diff(gram[ends[r] : ends[r + 1]], prepend=_U(0)), owner[ends[r] : ends[r + 1]]) for r in numbers.tolist()]
        blobs.append(pack(ids, np.bincount(owner, minlength=len(ids)).astype(np.uint32)))
        numbers = np.append(numbers, ranges + int(lot[0] % _U(ranges)))
        return pa.record_batch([pa.array(numbers, pa.int64()), pa.array(np.repeat(lot.view(np.int64), len(numbers))), pa.array(blobs, pa.binary())], names=["range", "lot", "blob"])

    def run(batches):
        grams, owners, sets, count, docs, number = [], [], [], 0, 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                g, o = ngrams(*word_hashes(strings(part.column("text"))), n)
                grams.append(g)
                owners.append(o + docs)
                sets.append(part.column("set").to_numpy().view(_U))
                docs += part.num_rows
                count += len(g)
                if count >= FLUSH:
                    yield flush(grams, owners, sets, number)
                    grams, owners, sets, count, docs, number = [], [], [], 0, 0, number + 1
        if count:
            yield flush(grams, owners, sets, number)
        del grams, owners, sets
        release()

    return run


# -- 2: shared n-grams by set ---------------------------------------------------------------------------------------


def _shared(ranges: int):
    """The postings of one range -> by lot: which of them other sets share, as ranks of the n-grams by frequency."""

    @releasing
    def run(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py()
        if number >= ranges:  # names and sizes pass through
            return pa.table({"lot": table.column("lot"), "range": pa.array([-1] * table.num_rows, pa.int64()), "blob": table.column("blob")})
        parts, steps = [], []
        for x in table.column("blob"):
            step, local = unpack(x.as_buffer())
            steps.append(step)
            parts.append(local)
        gram, at = np.empty(sum(map(len, parts)), _U), 0
        while steps:
            step = steps.pop(0)
            np.cumsum(step, dtype=_U, out=gram[at : at + len(step)])
            at += len(step)
        del step
        order = _order(gram)
        gram = gram[order]
        new = np.ones(len(gram), bool)
        np.not_equal(gram[1:], gram[:-1], out=new[1:])
        del gram
        begins = np.flatnonzero(new)
        often = np.full(len(begins), len(new))
        often[:-1] = begins[1:]
        often -= begins
        del begins, new
        several = np.flatnonzero(often > 1)
        rank = np.full(len(often), -1, np.int32)
        rank[several[np.argsort(often[several], kind="stable")]] = np.arange(len(several), dtype=np.int32)
        rare = np.count_nonzero(often[several] <= FREQUENT)
        of = np.empty(len(order), np.int32)
        of[order] = np.repeat(rank, often)
        del order
        out, at = [], 0
        for local in parts:
            mine = of[at : at + len(local)]
            at += len(local)
            key = np.sort(local[mine >= 0].astype(_U) << _U(32) | mine[mine >= 0].astype(_U))
            out.append(pack(np.array([len(local), rare], np.int64), np.diff(key >> _U(32), prepend=_U(0)).astype(np.uint32), key.astype(np.uint32)))
        return pa.table({"lot": table.column("lot"), "range": table.column("range"), "blob": pa.array(out, pa.binary())})

    return run


def _ordered(threshold: float, ranges: int):
    """One lot -> the sets that can have partners, their shared n-grams' numbers in the order of frequency."""
    low = _U((ranges - 1).bit_length())

    @releasing
    def run(table: pa.Table) -> pa.Table:
        owners, numbers, count, sets, size = [], [], 0, np.zeros(0, _U), np.zeros(0, np.int64)
        for r, x in zip(table.column("range").to_pylist(), table.column("blob").combine_chunks(), strict=True):
            if r < 0:
                sets, size = unpack(x.as_buffer())
                size = size.astype(np.int64)
                continue
            (n, rare), step, rank = unpack(x.as_buffer())
            count += int(n)
            owners.append(np.cumsum(step, dtype=np.int64))
            numbers.append(rank.astype(_U) << low | _U(r) | np.where(rank < rare, _U(0), _OFTEN))
        if count != size.sum():
            raise RuntimeError("parts of a lot are missing: the documents came in another order when a lost part was read again")
        owner, number = _concat(owners, np.int64), _concat(numbers, _U)
        shared = np.bincount(owner, minlength=len(sets))
        good = (shared > 0) & (shared >= np.ceil(threshold * size - 1e-9))
        use = good[owner]
        owner, number = owner[use], number[use]
        order = np.lexsort((number, owner))
        number = number[order]
        upto = np.concatenate(([0], np.cumsum(np.where(good, shared, 0))))
        rare = np.concatenate(([0], np.cumsum(number < _OFTEN)))
        chosen = np.flatnonzero(good)
        # sets that are mostly frequent n-grams can be near copies of many: they are gathered by the least hash of those
        hashed = np.where(number < _OFTEN, ~_U(0), mix(number))
        frequent = shared[chosen] - (rare[upto[chosen + 1]] - rare[upto[chosen]])
        crowded = frequent >= np.maximum(1, np.ceil(threshold * size[chosen] - 1e-9))
        bucket = np.minimum.reduceat(hashed, upto[chosen]) if len(chosen) else hashed[:0]
        return pa.table(
            {
                "lot": pa.array(np.full(len(chosen), table.column("lot")[0].as_py(), np.int64)),
                "set": pa.array(sets[chosen].view(np.int64)),
                "size": pa.array(size[chosen], pa.int32()),
                "n_rare": pa.array((rare[upto[chosen + 1]] - rare[upto[chosen]]), pa.int32()),
                "grams": pa.array([pack(np.diff(number[upto[k] : upto[k + 1]], prepend=_U(0))) for k in chosen.tolist()], pa.binary()),
                "bucket": pa.array(bucket.view(np.int64), pa.int64(), mask=~crowded),
            }
        )

    return run


def _numbers(blob) -> np.ndarray:
    """A set's shared n-grams."""
    return np.cumsum(unpack(blob.as_buffer())[0], dtype=_U)


def _coded(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The sets' names and sizes, their n-grams as places in what all have, where each begins, and how many those are."""
    grams = [_numbers(x) for x in table.column("grams").combine_chunks()]
    ends = np.cumsum([0, *[len(g) for g in grams]])
    vocabulary, coded = np.unique(_concat(grams, _U), return_inverse=True)
    return table.column("set").to_numpy(), table.column("size").to_numpy().astype(np.int64), coded.astype(np.int32), ends, len(vocabulary)


def _crowds(threshold: float):
    """Sets of one bucket -> crowds of at least ``MANY`` that are similar to one of them; the others get no row."""

    @releasing
    def run(table: pa.Table) -> pa.Table:
        ids, size, coded, ends, words = _coded(table.sort_by("set"))
        owner = np.repeat(np.arange(len(ids)), np.diff(ends))
        crowd, alive, chosen = ids.copy(), np.ones(len(ids), bool), np.zeros(len(ids), bool)
        for _ in range(MANY):
            if alive.sum() < MANY:
                break
            often = np.bincount(coded[alive[owner]], minlength=words)
            pivot = int(np.argmax(np.where(alive, np.add.reduceat(often[coded], ends[:-1]) / size, -1)))
            has = np.zeros(words, np.int32)
            has[coded[ends[pivot] : ends[pivot + 1]]] = 1
            both = np.add.reduceat(has[coded], ends[:-1])
            near = alive & (both / (size + size[pivot] - both) >= threshold)
            near[pivot] = True
            if near.sum() >= MANY:
                crowd[near] = ids[near].min()
                chosen |= near
            alive &= ~near
        return pa.table({"set": pa.array(ids[chosen]), "crowd": pa.array(crowd[chosen])})

    return run


# -- 3: index keys of prefixes --------------------------------------------------------------------------------------


def prefix_keys(grams: np.ndarray, size: int, n_rare: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set and, of each, how many of its n-grams sets that first meet there can share at most.

    ``grams`` are the shared n-grams in the common order, the ``n_rare`` rare ones first; the ``size - len(grams)`` others
    come before them.
    """
    need = size - math.ceil(threshold * size - 1e-9) + 1 - (size - len(grams))
    if need <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    single = min(need, n_rare)
    keys, rest = [mix(grams[:single])], [len(grams) - np.arange(single)]
    frequent = grams[n_rare:]
    if single < need and len(frequent):
        own = size.bit_length() - 1
        least = max(1, math.ceil(threshold * size - 1e-9)).bit_length() - 1
        for band in range(least, own + 1):
            # a set of 2**band n-grams at least can spare so many classes; see the tests
            spare = math.ceil(threshold * (1 << band) - 1e-9) - 1
            if spare < 1:  # too small to be indexed in pairs
                at = np.arange(min(need - single, len(frequent)))
                keys.append(mix(mix(frequent[at]) + _U(2 * band + 1)))
                rest.append(len(frequent) - at)
                continue
            classes = 1 << (max(1, spare // 2).bit_length() - 1)
            of = (mix(frequent ^ _U(0xC1A55)) % _U(classes)).astype(np.int64)
            seen, counted, stop = set(), single, len(frequent)
            for k, c in enumerate(of.tolist()):
                counted += c in seen
                seen.add(c)
                if counted >= need:
                    stop = k + 1
                    break
            order = np.argsort(of[:stop], kind="stable")
            begins = np.flatnonzero(np.diff(of[order], prepend=-1))
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), stop], strict=True):
                if b - a > 1:
                    i, j = np.triu_indices(b - a, 1)
                    i, j = order[a + i], order[a + j]
                    keys.append(mix(mix(frequent[i]) + mix(frequent[j] + _U(1)) * _U(3) + _U(2 * band + 2)))
                    # the first n-gram that two sets share need not be in the pair, so this bounds nothing
                    rest.append(np.full(len(i), len(grams)))
    return np.concatenate(keys), np.concatenate(rest)


def _keys(threshold: float, ranges: int):
    """Sets -> packed index keys by range of the key, under the names of their crowds."""
    shift = _U(64 - (ranges - 1).bit_length())

    def flush(keys, rests, counts, names, crowds, sizes):
        key, rest = _concat(keys, _U), _concat(rests, np.uint32)
        owner = np.repeat(np.arange(len(names)), counts)
        order = np.argsort(key, kind="stable")
        key, rest, owner = key[order], rest[order], owner[order]
        ids, size, crowded = np.array(names, np.int64).view(_U), np.array(sizes, np.uint32), np.array(crowds, np.uint8)
        ends = np.searchsorted(key >> shift if ranges > 1 else np.zeros(len(key), _U), np.arange(ranges + 1, dtype=_U))
        numbers, blobs = [], []
        for r in np.flatnonzero(np.diff(ends)).tolist():
            s = slice(ends[r], ends[r + 1])
            present, local = np.unique(owner[s], return_inverse=True)
            numbers.append(r)
            blobs.append(pack(ids[present], size[present], crowded[present], np.diff(key[s], prepend=_U(0)), local.astype(np.uint32), rest[s]))
        return pa.record_batch([pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], names=["range", "blob"])

    def run(batches):
        keys, rests, counts, names, crowds, sizes, total = [], [], [], [], [], [], 0
        for b in batches:
            for name, crowded, size, rare, blob in zip(*[b.column(c).to_pylist() for c in ("name", "crowded", "size", "n_rare")], b.column("grams"), strict=True):
                k, r = prefix_keys(_numbers(blob), size, rare, threshold)
                if len(k):
                    keys.append(k)
                    rests.append(r)
                    counts.append(len(k))
                    names.append(name)
                    crowds.append(crowded)
                    sizes.append(size)
                    total += len(k)
            if total >= FLUSH:
                yield flush(keys, rests, counts, names, crowds, sizes)
                keys, rests, counts, names, crowds, sizes, total = [], [], [], [], [], [], 0
        if total:
            yield flush(keys, rests, counts, names, crowds, sizes)

    return run


def _runs_to_pairs(begins: np.ndarray, lengths: np.ndarray, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within each run, at most about ``most`` at a time."""
    for n in np.unique(lengths[lengths > 1]).tolist():
        mine = begins[lengths == n]
        if n * (n - 1) // 2 <= most:
            i, j = np.triu_indices(n, 1)
            step = max(1, most // len(i))
            for k in range(0, len(mine), step):
                yield (mine[k : k + step, None] + i).ravel(), (mine[k : k + step, None] + j).ravel()
        else:
            for b in mine.tolist():
                rows = max(1, most // n)
                for a in range(0, n, rows):
                    i = np.arange(a, min(a + rows, n))
                    j = np.arange(n)
                    x, y = np.broadcast_arrays(i[:, None], j[None, :])
                    later = x < y
                    yield b + x[later], b + y[later]


def _blocks(a: np.ndarray, b: np.ndarray, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of two disjoint lists, at most about ``most`` at a time."""
    step = max(1, most // max(1, len(b)))
    for k in range(0, len(a) if len(b) else 0, step):
        part = a[k : k + step]
        yield np.repeat(part, len(b)), np.tile(b, len(part))


def _within(a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a list."""
    for i, j in _runs_to_pairs(np.zeros(1, np.int64), np.array([len(a)])):
        yield a[i], a[j]


def _pairs_of_lists(lists: Iterator[np.ndarray], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that hold all pairs of all lists, most of them once: lists of a group of copies are much alike.

    A set may be in one group, of which all pairs were given out. Of a list, the pairs within one group are skipped. If the
    list has half of that group, its other members join the group, and their pairs with all of it are given out;
    otherwise only those with the list's members are. A list that shares no group by half becomes one.
    """
    group = np.full(n, -1, np.int64)
    members: list[np.ndarray] = []
    for m in lists:
        mine = group[m]
        names, counts = np.unique(mine[mine >= 0], return_counts=True)
        if not len(names) or 2 * counts.max() < len(m):
            yield from _within(m)
            group[m] = len(members)
            members.append(m)
            continue
        g = int(names[np.argmax(counts)])
        rest = m[mine != g]
        if not len(rest):
            continue
        # members that have left for another group since are still paired with those that stayed
        whole = members[g][group[members[g]] == g]
        joins = 2 * counts.max() >= len(whole)
        yield from _within(rest)
        yield from _blocks(rest, whole if joins else m[mine == g])
        if joins:
            group[rest] = g
            members[g] = np.concatenate([whole, rest])


def _candidates(threshold: float):
    """The index keys of one range -> distinct pairs of sets, or crowds, that the bounds let through."""

    @releasing
    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_buffer()) for x in table.column("blob").combine_chunks()]
        # by the signed value, as the rest of the plan compares sets
        sets, first, where = np.unique(_concat([p[0] for p in parts], _U).view(np.int64), return_index=True, return_inverse=True)
        crowded = _concat([p[2] for p in parts], bool)[first]
        starts = np.cumsum([0, *[len(p[0]) for p in parts]])
        key = _concat([np.cumsum(p[3], dtype=_U) for p in parts], _U)
        owner = _concat([where[starts[k] : starts[k + 1]][p[4]] for k, p in enumerate(parts)], np.int64)
        size = _concat([p[1][p[4]] for p in parts], np.int64)
        rest = _concat([p[5] for p in parts], np.int64)
        del parts
        order = np.lexsort((owner, key))
        key, owner, rest, size = key[order], owner[order], rest[order], size[order]
        # a crowd stands under a key once, with its least and its largest set there
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))) if len(key) else np.zeros(0, np.int64)
        low, high, rest = (f.reduceat(x, new) if len(new) else x for f, x in ((np.minimum, size), (np.maximum, size), (np.maximum, rest)))
        key, owner = key[new], owner[new]
        least, largest = np.full(len(sets), np.iinfo(np.int64).max), np.zeros(len(sets), np.int64)
        np.minimum.at(least, owner, low)
        np.maximum.at(largest, owner, high)
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(begins, len(key)))
        # two sets of sizes x <= y share at least share * (x + y) n-grams, so 2 * share * x of the smaller one must remain
        share = threshold / (1 + threshold)
        part = share * low
        some = np.logical_or.reduceat(rest >= 2 * part - 1e-9, begins) if len(key) else np.zeros(0, bool)
        begins, lengths = begins[some], lengths[some]
        found, waiting, room = [], 0, 1_500_000
        done = np.zeros(0, np.int64)

        def keep(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal found, waiting, room, done
            pair = np.unique(np.minimum(a, b) << 32 | np.maximum(a, b))
            found.append(pair)
            waiting += len(pair)
            if waiting > room:
                done = np.unique(np.concatenate([done, *found]))
                found, waiting, room = [], 0, max(1_500_000, len(done))

        short = lengths < MANY
        for i, j in _runs_to_pairs(begins[short], lengths[short]):
            ok = (high[i] >= threshold * low[j] - 1e-9) & (high[j] >= threshold * low[i] - 1e-9) & (np.minimum(rest[i], rest[j]) >= part[i] + part[j] - 1e-9)
            keep(owner[i[ok]], owner[j[ok]])
        order = np.argsort(-lengths[~short], kind="stable")
        lists = (np.unique(owner[b : b + n]) for b, n in zip(begins[~short][order].tolist(), lengths[~short][order].tolist(), strict=True))
        for a, b in _pairs_of_lists(lists, len(sets)):
            ok = (largest[a] >= threshold * least[b] - 1e-9) & (largest[b] >= threshold * least[a] - 1e-9)
            keep(a[ok], b[ok])
        done = np.unique(np.concatenate([done, *found])) if found else done
        a, b = done >> 32, done & 0xFFFFFFFF
        return pa.table({"a": pa.array(sets[a]), "b": pa.array(sets[b]), "crowded": pa.array(crowded[a] | crowded[b])})

    return run


# -- 4: verification ------------------------------------------------------------------------------------------------


_VERIFIED = "a long, b long, jaccard double, links long"  #: a pair, or, without ``b``, a set and its links


def _found(a, b, jaccard, ids: np.ndarray, links: np.ndarray) -> pa.Table:
    a, b, jaccard = _concat(a, np.int64), _concat(b, np.int64), _concat(jaccard, np.float64)
    of = np.flatnonzero(links)
    parts = [
        {"a": np.minimum(a, b), "b": pa.array(np.maximum(a, b)), "jaccard": pa.array(jaccard), "links": pa.nulls(len(a), pa.int64())},
        {"a": ids[of], "b": pa.nulls(len(of), pa.int64()), "jaccard": pa.nulls(len(of), pa.float64()), "links": pa.array(links[of])},
    ]
    return pa.concat_tables([pa.table(p) for p in parts])


def _verify(threshold: float):
    """The sets and the pairs of one block -> the pairs that reach the threshold, and the sets' links by them."""

    @releasing
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("set")
        ids, size, coded, ends, words = _coded(table)
        copies = table.column("copies").to_numpy()
        partners = table.column("partners").combine_chunks()
        has, links = np.zeros(words, bool), np.zeros(len(ids), np.int64)
        offsets, flat = partners.offsets.to_numpy(), partners.flatten().to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[:1]
        a_out, b_out, j_out = [], [], []
        for k in np.flatnonzero(np.diff(offsets)).tolist():
            others = np.searchsorted(ids, flat[offsets[k] : offsets[k + 1]])
            mine = coded[ends[k] : ends[k + 1]]
            has[mine] = True
            both = np.array([np.count_nonzero(has[coded[ends[o] : ends[o + 1]]]) for o in others.tolist()], np.int64)
            has[mine] = False
            jaccard = both / (size[k] + size[others] - both)
            ok = jaccard >= threshold - 1e-12
            others = others[ok]
            a_out.append(ids[others])
            b_out.append(np.full(len(others), ids[k], np.int64))
            j_out.append(jaccard[ok])
            links[k] += copies[others].sum()
            links[others] += copies[k]
        return _found(a_out, b_out, j_out, ids, links)

    return run


def _bits(coded: np.ndarray, ends: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Which of the ``n`` n-grams that have a place each set holds, in words of 64 bits."""
    width = max(1, -(-n // 64))
    out = np.zeros((len(ends) - 1, width), _U)
    step = max(1, 16_000_000 // (64 * width))
    for a in range(0, len(out), step):
        b = min(a + step, len(out))
        at = place[coded[ends[a] : ends[b]]]
        row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
        part = np.zeros((b - a, 64 * width), bool)
        part[row[at >= 0], at[at >= 0]] = True
        out[a:b] = np.packbits(part, axis=1).view(_U)
    return out


def _verify_crowd(threshold: float, every: bool):
    """A crowd and sets to compare it with, or none but its own -> as ``_verify``; without ``every``, as many pairs as connect the same sets.

    Let P be the n-grams that most of the crowd have. Two sets without x and y of them share at least ``len(P) - x - y``
    n-grams, which settles most pairs without a look at them: sets are sorted by how much of that bound they use up. Of
    the others, what they share of P is counted in bits, and what else they share only where it can matter.
    """
    share = threshold / (1 + threshold)

    @releasing
    def run(table: pa.Table) -> pa.Table:
        ids, size, coded, ends, words = _coded(table)
        copies = table.column("copies").to_numpy()
        guest = table.column("guest").to_numpy(zero_copy_only=False).astype(bool)
        own = not guest.any()
        home = np.flatnonzero(~guest)
        others = home if own else np.flatnonzero(guest)
        owner = np.repeat(np.arange(len(ids)), np.diff(ends))
        usual = 2 * np.bincount(coded[~guest[owner]], minlength=words) > len(home)
        n = int(usual.sum())
        place = np.where(usual, np.cumsum(usual) - 1, -1)
        bits = _bits(coded, ends, place, n)
        # whole numbers, so that a pair is settled from both its sides or from none
        room, used = 1024 * n, np.ceil(1024 * (share * size + n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))).astype(np.int64)
        # besides P, only what several sets have can be shared
        extra = ~usual[coded] & (np.bincount(coded, minlength=words) > 1)[coded]
        rest, begin = coded[extra], np.concatenate(([0], np.cumsum(np.bincount(owner[extra], minlength=len(ids)))))
        count = np.diff(begin)
        has, links = np.zeros(words, bool), np.zeros(len(ids), np.int64)
        others = others[np.argsort(used[others], kind="stable")]
        home = home[np.argsort(used[home], kind="stable")]
        sure = np.zeros(len(home), np.int64) if every else np.searchsorted(used[others], room - used[home], "right")
        weight = np.concatenate(([0], np.cumsum(copies[others])))
        links[home] += weight[sure]
        label, a_out, b_out, j_out = np.arange(len(ids)), [], [], []

        def join(a: int, b: int) -> None:
            if label[a] != label[b]:
                a_out.append(ids[[a]])
                b_out.append(ids[[b]])
                j_out.append(np.full(1, np.nan))
                label[label == label[a]] = label[b]

        if own:
            links[home] -= np.where(sure > np.arange(len(home)), copies[home], 0)  # not with itself
        elif not every:
            back = np.searchsorted(used[home], room - used[others], "right")
            links[others] += np.concatenate(([0], np.cumsum(copies[home])))[back]
            for g in others[back > 0].tolist():
                join(g, int(home[0]))
        for h in home[sure > 0].tolist():
            join(h, int(others[0]))
        for k, (h, s) in enumerate(zip(home.tolist(), sure.tolist(), strict=True)):
            # of the crowd's own pairs, each is looked at once
            of = others[max(s, k + 1) if own else s :]
            both = np.bitwise_count(bits[of] & bits[h]).sum(axis=1, dtype=np.int64)
            need = share * (size[of] + size[h]) - 1e-6
            open_ = np.flatnonzero((both + np.minimum(count[of], count[h]) >= need) & ((both < need + 2e-6) | every))
            if len(open_) and count[h]:
                at = of[open_]
                has[rest[begin[h] : begin[h + 1]]] = True
                upto = np.concatenate(([0], np.cumsum(count[at])))
                held = has[rest[np.repeat(begin[at] - upto[:-1], count[at]) + np.arange(upto[-1])]]
                both[open_] += np.diff(np.concatenate(([0], np.cumsum(held)))[upto])
                has[rest[begin[h] : begin[h + 1]]] = False
            jaccard = both / (size[h] + size[of] - both)
            ok = jaccard >= threshold - 1e-12
            of, jaccard = of[ok], jaccard[ok]
            links[h] += copies[of].sum()
            links[of] += copies[h]
            if every:
                a_out.append(ids[of])
                b_out.append(np.full(len(of), ids[h], np.int64))
                j_out.append(jaccard)
            elif len(of):
                for g in of[np.unique(label[of], return_index=True)[1]].tolist():
                    join(g, h)
        return _found(a_out, b_out, j_out, ids, links)

    return run


#: Fewer rows (16 bytes each) than this are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def _few(rows: DataFrame) -> DataFrame:
    """``rows``, written before, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _set_of(text: Column) -> Column:
    """The set's name; null where the text has no word."""
    return F.when(text.rlike(r"[\p{L}\p{M}\p{N}]"), F.xxhash64(text))


def similar_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, every: bool = True, copies: DataFrame | None = None) -> DataFrame:
    """Pairs of different texts, by their hashes ``a < b``, with their ``jaccard``; written to the shared folder.

    Without ``every``, crowds give as many pairs as connect the same sets, some without a ``jaccard``, and rows without
    ``b`` hold parts of a set's ``links``: the number of similar sets, each as often as ``copies`` (``set``, ``copies``) says,
    or once.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and at most at 1")
    spark = docs.sparkSession
    texts = docs.select(_set_of(F.col("text")).alias("set"), "text").where("set IS NOT NULL")
    # characters bound the number of words and so of n-grams; a word has two with its space at least
    count = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 5
    ranges = 1 << max(0, -(-count // RANGE) - 1).bit_length()
    posted = texts.mapInArrow(_postings(n, ranges), "range long, lot long, blob binary")
    shared = posted.groupBy("range").applyInArrow(_shared(ranges), "lot long, range long, blob binary")
    with arrow_batches(spark, BATCH):
        lots = written(shared.groupBy("lot").applyInArrow(_ordered(threshold, ranges), "lot long, set long, size int, n_rare int, grams binary, bucket long"), "ngram-sets")
    # equal texts of several lots: the row of the first stays
    several = written(lots.groupBy("set").agg(F.min("lot").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("set", "first"), "ngram-several")
    sets = lots.join(_few(several), "set", "left").where("first IS NULL OR first = lot").select("set", "size", "n_rare", "grams", "bucket")

    buckets = written(sets.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MANY), "ngram-buckets")
    lot = F.pmod(F.xxhash64("set"), F.ceil(F.col("n") / CROWD)).alias("part")
    crowds = sets.join(_few(buckets), "bucket").select("set", "size", "grams", "bucket", lot).groupBy("bucket", "part").applyInArrow(_crowds(threshold), "set long, crowd long")
    with arrow_batches(spark, BATCH):
        crowds = written(crowds, "ngram-crowds")
    sets = sets.join(_few(crowds), "set", "left").withColumn("crowded", F.col("crowd").isNotNull()).withColumn("name", F.coalesce("crowd", "set"))

    keys = sets.select("name", "crowded", "size", "n_rare", "grams").mapInArrow(_keys(threshold, max(1, ranges // 4)), "range long, blob binary")
    found = keys.groupBy("range").applyInArrow(_candidates(threshold), "a long, b long, crowded boolean")
    with arrow_batches(spark, BATCH):
        candidates = written(found.groupBy("b", "crowded").agg(F.collect_set("a").alias("partners")), "ngram-candidates")
    weighed = sets.join(_few(copies), "set", "left") if copies is not None else sets.withColumn("copies", F.lit(1))
    weighed = weighed.select("name", "set", "size", "grams", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))

    lists = candidates.where("NOT crowded").select("b", "partners", F.array_min("partners").alias("home"))
    members = lists.select("home", F.explode(F.concat("partners", F.array("b"))).alias("set")).distinct()
    blocks = members.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    lists = lists.join(blocks, "home")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    whole = lists.where("blocks = 1").select("home", F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("b").alias("set"), "partners")
    cut = lists.where("blocks > 1").select("home", "blocks", "b", F.explode("partners").alias("a")).select("home", block("a").alias("x"), block("b").alias("y"), "a", "b")
    cut = cut.groupBy("home", "x", "y", F.col("b").alias("set")).agg(F.collect_list("a").alias("partners"))
    later = whole.unionByName(cut)
    earlier = later.select("home", "x", "y", F.explode("partners").alias("set")).distinct().withColumn("partners", F.array().cast("array<bigint>"))
    wanted = later.unionByName(earlier).groupBy("home", "x", "y", "set").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    verified = wanted.join(weighed.drop("name"), "set").groupBy("home", "x", "y").applyInArrow(_verify(threshold), _VERIFIED)

    sizes = written(crowds.groupBy("crowd").agg(F.count(F.lit(1)).alias("n")), "ngram-crowd-sizes")
    if sizes.limit(1).count():
        # of two, the larger is at home; the others come to it in lots of about CROWD sets
        near = candidates.where("crowded").select("b", F.explode("partners").alias("a"))
        for c in ("a", "b"):
            near = near.join(_few(sizes.select(F.col("crowd").alias(c), F.col("n").alias(f"n_{c}"))), c, "left").fillna(1, [f"n_{c}"])
        larger = F.col("n_a") >= F.col("n_b")
        near = near.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("home"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("name"), F.least("n_a", "n_b").alias("n"))
        parts = near.groupBy("home").agg(F.ceil(F.sum("n") / CROWD).alias("parts"))
        guests = near.join(parts, "home").select("home", F.pmod(F.xxhash64("name"), "parts").alias("part"), "name", F.lit(True).alias("guest"))
        hosts = guests.select("home", "part").distinct().unionByName(sizes.select(F.col("crowd").alias("home"), F.lit(-1).cast("long").alias("part")))
        blocks = guests.unionByName(hosts.select("home", "part", F.col("home").alias("name"), F.lit(False).alias("guest")))
        verified = verified.unionByName(weighed.join(blocks, "name").groupBy("home", "part").applyInArrow(_verify_crowd(threshold, every), _VERIFIED))
    with arrow_batches(spark, BATCH):
        pairs = written(verified.where("b IS NOT NULL") if every else verified, "ngram-pairs")
    discard(lots, several, buckets, crowds, sizes, candidates)
    return pairs


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_a < doc_b`` and ``jaccard`` of all pairs of documents that reach the threshold."""
    pairs = similar_sets(docs, n, threshold).select("a", "b", "jaccard")
    named = docs.select("doc_id", _set_of(F.col("text")).alias("set")).where("set IS NOT NULL AND doc_id IS NOT NULL").distinct()
    left, right = named.select(F.col("doc_id").alias("p"), F.col("set").alias("a")), named.select(F.col("doc_id").alias("q"), F.col("set").alias("b"))
    different = pairs.join(left, "a").join(right, "b").where("p <> q").select(F.least("p", "q").alias("doc_a"), F.greatest("p", "q").alias("doc_b"), "jaccard")
    equal = left.join(right.withColumnRenamed("b", "a"), "a").where("p < q").select(F.col("p").alias("doc_a"), F.col("q").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    every = different.unionByName(equal)
    if not named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return every
    # a doc_id that stands with several texts can give a pair several times
    return every.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def connected(pairs: DataFrame) -> DataFrame:
    """``set`` and ``group``, the least set that pairs connect it with; each round is written to the shared folder.

    A round takes the least group among neighbours and then the group of that group, so that long chains need few rounds.
    """
    ways = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    last = now = written(ways.groupBy(F.col("a").alias("set")).agg(F.least(F.min("b"), F.first("a")).alias("group")), "groups")
    while True:
        near = ways.join(now.select(F.col("set").alias("b"), "group"), "b").groupBy(F.col("a").alias("set")).agg(F.min("group").alias("near"))
        least = now.join(near, "set").select("set", F.col("group").alias("was"), F.least("group", "near").alias("group"))
        jump = now.select(F.col("set").alias("group"), F.col("group").alias("further"))
        after = written(least.join(jump, "group", "left").select("set", "was", F.least("group", "further").alias("group")), "groups")
        discard(last)
        last, now = after, after.select("set", "group")
        if not after.where("was <> group").limit(1).count():
            now.written_to = after.written_to
            return now


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Each row's ``doc_id``, ``class_id`` and ``links``: a class is what similar pairs connect, links are the other rows similar to it."""
    named = docs.select("doc_id", _set_of(F.col("text")).alias("set"))
    count = F.count(F.lit(1)).alias("copies")
    copies = written(named.where("set IS NOT NULL").groupBy("set").agg(count).where("copies > 1"), "ngram-copies")
    found = similar_sets(docs, n, threshold, every=False, copies=copies)
    groups = connected(found.where("b IS NOT NULL"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("others"))
    # a set with links has a group
    of = written(groups.join(links, "set").join(copies, "set", "full").select("set", F.coalesce("group", "set").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("links")), "ngram-classes")
    discard(found, groups, copies)
    return named.join(_few(of), "set", "left").select("doc_id", F.coalesce("class_id", "set").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group of documents that similar pairs connect."""
    at = {c.lower(): c for c in docs.columns}
    pairs = similar_sets(docs, n, threshold, every=False)
    groups = connected(pairs.where("b IS NOT NULL"))
    # in a struct, the names of the input's columns are out of the way
    every = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[at["doc_id"]].alias("doc"), _set_of(docs[at["text"]]).alias("set"))
    rows = every.where("set IS NOT NULL").groupBy("doc", "set").agg(F.count(F.lit(1)).alias("n")).join(groups, "set", "left").select("doc", "set", "n", F.coalesce("group", "set").alias("group"))
    first = F.min_by(F.struct("doc", "set"), F.struct(F.col("doc").isNull(), "doc", "set")).alias("stays")
    stays = rows.groupBy("group").agg(first)
    marked = rows.join(stays, "group").select("doc", "set", "n", (F.col("doc").eqNullSafe(F.col("stays.doc")) & (F.col("set") == F.col("stays.set"))).alias("stays"))
    marked = written(marked.where("NOT stays OR n > 1"), "ngram-removed")
    discard(pairs, groups)

    def matching(of: DataFrame, how: str, few: DataFrame) -> DataFrame:
        few = _few(few.select(F.col("doc").alias("d"), F.col("set").alias("s")))
        return of.join(few, (of["set"] == F.col("s")) & of["doc"].eqNullSafe(F.col("d")), how)

    again = marked.where("stays")
    kept = matching(every, "left_anti", marked.where("NOT stays"))
    if again.limit(1).count():
        single = matching(kept, "left_semi", again).groupBy("doc", "set").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = matching(kept, "left_anti", again).select("row").unionByName(single.select("row"))
    return kept.select("row.*")
