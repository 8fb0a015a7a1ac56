"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items go into one generalised suffix automaton. Training words are streamed through it; the
automaton's state and matching length after each word give the longest run of words, ending there, that some item has.
A run is removed when it is long (``LENGTH`` words) or covers much of an item (``COVERAGE`` of the shortest item that has
it, from ``FLOOR`` words on). A document of which more than ``DROP`` of the words were removed goes as a whole.

The documents are scanned once, in Arrow batches, and never shuffled. The items' lengths and the limits say how many
words the shortest removable run has; a text with such a run has as many successive word pairs of the items, less one.
numpy looks for those in all texts, and the automaton reads every word of the texts that have them. For the longest match
of ``report``, the automaton reads of all texts the stretches of successive pairs of the items, as no match of two words
or more goes beyond one. That changes no result, only where Python loops run.

The automaton grows with the benchmark, not with the corpus. More than ``PASS_WORDS`` benchmark words are put into several
automata. Each searches the original text, the best run of all is taken at each word, and the text is cut once, so the
lots' number and bounds change no result; a worker holds all of them.

Defined results:

* words are compared in lower case and without punctuation (see ``text``); benchmark items without words match nothing;
* passages of items without an identifier go as well; ``items`` names none for them;
* overlapping and adjoining runs are one span; a span goes from its first word's first to its last word's last character,
  and one space or line end beside it goes too;
* null texts stay null, empty ones empty, both without spans; very long texts are read whole;
* repeated rows give equal rows each; empty tables on either side leave the documents as they are;
* extra columns are kept by ``remove_spans``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import release
from .tables import with_text
from .text import RUN, compact, runs, strings, word_list, words_of

LENGTH = 13
COVERAGE = 0.8
FLOOR = 5
DROP = 0.5
PASS_WORDS = 4_000_000
SLICE = 500  #: texts that are cut into words at once


class Automaton:
    """A generalised suffix automaton over items given as lists of word numbers."""

    def __init__(self, items: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.item, self.shortest = [-1], [0], [-1], [1 << 60]
        for k, words in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, w)
                self._mark(last, k, len(words))
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if (p := self.link[v]) > 0:
                self._mark(p, self.item[v], self.shortest[v])

    def _mark(self, v: int, item: int, length: int) -> None:
        if (length, item) < (self.shortest[v], self.item[v]):
            self.item[v], self.shortest[v] = item, length

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.item.append(-1)
        self.shortest.append(1 << 60)
        return len(self.length) - 1

    def _split(self, p: int, w: int) -> int:
        """The state for the word ``w`` after ``p`` with exactly one word more."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, w)
        return new

    def matches(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word, the state and the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        for w in words:
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                n += 1
            else:
                n = 0
            yield v, n


class Limits(NamedTuple):
    length: int = LENGTH
    coverage: float = COVERAGE
    floor: int = FLOOR
    drop: float = DROP


#: of a run: its length, the length of the shortest item that has it, below zero, and that item
End = tuple[int, int, int | None]
NO_END: End = (0, 0, None)


class Index:
    """The automaton, the numbers of its words, and the hashed pairs for the look over all texts."""

    PAIR_BITS = 24

    def __init__(self, items: list[tuple[int, list[str]]], limits: Limits):
        self.limits = limits
        self.ids = [i for i, _ in items]
        vocabulary = sorted({w for _, ws in items for w in ws})
        self.number = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.words = pa.array(vocabulary, pa.string())
        coded = [[self.number[w] for w in ws] for _, ws in items]
        self.automaton = Automaton(coded)
        #: no shorter match can be removed, whatever item it is from
        self.least = max(2, limits.floor, min(limits.length, min((int(np.ceil(limits.coverage * len(c))) for c in coded), default=limits.length)))
        self.pairs = np.zeros(1 << self.PAIR_BITS, bool)
        for c in coded:
            a = np.array(c, np.uint32)
            self.pairs[self.hashed(a[:-1], a[1:])] = True

        #: of each state, the longest suffix state that is long enough by itself, or the root
        self.suffix = [0] * len(self.automaton.length)
        for v in sorted(range(1, len(self.suffix)), key=self.automaton.length.__getitem__):
            self.suffix[v] = v if self._enough(v, self.automaton.length[v]) else self.suffix[self.automaton.link[v]]

    def _enough(self, v: int, n: int) -> bool:
        lim = self.limits
        return n >= lim.floor and (n >= lim.length or n >= lim.coverage * self.automaton.shortest[v])

    def hashed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)) >> np.uint32(32 - self.PAIR_BITS)

    def ends(self, words: list[int]) -> list[End]:
        """Of each word, the longest run to remove that ends there."""
        a, out = self.automaton, []
        for v, n in a.matches(words):
            if not self._enough(v, n):
                # a shorter run that ends here may cover more of a shorter item
                v = self.suffix[a.link[v]] if v else 0
                n = a.length[v]
            out.append((n, -a.shortest[v], self.ids[a.item[v]]) if n else NO_END)
        return out

    def spans(self, words: list[int]) -> tuple[list[tuple[int, int]], int, set[int]]:
        """Word spans to remove, the longest match, and the items that they came from."""
        spans, found = spans_of(self.ends(words))
        return spans, max((n for _, n in self.automaton.matches(words)), default=0), found

    def _pairs_at(self, flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where successive words of a text are a pair of the items, by their hashes."""
        if len(flat) < 2:
            return np.zeros(0, np.int64)
        hit = (flat[:-1] > 0) & (flat[1:] > 0)
        inner = offs[1:-1]
        hit[inner[(inner > 0) & (inner < len(flat))] - 1] = False
        at = np.flatnonzero(hit)
        pairs = flat.view(np.uint32)
        return at[self.pairs[self.hashed(pairs[at], pairs[at + 1])]]

    def _candidates(self, at: np.ndarray, offs: np.ndarray) -> list[int]:
        """Texts with ``least - 1`` successive pairs, whose places are ``at``."""
        need = self.least - 1
        # places that are followed by need - 1 more, without a gap
        starts = at[: len(at) - need + 1][at[need - 1 :] - at[: len(at) - need + 1] == need - 1] if len(at) >= need else at[:0]
        return np.unique(np.searchsorted(offs, starts, "right") - 1).tolist()

    def _longest(self, flat: np.ndarray, offs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The longest match of each text, which is one word or lies within successive pairs, whose places are ``at``."""
        known = np.concatenate(([0], np.cumsum(flat > 0)))
        out = (known[offs[1:]] > known[offs[:-1]]).astype(np.int32)
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        begin, size = at[first], np.diff(first, append=len(at)) + 1
        text = np.searchsorted(offs, begin, "right") - 1
        best = out.tolist()
        for k in np.lexsort((-size, text)).tolist():
            t, b, n = int(text[k]), int(begin[k]), int(size[k])
            if n > best[t]:
                best[t] = max(best[t], max(m for _, m in self.automaton.matches(flat[b : b + n].tolist())))
        return np.array(best, np.int32)


def spans_of(ends: list[End]) -> tuple[list[tuple[int, int]], set[int]]:
    """The runs that end at each word as spans that neither overlap nor adjoin, and the runs' items."""
    out: list[tuple[int, int]] = []
    found = set()
    for i, (n, _, item) in enumerate(ends):
        if n:
            found.add(item)
            start = i - n + 1
            while out and out[-1][1] >= start:
                start = min(start, out.pop()[0])
            out.append((start, i + 1))
    return out, found


def search(indexes: list[Index], texts: pa.Array, with_longest: bool = False) -> tuple[np.ndarray, np.ndarray, dict[int, tuple]]:
    """Words and, on demand, the longest match of each text; for those with any to remove, spans of words and characters, items."""
    distinct, at, offsets = runs(texts)
    longest = np.zeros(len(texts), np.int32)
    if not len(at):
        return np.diff(offsets), longest, {}
    word = words_of(distinct)
    no_word = pa.compute.equal(word, "").to_numpy(zero_copy_only=False)
    is_word = ~no_word[at]
    _, offs = compact(at, is_word, offsets)
    best: dict[int, list[End]] = {}
    for index in indexes:
        # 0: a word of no item; -1: no word at all
        number = pa.compute.index_in(word, index.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        flat = np.where(no_word, -1, number).astype(np.int32)[at][is_word]
        pairs = index._pairs_at(flat, offs)
        if with_longest:
            longest = np.maximum(longest, index._longest(flat, offs, pairs))
        for t in index._candidates(pairs, offs):
            ends = index.ends(flat[offs[t] : offs[t + 1]].tolist())
            # as in one automaton: the longest run, of that the shortest item, of those the first
            best[t] = [x if x[:2] >= y[:2] else y for x, y in zip(best[t], ends, strict=True)] if t in best else ends
    found: dict[int, tuple] = {}
    for t, ends in sorted(best.items()):
        spans, items = spans_of(ends)
        where: list[tuple[int, int]] = []
        if spans:
            mine = slice(offsets[t], offsets[t + 1])
            # leading and trailing white space leaves empty pieces, which are no runs
            run = np.array([x != "" for x in distinct.take(pa.array(at[mine])).to_pylist()], bool)
            places = [m.span() for m in RUN.finditer(texts[t].as_py())]
            where = [p for p, w in zip(places, is_word[mine][run].tolist(), strict=True) if w]
        found[t] = (spans, [(where[a][0], where[b - 1][1]) for a, b in spans], items)
    return np.diff(offs), longest, found


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        if a > at and text[a - 1] in " \n":
            a -= 1
        elif b < len(text) and text[b] in " \n":
            b += 1
        out.append(text[at:max(at, a)])
        at = b
    return "".join(out) + text[at:]


def read_items(benchmark: DataFrame) -> list[list[tuple[int, list[str]]]]:
    """The items' words in lots of at most ``PASS_WORDS`` words, an item at least."""
    lots: list[list[tuple[int, list[str]]]] = []
    room = 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator(prefetchPartitions=True):
        if not (ws := word_list(r["text"])):
            continue
        if len(ws) > room:
            lots.append([])
            room = PASS_WORDS
        lots[-1].append((r["item_id"], ws))
        room -= len(ws)
    return lots


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that the words of many long texts aren't in memory at once."""
    for b in batches:
        for k in range(0, max(1, b.num_rows), SLICE):
            yield b.slice(k, SLICE)
        release()


def _broadcast(docs: DataFrame, benchmark: DataFrame, limits: Limits) -> list:
    return [docs.sparkSession.sparkContext.broadcast(Index(lot, limits)) for lot in read_items(benchmark)]


def remove_spans(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``docs`` without the spans, and without the documents that were mostly spans."""
    at = {c.lower(): c for c in docs.columns}["text"]
    shared = _broadcast(docs, benchmark, limits)

    def cut(batches):
        for b in _slices(batches):
            n_words, _, found = search([s.value for s in shared], strings(b.column(at)))
            keep = np.ones(b.num_rows, bool)
            if found:
                text = b.column(at).to_pylist()
                for t, (spans, chars, _) in found.items():
                    keep[t] = sum(j - i for i, j in spans) <= limits.drop * n_words[t]
                    text[t] = _cut(text[t], chars)
                b = b.set_column(b.schema.get_field_index(at), b.schema.field(at), pa.array(text, b.schema.field(at).type))
            yield b.filter(pa.array(keep))

    return with_text(docs.mapInArrow(cut, docs.schema), F.col(at)) if shared else docs


def report(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each document: the text that stays (null where the whole document goes), how many words and spans
    were removed, the longest match, the items found, and ``keep``."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_words long, n_spans int, n_removed long, longest int, items array<bigint>, keep boolean"
    shared = _broadcast(docs, benchmark, limits)

    def look(batches):
        for b in _slices(batches):
            n = b.num_rows
            original = strings(b.column(1)) if n else pa.array([], pa.string())
            text = b.column(1)
            words, longest, found = search([s.value for s in shared], original, with_longest=True)
            n_spans, removed = np.zeros(n, np.int32), np.zeros(n, np.int64)
            items: list[list[int]] = [[] for _ in range(n)]
            if found:
                values = text.to_pylist()
                for t, (spans, chars, whose) in found.items():
                    n_spans[t], removed[t] = len(spans), sum(j - i for i, j in spans)
                    items[t] = sorted(i for i in whose if i is not None)
                    values[t] = _cut(values[t], chars)
                text = pa.array(values, pa.string())
            keep = removed <= limits.drop * words
            text = text.cast(pa.string()).take(pa.array(np.arange(n), mask=~keep))
            yield pa.record_batch([b.column(0), text, pa.array(words, pa.int64()), pa.array(n_spans), pa.array(removed), pa.array(longest), pa.array(items, pa.list_(pa.int64())), pa.array(keep)], names=["doc_id", "text", "n_words", "n_spans", "n_removed", "longest", "items", "keep"])

    return docs.select("doc_id", "text").mapInArrow(look, schema)
