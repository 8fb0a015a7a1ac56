"""Words of texts, as Arrow and numpy see them: no Python loop runs over words.

A word is a run of characters other than white space, in lower case and without anything but letters, marks and digits;
a run with none of those is no word.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
RUN = re.compile(r"\S+")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters near ones."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string array without nulls; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct runs, each run's place among them, and where each text begins (one more at the end)."""
    cut = pc.utf8_split_whitespace(texts)
    coded = cut.flatten().dictionary_encode()
    offsets = cut.offsets.to_numpy().astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[:1].sum()


def words_of(distinct: pa.Array) -> pa.Array:
    """The word of each run, empty where it has none."""
    return pc.replace_substring_regex(pc.utf8_lower(distinct), _NOT_WORD, "")


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes that are the same in every process; 0 for the empty word."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.where(pc.equal(words, "").to_numpy(zero_copy_only=False), np.uint64(0), pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) | np.uint64(1))


def compact(values: np.ndarray, keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept values and where each text now begins."""
    before = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], before[offsets]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes, and where each text begins (one more at the end)."""
    distinct, at, offsets = runs(texts)
    if not len(at):
        return np.zeros(0, np.uint64), offsets
    flat = hashes(words_of(distinct))[at]
    return compact(flat, flat != 0, offsets)


def word_list(text: str) -> list[str]:
    """The same words of one text, for tests and small tables."""
    w = words_of(pa.array(RUN.findall(text), pa.string()))
    return [x for x in w.to_pylist() if x]


def ngrams(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams and the text of each; a text of fewer than n words has one gram of all its words."""
    length = np.diff(offsets)
    tops = [mix(words ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) for k in range(n)]
    grams, owners = [], []
    if (full := length >= n).any():
        s = tops[0][: len(words) - n + 1].copy()
        for k in range(1, n):
            s += tops[k][k : len(words) - n + 1 + k]
        text = np.repeat(np.arange(len(length)), length)[: len(s)]
        inside = np.arange(len(s)) + n <= offsets[1:][text]
        grams.append(mix(s[inside]))
        owners.append(text[inside])
    for m in range(1, n):
        if len(short := np.flatnonzero(length == m)):
            grams.append(mix(sum((tops[k][offsets[short] + k] for k in range(m)), np.zeros(len(short), np.uint64)) + np.uint64(m)))
            owners.append(short)
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(grams), np.concatenate(owners)
