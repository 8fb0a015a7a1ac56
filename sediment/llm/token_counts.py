"""Token counts by a trie-shared dynamic program over distinct pre-tokens.

A text's pre-tokens are its runs of characters other than white space, each led by the word mark. Arrow finds the
distinct ones of a batch; they are visited in the order of a trie, that is sorted, with the path from the root as a
stack. The unigram forward score of a prefix, the best sum of piece scores over all segmentations, and the number of
pieces it takes, are computed once for all pre-tokens that share it; at a pre-token's end its count is stored. The
counts are then gathered and summed by text in numpy. The plan is one scan without a shuffle.

The vocabulary is a public one whose pieces are ordered by merge rank; the unigram score of a piece is the logarithm of
a Zipf probability of that rank. It is read from ``vocabulary`` once in each worker.

Defined results:

* characters that no piece covers count as their UTF-8 bytes, each with the score of the last rank;
* of equal scores, the segmentation of fewer pieces counts; text is taken as it is, without Unicode normalisation;
* null, empty and blank texts have 0 pre-tokens and 0 tokens; very long texts and pre-tokens are read whole;
* repeated rows each give a row; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import runs, strings

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


class Pieces:
    def __init__(self, ranked: list[str]):
        total = sum(1 / (k + 2) for k in range(len(ranked)))
        self.score = {p: -math.log((k + 2) * total) for k, p in reversed([*enumerate(ranked)])}
        self.longest = max(map(len, ranked), default=1)
        self.byte_score = -math.log((len(ranked) + 2) * total)

    def counts(self, ordered: list[str]) -> list[int]:
        """Pieces of each of the sorted pre-tokens."""
        score, longest, by_byte = self.score.get, self.longest, self.byte_score
        best, count, out, last = [0.0], [0], [], ""
        for t in ordered:
            shared = len(os.path.commonprefix((last, t)))
            del best[shared + 1 :], count[shared + 1 :]
            for d in range(shared + 1, len(t) + 1):
                top, n = -math.inf, 0
                for k in range(max(0, d - longest), d):
                    s = score(t[k:d])
                    if s is not None:
                        s += best[k]
                        if s > top or (s == top and count[k] < n - 1):
                            top, n = s, count[k] + 1
                if n == 0 or score(t[d - 1]) is None:
                    size = len(t[d - 1].encode("utf-8", "surrogatepass"))
                    s = best[d - 1] + size * by_byte
                    if s > top or (s == top and count[d - 1] + size < n):
                        top, n = s, count[d - 1] + size
                best.append(top)
                count.append(n)
            out.append(count[-1])
            last = t
        return out


@functools.lru_cache(maxsize=2)
def load(vocabulary: str) -> Pieces:
    """The ordinary pieces of a sentencepiece model, by rank."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    return Pieces([m.id_to_piece(k) for k in range(m.get_piece_size()) if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k) or m.is_unused(k))])


def batch_counts(texts: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens and tokens of each text."""
    distinct, at, offsets = runs(texts)
    named = distinct.to_pylist()
    order = sorted((k for k, t in enumerate(named) if t), key=named.__getitem__)
    each = np.zeros(len(named), np.int64)
    each[order] = pieces.counts([MARK + named[k] for k in order])
    flat = each[at] if len(at) else np.zeros(0, np.int64)
    sums = lambda v: np.concatenate(([0], np.cumsum(v)))[offsets]
    return np.diff(sums(flat > 0)), np.diff(sums(flat))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``n_pretokens`` and ``n_tokens``: one row for each input row."""

    def count(batches):
        pieces = load(vocabulary)
        for b in batches:
            pre, tokens = batch_counts(strings(b.column(1)), pieces)
            yield pa.record_batch([b.column(0), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long")
