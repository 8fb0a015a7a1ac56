"""Chat formatting with masks aligned by offsets.

The turns of a conversation are rendered to one text and encoded once, with the offsets of every token: tokens of a
byte-level vocabulary follow one another without a gap, so that their lengths in bytes give where each begins and ends.
The spans of the turns to learn from are sorted, and each token's span is intersected with them by binary search, so that
the mask doesn't depend on where the tokenizer happens to cut. Conversations are gathered by one shuffle.

Defined results:

* turns are ordered by ``turn``, ties and repeated rows by role and text, nulls first; all of them are rendered;
* a null role is rendered as ``unknown``, a null text as an empty one; a row with a null ``conv_id`` is a conversation of
  its own, equal ones together, so that no task gets all of them;
* a token that lies partly in a target span is a target; the end marker after an assistant's text is, the role line isn't;
* markers inside a text are ordinary text and open no span; very long conversations are encoded whole;
* an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKENIZER, token_bytes, tokenizer

TARGETS = ("assistant",)
START, END = "<|im_start|>", "<|im_end|>"


def render(turns: list[tuple[str | None, str | None]], targets: tuple[str, ...] = TARGETS) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the spans to learn from, in bytes, in their order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{START}{'unknown' if role is None else role}\n"
        body = (text or "") + END
        parts += [head, body, "\n"]
        begin = at + len(head.encode())
        at = begin + len(body.encode())
        if role in targets:
            spans.append((begin, at))
        at += 1
    return "".join(parts), spans


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens, given as rows (start, end), intersect one of the sorted, disjoint spans."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool)
    starts, ends = np.array(spans, np.int64).T
    k = np.searchsorted(ends, offsets[:, 0], "right")  # the first span that ends after the token's start
    return (k < len(ends)) & (starts[np.minimum(k, len(ends) - 1)] < offsets[:, 1])


def format_chats(conversations: DataFrame, vocabulary: str = TOKENIZER, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """``conv_id``, its token ids, a 0/1 loss mask of the same length, and the numbers of turns, tokens and targets."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).alias("alone")
    turns = conversations.groupBy("conv_id", alone).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    turns = turns.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def encode(batches):
        encode_one, size = tokenizer(vocabulary).encode_ordinary, token_bytes(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids, masks, n_turns = [], [], []
                for roles, texts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    text, spans = render(list(zip(roles, texts, strict=True)), targets)
                    ids.append(np.array(encode_one(text), np.int32))
                    ends = np.cumsum(size[ids[-1]])
                    masks.append(mask(np.column_stack((ends - size[ids[-1]], ends)), spans).astype(np.int8))
                    n_turns.append(len(roles))
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (ids, masks)]
                yield pa.record_batch(
                    [part.column(0), *lists, pa.array(n_turns, pa.int32()), pa.array(list(map(len, ids)), pa.int32()), pa.array([int(m.sum()) for m in masks], pa.int32())],
                    names=["conv_id", "input_ids", "loss_mask", "n_turns", "n_tokens", "n_targets"],
                )

    return turns.mapInArrow(encode, f"conv_id {kind}, input_ids array<int>, loss_mask array<tinyint>, n_turns int, n_tokens int, n_targets int")
