"""A public byte-level tokenizer from a file of ranks, loaded once in each worker."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this vocabulary cuts a text before it merges bytes; possessive, so that long runs need no way back.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """Of each token, how many bytes of the text it stands for."""
    t = tokenizer(path)
    return np.array([len(b) for b in t.decode_tokens_bytes(range(t.n_vocab))], np.int64)


def lengths(texts: pa.Array, path: str = TOKENIZER) -> np.ndarray:
    """Tokens of each text; texts are strings without nulls."""
    encode = tokenizer(path).encode_ordinary
    return np.fromiter((len(encode(x.as_py())) for x in texts), np.int64, len(texts))
