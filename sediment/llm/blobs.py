"""Packed arrays of numbers: byte planes, each stored as it is smallest, so that high bytes cost next to nothing."""

from __future__ import annotations

import ctypes
import functools
import struct

import numpy as np
import pyarrow as pa

_KINDS = [np.dtype(x) for x in ("<u1", "<u4", "<u8", "<i4", "<i8")]
_HEAD, _LENGTH = struct.Struct("<BQ"), struct.Struct("<I")
_ZEROS, _PLAIN, _PRESSED = b"\0", b"\1", b"\2"


@functools.lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1, write_content_size=False), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    press, out = _zstd()[0].compress, []
    for a in arrays:
        out.append(_HEAD.pack(_KINDS.index(a.dtype), len(a)))
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else ()
        for plane in planes:
            if not plane.any():
                out.append(_ZEROS)
                continue
            plain = plane.tobytes()
            # a frame has some 15 bytes of its own
            pressed = press(plain) if len(plain) > 40 else plain
            out += [_PRESSED, _LENGTH.pack(len(pressed)), pressed] if len(pressed) + 4 < len(plain) else [_PLAIN, plain]
    return b"".join(out)


def unpack(blob) -> list[np.ndarray]:
    data, at, out = memoryview(blob), 0, []
    while at < len(data):
        kind, n = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        kind = _KINDS[kind]
        planes = np.zeros((n, kind.itemsize), np.uint8)
        for k in range(kind.itemsize if n else 0):
            how = data[at]
            at += 1
            if how == _PLAIN[0]:
                planes[:, k] = np.frombuffer(data, np.uint8, n, at)
                at += n
            elif how == _PRESSED[0]:
                (size,) = _LENGTH.unpack_from(data, at)
                at += _LENGTH.size
                planes[:, k] = np.frombuffer(_zstd()[1].decompress(data[at : at + size], max_output_size=n), np.uint8)
                at += size
        out.append(planes.reshape(-1).view(kind) if n else np.zeros(0, kind))
    return out


@functools.lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except AttributeError:  # another C library
        return lambda _: 0


def release() -> None:
    """Give freed memory back: a worker lives on after its task, beside the next stage's memory."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def releasing(f):
    """``f``, with ``release`` after each call."""

    @functools.wraps(f)
    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        release()
        return out

    return run
