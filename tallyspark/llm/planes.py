"""Number arrays as compressed byte planes: what is small or alike in its high bytes takes next to no room, in files, shuffles and rows in memory."""

from __future__ import annotations

import numpy as np
import zstandard

_LEVEL = 1


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=_LEVEL).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(values: np.ndarray, kind: str = "<u4") -> bytes:
    """The values' first bytes, then their second bytes, and so on."""
    values = np.ascontiguousarray(values, kind)
    return squeeze(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def unpack(data: bytes, kind: str = "<u4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(expand(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_signed(values: np.ndarray) -> bytes:
    """Small numbers of either sign have high bytes of zero."""
    values = np.ascontiguousarray(values, np.int64)
    return pack(((values << 1) ^ (values >> 63)).view(np.uint64), "<u8")


def unpack_signed(data: bytes) -> np.ndarray:
    values = unpack(data, "<u8")
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)
