"""Hashes and checksums that Spark lacks, as Arrow-batched functions of strings or binaries.

Rolling hashes advance all texts of a batch by one byte at a time, in arrays. Nulls stay null.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: One step of each rolling hash: state and byte, as unsigned 32-bit arrays.
_u = np.uint32
STEPS = {
    "js": lambda h, c: h ^ ((h << _u(5)) + c + (h >> _u(2))),
    "elf": lambda h, c: _elf((h << _u(4)) + c),
    "sdbm": lambda h, c: c + (h << _u(6)) + (h << _u(16)) - h,
    "dek": lambda h, c: (h << _u(5)) ^ (h >> _u(27)) ^ c,
    "djb": lambda h, c: (h << _u(5)) + h + c,
    "fnv": lambda h, c: (h * _u(0x811C9DC5)) ^ c,
    "x31": lambda h, c: _u(31) * h + c,
}


def _elf(h):
    return (h ^ ((h & _u(0xF0000000)) >> _u(23))) & _u(0x0FFFFFFF)


def _raw(x) -> bytes:
    return x.encode("utf-8", "surrogatepass") if isinstance(x, str) else bytes(x)


def roll(texts: list[bytes], kind: str, seed: int) -> np.ndarray:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-size, kind="stable")
    flat, first = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
    state = np.full(len(texts), seed, np.uint32)
    step, longest = STEPS[kind], int(size.max(initial=0))
    live = np.searchsorted(-size[order], -np.arange(longest), side="left")  # texts longer than k
    for k in range(longest):
        own = order[: live[k]]
        state[own] = step(state[own], flat[first[own] + k].astype(np.uint32))
    return state


def _rotated(x: np.ndarray, k: int) -> np.ndarray:
    return (x << _u(k)) | (x >> _u(32 - k))


def _mixed(k: np.ndarray) -> np.ndarray:
    return _rotated(k * _u(0xCC9E2D51), 15) * _u(0x1B873593)


def murmur3_32(texts: list[bytes], seed: int = 0) -> np.ndarray:
    """MurmurHash3, x86, 32 bits, of all texts; they advance together by words of four bytes."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = -(-size // 4)  # texts filled up with zeros to whole words
    flat = np.frombuffer(b"".join(t + bytes(-len(t) % 4) for t in texts), "<u4")
    first, order = np.cumsum(whole) - whole, np.argsort(-size, kind="stable")
    h = np.full(len(texts), seed, np.uint32)
    longest = int(size.max(initial=0)) // 4
    live = np.searchsorted(-(size[order] // 4), -np.arange(longest), side="left")
    for k in range(longest):
        own = order[: live[k]]
        h[own] = _rotated(h[own] ^ _mixed(flat[first[own] + k]), 13) * _u(5) + _u(0xE6546B64)
    rest = np.flatnonzero(size % 4)
    h[rest] ^= _mixed(flat[first[rest] + whole[rest] - 1])
    h ^= size.astype(np.uint32)
    h = (h ^ (h >> _u(16))) * _u(0x85EBCA6B)
    h = (h ^ (h >> _u(13))) * _u(0xC2B2AE35)
    return h ^ (h >> _u(16))


@lru_cache(1)
def _castagnoli() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> _u(1)) ^ (out & _u(1)) * _u(0x82F63B78)
    return out


STEPS["crc32c"] = lambda h, c: (h >> _u(8)) ^ _castagnoli()[(h ^ c) & _u(255)]


def adler32_of(texts: list[bytes]) -> np.ndarray:
    """Adler-32 of all texts, from sums of bytes and of bytes times their distance to the end."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    ends = np.cumsum(size)
    far = np.repeat(ends, size) - np.arange(len(flat))
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
    return (total(far % 65521 * flat) + size) % 65521 << 16 | (total(flat) + 1) % 65521


def _of_all(f):
    """Function of a column, by ``f`` of the list of a batch's texts; nulls stay null."""

    @pandas_udf(LongType())
    def run(values: pd.Series) -> pd.Series:
        has = values.notna()
        out = pd.Series(pd.NA, index=values.index, dtype="Int64")
        out[has] = f([_raw(x) for x in values[has]]).astype(np.int64)
        return out

    return run


def rolling(kind: str, seed: int = 0):
    """Function of a column: the rolling hash ``kind`` of its bytes, as a long."""
    return _of_all(lambda texts: roll(texts, kind, seed))


def murmur3(seed: int = 0):
    return _of_all(lambda texts: murmur3_32(texts, seed))


adler32 = _of_all(adler32_of)
crc32c = _of_all(lambda texts: roll(texts, "crc32c", 0xFFFFFFFF) ^ _u(0xFFFFFFFF))


def lcg_rand(seed: Column) -> Column:
    """The first number of a linear congruential generator for each seed: 31 bits from three steps."""
    mask, state, out = F.lit(0xFFFFFFFF).cast("long"), seed.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), None
    for bits in (0x7FF, 0x3FF, 0x3FF):
        state = (state * 1103515245 + 12345).bitwiseAND(mask)
        part = F.shiftright(state, 16).bitwiseAND(F.lit(bits).cast("long"))
        out = part if out is None else F.shiftleft(out, 10).bitwiseXOR(part)
    return out
