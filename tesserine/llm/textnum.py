"""Texts as numpy arrays: code points, words and their hashes, for scoring in batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import drop_scratch, scratch

#: Multiplier of the polynomial word hash, and the longest power table.
MUL, POWERS = 0x9E3779B97F4A7C15, 64


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def powers() -> np.ndarray:
    out, x = np.empty(POWERS, np.uint64), 1
    for k in range(POWERS):
        out[k] = x
        x = x * MUL & (1 << 64) - 1
    return out


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each text followed by one newline, and the texts' offsets."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    flat = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
    return flat, np.concatenate([[0], np.cumsum(size)])


def words(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the words among code points; ASCII white space parts them."""
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(flat: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(start):
        return np.zeros(0, np.uint64)
    at = np.arange(len(flat)) - np.repeat(start, np.diff(np.append(start, len(flat)))) if start[0] == 0 else None
    if at is None:
        at = np.arange(len(flat))
        at[start[0] :] -= np.repeat(start, np.diff(np.append(start, len(flat))))
    value = (flat.astype(np.uint64) + np.uint64(1)) * powers()[at % POWERS]
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    value[space] = 0
    return mix(np.add.reduceat(value, start) + (stop - start).astype(np.uint64))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def bounded(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """``rows`` if they are ``most`` or fewer, else about that many, drawn by a hash of the key."""
    n = rows.count()
    if n <= most:
        return rows
    buckets = 1 << 20
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(buckets)) < max(1, most * buckets // n))


def within_bytes(rows: DataFrame, column: str, most: int) -> "pandas.DataFrame":  # noqa: F821
    """The rows (with doc_id) in the driver, if ``column`` holds ``most`` bytes of them or less; else as many whole
    ones as fit, drawn by a hash of the id, and none of over an eighth of that. Sizes come first, one number a row."""
    rows = scratch(rows.withColumn("draw", F.xxhash64("doc_id", F.lit("bytes"))), "sample")
    sizes = rows.select("draw", F.octet_length(column).alias("n")).toPandas().sort_values(["draw", "n"])
    found = rows
    if sizes["n"].sum() > most:
        fit = sizes[sizes["n"] <= most // 8]
        fit = fit[fit["n"].cumsum() <= most]
        found = rows.filter((F.octet_length(column) <= most // 8) & (F.col("draw") < int(fit["draw"].max()))) if len(fit) else rows.limit(0)
    out = found.drop("draw").toPandas()
    drop_scratch(rows)
    return out
