"""Rolling hashes over the bytes of many texts at once (numpy), and bounded bitmaps that spare needless movement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_rng = np.random.default_rng(20_24)
BASE = int(_rng.integers(1 << 40, 1 << 62)) | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CASELESS = BYTES.copy()
CASELESS[65:91] = BYTES[97:123]
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i (mod 2**64) for i < n, kept per process."""
    if len(_powers["up"]) < n:
        for k, b in (("up", BASE), ("down", INVERSE)):
            steps = np.full(n, b & ((1 << 64) - 1), np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any byte ranges of one buffer."""

    def __init__(self, data: np.ndarray, table: np.ndarray = BYTES):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[:-1], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets); a null text is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0] if len(column) else np.zeros(1, np.int64))


def bitmap(keys: DataFrame, key: Column, bits: int = 1 << 22) -> np.ndarray:
    """A bit for the hash of every key, at most `bits` / 64 numbers on the driver whatever the number of keys.

    It tells keys that are surely absent; as keys grow it only tells less, and the join that follows stays exact.
    """
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    words = keys.select(at.alias("b")).groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("v")).collect()
    out = np.zeros(bits // 64, np.uint64)
    for r in words:
        out[r.w] = r.v & ((1 << 64) - 1)
    return out


def maybe_in(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether xxhash64 values (computed by Spark) have their bit in the bitmap."""
    at = np.mod(hashes.astype(np.int64), len(found) * 64)
    return (found[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
