"""Deterministic draws: every random choice is a function of md5(seed | key ...).

The same row gets the same draw in every run, on every cluster and after every
task retry, and the order can be reproduced by any SQL engine.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

HEX_DIGITS = 13  # 52 bits, exactly representable in a double


def digest(*parts) -> Column:
    cols = [F.lit(str(p)) if not isinstance(p, Column) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *cols))


def uniform(*parts) -> Column:
    """Uniform number in [0, 1) drawn from the digest of the parts."""
    head = F.conv(F.substring(digest(*parts), 1, HEX_DIGITS), 16, 10)
    return head.cast("double") / F.lit(float(16**HEX_DIGITS))


def normal(*parts) -> Column:
    """Standard normal number by the Box-Muller transform of two uniforms."""
    u = F.lit(1.0) - uniform(*parts, "u")
    v = uniform(*parts, "v")
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


# ---------------------------------------------------------------- many draws per row

BLOCK_BYTES, CHUNK, FEW = 55, 16384, 64  # longest text of a single md5 block, rows hashed at once, rows too few for numpy
TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _head(words: list) -> np.ndarray:
    """First eight bytes, as big-endian numbers, of the md5 of one block per row: 16 words, each an array or a number for all rows."""
    n = next(len(w) for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(n, v, np.uint32) for v in START)
    mix, turned = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=mix), np.bitwise_and(mix, b, out=mix), np.bitwise_xor(mix, d, out=mix)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=mix), np.bitwise_and(mix, d, out=mix), np.bitwise_xor(mix, c, out=mix)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=mix), np.bitwise_xor(mix, d, out=mix)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=mix), np.bitwise_or(mix, b, out=mix), np.bitwise_xor(mix, c, out=mix)
            g = 7 * i % 16
        mix += a
        if isinstance(words[g], np.ndarray):
            mix += words[g]
            mix += np.uint32(SINES[i])
        else:
            mix += np.uint32((SINES[i] + words[g]) & 0xFFFFFFFF)
        np.left_shift(mix, TURNS[i], out=turned), np.right_shift(mix, 32 - TURNS[i], out=mix)
        mix |= turned
        mix += b
        a, b, c, d, mix = d, mix, b, c, a
    a += np.uint32(START[0])
    b += np.uint32(START[1])
    return np.stack([a, b], 1).astype("<u4", copy=False).view(">u8").ravel()


def heads(starts: list[bytes], ends: list[bytes]) -> np.ndarray:
    """First eight bytes, as numbers, of md5(start + end): a row per end, a column per start. Equally long starts are hashed together."""
    out = np.empty((len(ends), len(starts)), np.uint64)
    sizes = np.fromiter(map(len, starts), np.int64, len(starts))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for lo in range(0, len(at), CHUNK):
            some = at[lo : lo + CHUNK]
            texts = [starts[i] for i in some]
            whole, cut = divmod(int(size), 4)
            padded = np.zeros((len(some), 4 * (whole + 1)), np.uint8)
            padded[:, :size] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(some), size)
            first = list(np.ascontiguousarray(padded.view("<u4").T.astype(np.uint32)))
            for j, end in enumerate(ends):
                length = int(size) + len(end)
                if length > BLOCK_BYTES or len(some) < FEW:
                    out[j, some] = [int.from_bytes(hashlib.md5(t + end, usedforsecurity=False).digest()[:8]) for t in texts]
                    continue
                tail = bytes(cut) + end + b"\x80"
                tail = tail.ljust(56 - 4 * whole, b"\0") + (8 * length).to_bytes(8, "little")
                rest = [int.from_bytes(tail[k : k + 4], "little") for k in range(0, len(tail), 4)]
                out[j, some] = _head([*first[:whole], first[whole] | np.uint32(rest[0]), *rest[1:]])
    return out


def draws(seed, keys: list[Column], uniforms: list[tuple[str, ...]], normals: list[tuple[str, ...]] = ()) -> Column:
    """Struct u0, u1, .. of uniform(seed, *keys, *parts) and n0, n1, .. of normal(seed, *keys, *parts), for rows with many draws.

    The numbers are those of the expressions above; the digests are taken column by column over a batch of rows.
    """
    parts = [*uniforms, *[(*p, t) for p in normals for t in ("u", "v")]]
    ends = [("|" + "|".join(p)).encode() for p in parts]
    k, names = len(uniforms), [f"u{i}" for i in range(len(uniforms))] + [f"n{i}" for i in range(len(normals))]

    @F.pandas_udf(StructType([StructField(n, DoubleType()) for n in names]))
    def batch(start: pd.Series) -> pd.DataFrame:
        u = (heads(start.to_list(), ends) >> np.uint64(64 - 4 * HEX_DIGITS)) / float(16**HEX_DIGITS)
        drawn = [*u[:k], *(np.sqrt(-2.0 * np.log(1.0 - u[k::2])) * np.cos(6.283185307179586 * u[k + 1 :: 2]))]
        return pd.DataFrame(dict(zip(names, drawn, strict=True)))

    return batch(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in keys]).cast("binary"))
