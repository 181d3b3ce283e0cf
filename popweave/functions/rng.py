"""Counter-based random numbers: a pure function of seed, stream and keys.

Results don't depend on partitioning or execution order, a retried task draws
the same numbers, and SQL engines with MD5 can check them. Null keys are left
out of the counter.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(16**12)


def uniform(seed: int, stream: str, *keys: Column | str) -> Column:
    """A double in [0, 1) for each combination of keys."""
    return number(digits(seed, stream, *keys))


def digits(seed: int, stream: str, *keys: Column | str) -> Column:
    """The 12 hexadecimal digits that :func:`uniform` is made of, in whose order its numbers are."""
    return F.substring(digest(seed, stream, *keys), 1, 12)


def number(hexadecimal: Column) -> Column:
    """The number that :func:`uniform` makes of :func:`digits`."""
    return F.conv(hexadecimal, 16, 10).cast("double") / F.lit(SCALE)


def uniform_sql(seed: int, stream: str, *keys: str) -> str:
    """The DuckDB expression of :func:`uniform`."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{stream}', {', '.join(keys)})), 1, 12))::BIGINT / {SCALE!r}::DOUBLE)"


def digest(seed: int, stream: str, *keys: Column | str) -> Column:
    """The hexadecimal digest of a counter, of which :func:`quarter` takes four numbers."""
    return F.md5(counter(seed, stream, *keys))


def counter(seed: int, stream: str, *keys: Column | str) -> Column:
    """The text that a number of seed, stream and keys is the digest of."""
    parts = [F.lit(str(seed)), F.lit(stream), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)]
    return F.concat_ws("|", *parts)


SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def uniforms(before: str, n: int) -> np.ndarray:
    """:func:`uniform` of the counters ``before|1`` to ``before|n``, as an array."""
    head = before.encode() + b"|"
    if len(head) + len(str(n)) > 55:  # more than a block of MD5
        return np.array([int.from_bytes(hashlib.md5(b"%b%d" % (head, k), usedforsecurity=False).digest()[:6]) for k in range(1, n + 1)], float) / SCALE
    words = [_words(head, np.arange(10**d, min(10 ** (d + 1), n + 1)), d + 1) for d in range(len(str(n)))]
    return _heads([np.concatenate(w) for w in zip(*words, strict=True)], n) / SCALE


def _words(head: bytes, k: np.ndarray, length: int) -> list[np.ndarray]:
    """The 16 words of MD5's block of ``head`` and each number ``k`` of ``length`` digits."""
    block = np.frombuffer((head + bytes(length) + b"\x80").ljust(56, b"\0") + (8 * (len(head) + length)).to_bytes(8, "little"), "<u4")
    words = [np.full(len(k), w, np.uint32) for w in block]
    for place in range(length):
        at = len(head) + place
        digit = (k // 10 ** (length - 1 - place) % 10 + 48).astype(np.uint32)
        words[at // 4] |= digit << (8 * (at % 4))
    return words


def _heads(words: list[np.ndarray], n: int) -> np.ndarray:
    """The first 48 bits of the MD5 of ``n`` messages of a block, all at once."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in START)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        a += f
        a += words[g]
        a += np.uint32(SINES[i])
        shift = SHIFTS[turn][i % 4]
        turned = a << shift
        a >>= 32 - shift
        turned |= a
        turned += b
        a, d, c, b = d, c, b, turned
    a, b = a + np.uint32(START[0]), b + np.uint32(START[1])
    return (a.byteswap().astype(np.int64) << 16) | (b.byteswap() >> 16)


def quarter(hexadecimal: Column, j: Column | int) -> Column:
    """A double in [0, 1) of 32 bits: number ``j``, from 0 to 3, of a digest."""
    j = F.lit(j) if isinstance(j, int) else j
    return F.conv(F.substring(hexadecimal, 8 * j + 1, F.lit(8)), 16, 10).cast("double") / F.lit(float(16**8))


ROUNDS = 4


def permuted(seed: int, stream: str, i: Column, bits: Column, *keys: Column | str) -> Column:
    """The image of ``i`` under a permutation of the longs below 4**bits, one for each
    combination of keys: a Feistel network of ROUNDS rounds on two halves of ``bits`` bits."""
    shift = lambda way, x: F.call_function(f"shift{way}", x, bits)
    mask = shift("left", F.lit(1).cast("long")) - 1
    left, right = shift("right", i), i.bitwiseAND(mask)
    for turn in range(ROUNDS):
        parts = [F.lit(str(seed)), F.lit(f"{stream}/{turn}"), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys), right.cast("string")]
        drawn = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long")
        left, right = right, left.bitwiseXOR(drawn.bitwiseAND(mask))
    return shift("left", left) + right


def permuted_sql(seed: int, stream: str, i: str, bits: str, *keys: str) -> str:
    """The DuckDB expression of :func:`permuted`; ``i`` and ``bits`` are column names."""
    mask = f"((1::BIGINT << {bits}) - 1)"
    left, right = f"({i} >> {bits})", f"({i} & {mask})"
    for turn in range(ROUNDS):
        drawn = f"('0x' || substr(md5(concat_ws('|', '{seed}', '{stream}/{turn}', {', '.join(keys)}, {right})), 1, 12))::BIGINT"
        left, right = right, f"xor({left}, ({drawn}) & {mask})"
    return f"(({left} << {bits}) + {right})"


def pick(u: Column, n: Column) -> Column:
    """An index from 0 to n - 1."""
    return F.least(F.floor(u * n), n - 1).cast("long")


def normal(seed: int, stream: str, *keys: Column | str) -> Column:
    """A standard normal by Box and Muller's transform of two counters."""
    a, b = uniform(seed, stream + "/r", *keys), uniform(seed, stream + "/t", *keys)
    return F.sqrt(-2.0 * F.log(1.0 - a)) * F.cos(F.lit(2.0 * math.pi) * b)
