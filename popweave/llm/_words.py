"""Vectorised words and hashes over the UTF-8 bytes of many texts at once.

Texts are laid end to end with a separator between them, so that numpy works
on a few megabytes at a time however short or long single texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text that one numpy pass works on.
PASS_BYTES = 256 << 10


def byte_class(members: str) -> np.ndarray:
    """A 256-entry table: True for the byte values that ``members`` lists."""
    table = np.zeros(256, bool)
    table[list(members.encode("latin-1"))] = True
    return table


#: Bytes of a word: all but space and \t \n \v \f \r.
SOLID = ~byte_class(" \t\n\v\f\r")


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n at least."""
    global _powers
    if len(_powers[0]) < n:
        up = np.full(n, U(BASE))
        down = np.full(n, U(pow(BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = BASE**i times the polynomial hash of data[i:j]."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def spans_hashed(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end], alike wherever the bytes stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(U))


@dataclass
class Words:
    """Words of several texts: hashes, byte spans within their text, and where each text's words begin."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of length texts + 1

    def of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])


def _words_of(data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = member[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    if len(start) > len(end):
        end = np.concatenate([end, [len(data)]])
    return spans_hashed(prefix_hashes(data), start, end), start, end


def words(texts: list[bytes], member: np.ndarray = SOLID, lower: bool = False) -> Words:
    """All words (runs of ``member`` bytes; newline must not be one) of ``texts``.

    A text beyond :data:`PASS_BYTES` is cut between words, so memory follows
    the number of its words.
    """
    hashes, starts, ends, counts = [], [], [], []
    for group, pieces in _passes(texts, member):
        data = np.frombuffer(b"\n".join(pieces), np.uint8)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
        h, s, e = _words_of(data, member)
        base = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])]).astype(np.int64)
        at = np.searchsorted(s, base)
        offset = np.repeat(base[:-1] - np.array([o for _, o in group], np.int64), np.diff(at))
        hashes.append(h), starts.append(s - offset), ends.append(e - offset)
        counts.append(np.stack([np.array([i for i, _ in group]), np.diff(at)]))
    n = np.zeros(len(texts), np.int64)
    for c in counts:
        np.add.at(n, c[0], c[1])
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return Words(cat(hashes, U), cat(starts, np.int64), cat(ends, np.int64), np.concatenate([[0], np.cumsum(n)]).astype(np.int64))


def _passes(texts: list[bytes], member: np.ndarray) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Groups of (text, offset) with their bytes, of about PASS_BYTES each."""
    where: list[tuple[int, int]] = []
    pieces: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            to = len(text)
            if to - at > 2 * PASS_BYTES:
                to = at + PASS_BYTES
                while to < len(text) and member[text[to]]:
                    to += 1
            where.append((i, at)), pieces.append(text[at:to])
            size += to - at
            at = to
            if size >= PASS_BYTES:
                yield where, pieces
                where, pieces, size = [], [], 0
            if at >= len(text):
                break
    if where:
        yield where, pieces


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``width``-word window, and where each text's windows begin."""
    n = np.maximum(np.diff(first) - width + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], n)
    total = np.zeros(len(at), U)
    for i in range(width):
        total = total * U(BASE) + hashes[at + i]
    return mix(total), bounds


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null counts as empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def slices(batch: pa.RecordBatch, column: str, most: int = 4 * PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of ``batch`` whose texts have about ``most`` bytes together."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
