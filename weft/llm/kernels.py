"""Vectorised kernels over the UTF-8 bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd base of the polynomial hashes modulo 2**64, and odd weights of the words in a shingle.
BASE = np.uint64(0x9E3779B97F4A7C15)
WEIGHTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 20)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, b, dtype=np.uint64)))) for b in (BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pc.cast(pc.fill_null(column, ""), pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    if len(offsets) == 0:
        offsets = np.zeros(1, dtype=np.int64)
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of whole rows with about `most` bytes of text at most (a longer row goes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(n, dtype=np.int64) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with (p[e] - p[s]) * BASE**-s the hash of data[s:e]."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word [^\\x20\\x09-\\x0D]+: hash, row, first byte, end. Words never cross rows."""
    solid = np.zeros(len(data) + 1, dtype=bool)
    solid[:-1] = ~SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    starts = np.flatnonzero(solid[:-1] & (first[:-1] | ~np.concatenate(([False], solid[:-2])))) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(solid[:-1] & (first[1:] | ~solid[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    p = prefix_hash(LOWER[data] if lower else data)
    h = mix((p[ends] - p[starts]) * powers(len(data) + 1)[1][starts] + (ends - starts).astype(np.uint64) * WEIGHTS[7])
    return h, np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def shingles(offsets: np.ndarray, data: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each row the sorted distinct hashes of its k-word shingles; of fewer words, of the whole sequence."""
    h, row, _, _ = words(offsets, data)
    n = len(offsets) - 1
    per = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    at = np.concatenate(([0], np.cumsum(per)))
    weight = np.resize(WEIGHTS, k) * (np.arange(k, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    rolled = np.zeros(max(len(h) - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        rolled += h[j : j + len(rolled)] * weight[j]
    rolled = mix(rolled)
    out = []
    for i in range(n):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix(np.array([np.sum(h[a:b] * weight[: b - a]) + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
