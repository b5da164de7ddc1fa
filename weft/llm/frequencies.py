"""Document frequencies of tokens, exchanged in blocks.

Blocks of documents send their sorted distinct tokens to ranges of the hash, where the counts of all blocks are added
up; what a range knows of a block's tokens goes back to that block. Rows are packed lists, so that a token that is
everywhere has one entry a block, and what is rare costs the bytes of a difference between sorted hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from weft.llm import kernels
from weft.llm.scratch import partitions

#: Tokens in a block, about: what one Python worker holds. Larger workers may take larger blocks, which make fewer rows
#: (blocks x ranges): at 64 M tokens a block and range, 100 TB make rows of about 200 tokens.
BLOCK = 1 << 20
ROWS = "block string, kind int, part int, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 32 or 64 bit numbers, byte by byte of all numbers, which compresses equal high bytes away."""
    head = np.array([x for a in arrays for x in (a.itemsize, len(a))], np.uint64)
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() if len(a) else b"" for a in arrays)
    return np.uint64(len(head)).tobytes() + head.tobytes() + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(data: bytes) -> list[np.ndarray]:
    m = int(np.frombuffer(data, np.uint64, 1)[0])
    head = np.frombuffer(data, np.uint64, m, 8).tolist()
    raw, at, out = zstandard.ZstdDecompressor().decompress(data[8 + 8 * m :]), 0, []
    for size, n in zip(head[::2], head[1::2], strict=True):
        part = np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n)
        out.append(np.ascontiguousarray(part.T).view(np.uint32 if size == 4 else np.uint64).ravel())
        at += size * n
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "kind", "part", "data"])


def blocks(batches: Iterator[pa.RecordBatch], text: str, sets: Callable, size: int) -> Iterator[tuple[str, list[pa.RecordBatch], list[np.ndarray]]]:
    """(name, slices of rows, the token set of each row). A block is named by its tokens, so that two passes over the
    same rows name it alike. Blocks of equal tokens share their answers."""
    held, own, n = [], [], 0

    def name() -> str:
        digest = hashlib.blake2b(digest_size=16)
        for s in own:
            digest.update(len(s).to_bytes(8, "little") + s.tobytes())
        return digest.hexdigest()

    for batch in kernels.slices(batches, text, 1 << 19):
        found = sets(*kernels.utf8(batch.column(text)))
        held.append(batch)
        own.extend(found)
        n += sum(map(len, found))
        if n >= size:
            yield name(), held, own
            held, own, n = [], [], 0
    if held:
        yield name(), held, own


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, in its order."""
    return ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def sent(batches: Iterator[pa.RecordBatch], text: str, sets: Callable, size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: a block's distinct tokens in a range, in order, with the documents of the block that have them."""
    for block, _, own in blocks(batches, text, sets, size):
        tokens, n = np.unique(np.concatenate(own), return_counts=True)
        cuts = np.searchsorted(_bucket(tokens, buckets), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            t = tokens[cuts[b] : cuts[b + 1]]
            yield _rows([(block, 0, b, pack(np.diff(t, prepend=np.uint64(0)), n[cuts[b] : cuts[b + 1]].astype(np.uint32)))])


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0 in, sorted by range; kind 0 out: of each block the tokens of the range that several documents have, by
    their places among the block's, and the documents of all blocks that have them."""

    def flush() -> Iterator[pa.RecordBatch]:
        tokens, turn = np.unique(np.concatenate([t for _, t, _ in held]), return_inverse=True)
        total = np.zeros(len(tokens), np.int64)
        np.add.at(total, turn, np.concatenate([n for _, _, n in held]).astype(np.int64))
        at = 0
        for block, own, _ in held:
            n = total[turn[at : at + len(own)]]
            at += len(own)
            some = np.flatnonzero(n > 1)
            yield _rows([(block, 0, bucket, pack(np.array([len(own)], np.uint32), some.astype(np.uint32), np.minimum(n[some], (1 << 32) - 1).astype(np.uint32), own[some]))])

    bucket, held = None, []
    for batch in batches:
        for block, part, data in zip(*[batch.column(c).to_pylist() for c in ("block", "part", "data")], strict=True):
            if part != bucket:
                if held:
                    yield from flush()
                bucket, held = part, []
            steps, n = unpack(data)
            held.append((block, np.cumsum(steps, dtype=np.uint64), n))
    if held:
        yield from flush()


def placed(batches: Iterator[pa.RecordBatch], text: str, sets: Callable, size: int, more: Callable) -> Iterator[pa.RecordBatch]:
    """Kind 1: slices of a block's rows: each row's tokens as places among the block's, and what `more` keeps of them."""
    for block, held, own in blocks(batches, text, sets, size):
        _, turn = np.unique(np.concatenate(own), return_inverse=True)
        sizes = np.fromiter(map(len, own), np.uint32, len(own))
        ends = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
        at = 0
        for part, batch in enumerate(held):
            a, b = at, at + batch.num_rows
            at = b
            yield _rows([(block, 1, part, pack(sizes[a:b], turn[ends[a] : ends[b]].astype(np.uint32), *more(batch, own[a:b])))])


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]]:
    """Rows of both kinds, sorted by block, kind and part, to (block, what `more` kept, (tokens, frequencies) of each
    row) a slice. Tokens of frequency 1 are left out of the first; the second has all, in the order of their hashes."""
    block, parts = None, {}
    known: tuple | None = None
    for batch in batches:
        for name, kind, part, data in zip(*[batch.column(c).to_pylist() for c in ("block", "kind", "part", "data")], strict=True):
            if name != block:
                block, parts, known = name, {}, None
            if kind == 0:
                parts[part] = unpack(data)
                continue
            sizes, places, *more = unpack(data)
            if known is None:
                starts = np.cumsum([0, *(int(p[0][0]) for p in parts.values())])
                n, tokens = np.ones(starts[-1], np.uint32), np.zeros(starts[-1], np.uint64)
                for s, (_, some, often, own) in zip(starts, parts.values(), strict=False):
                    n[s + some.astype(np.int64)], tokens[s + some.astype(np.int64)] = often, own
                known, parts = (n, tokens), {}
            if len(places) and int(places.max()) >= len(known[0]):
                raise ValueError("the input's rows differ when read again")
            ends = np.cumsum(sizes.astype(np.int64)).tolist()
            yield block, more, [(known[1][places[a:b]], known[0][places[a:b]]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def exchanged(docs: DataFrame, text: str, sets: Callable, more: Callable, size: int | None = None) -> DataFrame:
    """Rows for joined(), sorted as it takes them. docs are read twice, in the same order (see scratch.stable)."""
    spark, size = docs.sparkSession, size or BLOCK
    buckets = max(partitions(spark), 4 * docs.rdd.getNumPartitions())
    back = docs.mapInArrow(lambda b: sent(b, text, sets, size, buckets), ROWS).repartition(buckets, "part").sortWithinPartitions("part").mapInArrow(answered, ROWS)
    own = docs.mapInArrow(lambda b: placed(b, text, sets, size, more), ROWS)
    return back.unionByName(own).repartition("block").sortWithinPartitions("block", "kind", "part")
