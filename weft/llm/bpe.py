"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Blocks of documents become distinct words and positions. The words of all blocks meet in buckets by their hash, where
each distinct one is encoded once; its ids go back to the blocks, which put them at their positions. For decoding, ids
are joined with the token-byte table, a hash table in each worker, which the vocabulary bounds.

A word here is a piece of text between single spaces, with the space before it. It holds whole matches of the pattern,
and no match crosses its ends (see tokens.split_words), so that each match is encoded separately, and once a bucket.

What is shuffled are packed lists, one row for each block and bucket: a word that is everywhere has one entry in each
block, and blocks are of bounded size, so no key gathers more than others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import kernels, tokens
from weft.llm.scratch import Scratch, partitions, pick, stable

#: Characters of text in a block, about; and buckets at most, so that rows (blocks x buckets) grow with the input alone.
#: What a bucket remembers of its words is bounded as well: beyond, a word is encoded again.
BLOCK, BUCKETS = 24 << 20, 4096
ROWS = "block string, kind int, part int, ids array<bigint>, data binary"


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed string, each with its length before it; 32-bit numbers byte by byte, which compresses
    better."""
    raw = [a if isinstance(a, bytes) else a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.uint64(len(r)).tobytes() + r for r in raw))


def unpack(data: bytes, *kinds: type) -> list:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        n = int(np.frombuffer(raw, np.uint64, 1, at)[0])
        part = raw[at + 8 : at + 8 + n]
        out.append(part if kind is bytes else np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(4, -1).T).view("<u4").ravel())
        at += 8 + n
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "kind", "part", "ids", "data"])


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int, positions: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: kind 0, the words of a block in a bucket, in order; or, with `positions`, kind 1, where each
    word stands in that order, and kind 2, documents as positions of words, the most frequent word first.

    A block is named by its texts, so both kinds of rows find each other whichever task made them."""

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        block = digest.hexdigest()
        words = [w.encode() for w in index]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.uint32, len(words))
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        if not positions:
            found, at = np.unique(bucket[order], return_index=True)
            for k, a, b in zip(found, at, [*at[1:], len(words)], strict=True):
                own = [words[i] for i in order[a:b]]
                yield _rows([(block, 0, int(k), [], pack(np.fromiter(map(len, own), np.uint32, len(own)), b"".join(own)))])
            return
        often = np.bincount(np.concatenate([places for _, _, places in held]), minlength=len(words))
        by_rank = np.argsort(-often, kind="stable")
        rank, place = np.empty(len(words), np.uint32), np.empty(len(words), np.uint32)
        rank[by_rank] = np.arange(len(words), dtype=np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        yield _rows([(block, 1, 0, [], pack(place[by_rank]))])
        for part, (ids, ends, places) in enumerate(held):
            yield _rows([(block, 2, part, ids, pack(ends, rank[places]))])

    index: defaultdict = defaultdict()
    index.default_factory = index.__len__
    held, size, digest = [], 0, hashlib.blake2b(digest_size=16)
    for batch in kernels.slices(batches, "text"):
        places, ends, n = [], [], 0
        for t in batch.column("text").to_pylist():
            cut = tokens.split_words(t or "")
            places.append(np.fromiter(map(index.__getitem__, cut), np.uint32, len(cut)))
            n += len(cut)
            ends.append(n)
            raw = (t or "").encode()
            size += len(raw)
            digest.update(len(raw).to_bytes(8, "little") + raw)
        held.append((batch.column("id").to_pylist(), np.array(ends, np.uint32), np.concatenate(places)))
        if size >= BLOCK:
            yield from flush()
            index.clear()
            held, size, digest = [], 0, hashlib.blake2b(digest_size=16)
    yield from flush()


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0, sorted by bucket, with the words' ids in place of the words."""
    bucket, known = None, {}
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["part"] != bucket:
                bucket, known = row["part"], {}
            sizes, text = unpack(row["data"], np.uint32, bytes)
            ends = np.cumsum(sizes).tolist()
            words = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            new = [w for w in words if w not in known]
            if len(known) + len(new) > tokens.MOST_PIECES:
                known = {w: known[w] for w in words if w in known}
            for w, ids in zip(new, tokens.encode(tokenizer, [w.decode() for w in new]), strict=True):
                known[w] = np.array(ids, np.uint32).tobytes()
            ids = [known[w] for w in words]
            yield _rows([(row["block"], 0, row["part"], [], pack(np.fromiter(map(len, ids), np.uint32, len(ids)) // 4, np.frombuffer(b"".join(ids), np.uint32)))])


def _assembled(batches: Iterator[pa.RecordBatch], tokenizer: str, ids_out: bool) -> Iterator[pa.RecordBatch]:
    """Documents from the rows of their blocks, which come sorted by kind and part."""
    block, parts, said, decoded, lengths = None, {}, [], [], np.zeros(0, np.int64)
    table = tokens.held(("bytes", tokenizer), lambda: token_bytes(tokenizer))
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["block"] != block:
                block, parts = row["block"], {}
            if row["kind"] == 0:
                parts[row["part"]] = row["data"]
            elif row["kind"] == 1:
                (place,) = unpack(row["data"], np.uint32)
                order = np.argsort(place)  # the word at each place
                said, decoded, lengths = [b""] * len(order), [b""] * len(order), np.zeros(len(order), np.int64)
                at = 0
                for bucket in sorted(parts):
                    sizes, raw = unpack(parts[bucket], np.uint32, np.uint32)
                    own = order[at : at + len(sizes)]
                    lengths[own] = sizes
                    at += len(sizes)
                    ids = raw.tolist()
                    a = 0
                    for word, n in zip(own.tolist(), sizes.tolist(), strict=True):
                        one = ids[a : a + n]
                        a += n
                        said[word] = ",".join(map(str, one)).encode()
                        decoded[word] = b"".join([table[i] for i in one])
                if at != len(order):
                    raise ValueError("the input's rows came in other blocks when read again")
            else:
                ends, places = unpack(row["data"], np.uint32, np.uint32)
                out, a = [], 0
                for doc, b in zip(row["ids"], ends.tolist(), strict=True):
                    own = places[a:b]
                    a = b
                    listed = own.tolist()
                    ids = b",".join(map(said.__getitem__, listed))
                    text = b"".join(map(decoded.__getitem__, listed))
                    out.append((doc, int(lengths[own].sum()), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()) + ((ids, text) if ids_out else ()))
                columns = list(zip(*out, strict=True))
                arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3])]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids_out:
                    arrays += [pa.array([[int(x) for x in c.split(b",")] if c else [] for c in columns[4]], pa.list_(pa.int32())), pa.array(columns[5], pa.binary())]
                    names += ["token_ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)


def token_bytes(tokenizer: str) -> dict[int, bytes]:
    """The token-byte table: its size is that of the vocabulary."""
    return {rank: token for token, rank in tokens.library(tokenizer)._mergeable_ranks.items()}


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Per row of docs: the key (a long), n_tokens, ids_sha256, decoded_sha256; with `ids` also token_ids and decoded.

    As tiktoken encodes the text without special tokens; null text counts as empty. Nothing is looked up by the key, so
    that null and repeated keys do no harm. No other column of docs is read.

    docs are read twice, once for the words and once for their positions, which costs less than keeping positions
    beside their shuffle. Whatever isn't a plain scan of Parquet is written to a table first, since it must give the
    same rows both times. An empty table gives no rows."""
    spark = docs.sparkSession
    held = stable(pick(docs, id=key, text=text), Scratch(spark, "bpe"))
    buckets = max(partitions(spark), min(BUCKETS, 2 * held.rdd.getNumPartitions()))
    words = held.mapInArrow(lambda b: _blocks(b, buckets, False), ROWS).repartition(buckets, "part").sortWithinPartitions("part").mapInArrow(lambda b: _encoded(b, tokenizer), ROWS)
    back = words.unionByName(held.mapInArrow(lambda b: _blocks(b, buckets, True), ROWS)).repartition("block").sortWithinPartitions("block", "kind", "part")
    out = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>, decoded binary" if ids else "")
    return back.mapInArrow(lambda b: _assembled(b, tokenizer, ids), out).withColumnRenamed("id", key)
