"""Removal of passages that occur again, with column-wise construction over anchored slices.

A byte goes if a string of 200 bytes that covers it starts anywhere else too. Inserting one symbol a round over whole
documents would take as many rounds as the longest has bytes, each over all that is built so far. So strings are first
lined up: in every 200-byte string the least hash among its 80-byte substrings marks an anchor, which depends on the
string alone. Equal strings therefore have equal anchors at equal places, and lie within the slice from 120 bytes
before the anchor to 200 after its first byte. Slices that occur twice go whole. Of other slices with a common anchor
the collection is built column by column: each round reads the next symbol of every slice from a sequential file in the
shared folder, sorts the slices by it (stably, so that they are ordered by their reversed prefixes: the order in which
the symbols read are the collection's Burrows-Wheeler transform at this column), and updates the common prefixes of
neighbours by minima over ranges. Neighbours with 200 symbols in common end equal strings.

An anchor that very many different slices share is divided: of each slice the parts for a few of its strings at a time
are put under the longer run of bytes that these strings have in common. What even then is too large for a task is
grouped string by string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import kernels
from weft.llm.scratch import Scratch, extended

#: Bytes of a string, and of the substrings among which its anchor is.
LENGTH, ANCHOR = 200, 80
#: Bytes of a slice before its anchor and from it on.
LEFT, RIGHT = LENGTH - ANCHOR, LENGTH
#: Slices built at once, about. More under one anchor are divided; each part is for so many strings of a slice.
TOGETHER, REACH = 20_000, 15
WIDTH, MISSING = LEFT + RIGHT, 256
_FLUSH = 1 << 19


def _sliding(x: np.ndarray, w: int, best: np.ufunc, worst: np.uint64) -> np.ndarray:
    """best(x[i : i + w]) for every i; beyond the end `worst`."""
    n = len(x)
    rows = -(-(n + w) // w)
    padded = np.full(rows * w, worst, dtype=np.uint64)
    padded[:n] = x
    table = padded.reshape(rows, w)
    ahead = best.accumulate(table, axis=1).ravel()
    behind = best.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: row, place in its row, hash of its bytes, hash of its slice."""
    none = np.zeros(0, dtype=np.int64)
    n = len(data)
    sizes = np.diff(offsets)
    if n < LENGTH or not (sizes >= LENGTH).any():
        return none, none, none.view(np.uint64), none.view(np.uint64)
    top, w = np.uint64(0xFFFFFFFFFFFFFFFF), LENGTH - ANCHOR + 1
    p = kernels.prefix_hash(data)
    inverse = kernels.powers(n + 1)[1]
    m = n - ANCHOR + 1
    h = kernels.mix((p[ANCHOR:] - p[:m]) * inverse[:m]) >> np.uint64(1)
    ends = np.repeat(offsets[1:], sizes)
    at = np.arange(m)
    h[at + ANCHOR > ends[:m]] = top
    least = _sliding(h, w, np.minimum, top)
    starts = at + LENGTH <= ends[:m]
    least[~starts] = 0
    # A place is an anchor if it is the least of some string that holds it: of those that begin up to w - 1 before.
    most = _sliding(np.concatenate((np.zeros(w - 1, np.uint64), least)), w, np.maximum, np.uint64(0))[:m]
    found = np.flatnonzero((most == h) & (h != top) & (h != 0))
    row = np.searchsorted(offsets, found, side="right") - 1
    a, b = np.maximum(found - LEFT, offsets[row]), np.minimum(found + RIGHT, offsets[row + 1])
    shape = (found - a).astype(np.uint64) * kernels.WEIGHTS[3] + (b - found).astype(np.uint64) * kernels.WEIGHTS[4]
    return row, found - offsets[row], h[found], kernels.mix((p[b] - p[a]) * inverse[a] + shape)


def _place(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for a place, as place_column() has it: equal ones only repeat a representative."""
    return (ids.astype(np.int64) << 24) ^ at


def place_column() -> Column:
    return F.shiftleft("__id", 24).bitwiseXOR(F.col("at").cast("bigint"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, slice, n, least place), added up over some MB."""

    def flush() -> pa.RecordBatch:
        a, s, p = (np.concatenate([x[k] for x in held]) for k in range(3))
        order = np.lexsort((p, s, a))
        a, s, p = a[order], s[order], p[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1]))))
        n = np.diff(np.append(first, len(a)))
        return pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array(s[first].view(np.int64)), pa.array(n), pa.array(p[first])], names=["anchor", "slice", "n", "place"])

    held, size = [], 0
    for batch in kernels.slices(batches, "__text", 1 << 18):
        row, at, a, s = anchors(*kernels.utf8(batch.column("__text")))
        if len(a):
            held.append((a, s, _place(batch.column("__id").to_numpy()[row], at)))
            size += len(a)
        if size >= _FLUSH:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in kernels.slices(batches, "__text", 1 << 18):
        row, at, a, s = anchors(*kernels.utf8(batch.column("__text")))
        own = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), batch.column("__id").take(own), batch.column("__hash").take(own), pa.array(at.astype(np.int32))], names=["anchor", "slice", "__id", "__hash", "at"])


SLICES = "anchor bigint, __id bigint, __hash int, at int, once boolean, start int, data binary"


def _slice_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SLICES.split(", ")])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of texts whose anchors come before them. Rows are sorted by text, anchors first. A slice's `start` is the
    column of its first byte."""
    owner, wanted = None, []
    for batch in kernels.slices(batches, "__text", 4 << 20):
        out = []
        for i, h, text, anchor, at, once in zip(*[batch.column(c).to_pylist() for c in ("__id", "__hash", "__text", "anchor", "at", "once")], strict=True):
            if (i, h) != owner:
                owner, wanted = (i, h), []
            if anchor is not None:
                wanted.append((anchor, at, once))
            elif wanted and text is not None:
                raw = text.encode()
                for anchor_, at_, once_ in wanted:
                    a = max(0, at_ - LEFT)
                    out.append((anchor_, i, h, at_, once_, a - at_ + LEFT, raw[a : at_ + RIGHT]))
                wanted = []
            if len(out) >= 10_000:
                yield _slice_rows(out)
                out = []
        if out:
            yield _slice_rows(out)


def _divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices to their parts for the strings that begin in `REACH` columns and one, each under a hash of the bytes that
    all these strings have."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            out = []
            for anchor, i, h, at, once, start, data in zip(*[c.to_pylist() for c in batch.slice(k, 1000).columns], strict=True):
                for lo in range(0, WIDTH - LENGTH + 1, REACH + 1):
                    hi = min(lo + REACH, WIDTH - LENGTH)
                    if start <= hi and lo + LENGTH <= start + len(data):
                        shared = data[hi - start : lo + LENGTH - start]
                        name = hashlib.blake2b(shared + bytes([lo]), digest_size=8, key=anchor.to_bytes(8, "little", signed=True)).digest()
                        a = max(lo, start)
                        out.append((int.from_bytes(name, "little", signed=True), i, h, at, once, a, data[a - start : hi + LENGTH - start]))
            if out:
                yield _slice_rows(out)


COLUMNS = "block bigint, c int, data binary"


def _columned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices, sorted by anchor, to blocks of whole groups: first whose slices they are, then the symbols of each column.

    A block is named by its first anchor. The rows of a block are the sequential file that its rounds read."""
    held: list[list] = [[] for _ in range(7)]

    def rows() -> Iterator[pa.RecordBatch]:
        groups = np.array(held[0], np.int64)
        table = np.full((len(groups), WIDTH), MISSING, dtype=np.uint16)
        for i, (start, s) in enumerate(zip(held[5], held[6], strict=True)):
            table[i, start : start + len(s)] = np.frombuffer(s, np.uint8)
        head = b"".join(np.array(held[i], kind).tobytes() for i, kind in enumerate((np.int64, np.int64, np.int32, np.int32, np.bool_)))
        names = ["block", "c", "data"]
        yield pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int64()), pa.array([-1], pa.int32()), pa.array([head], pa.binary())], names=names)
        for c in range(0, WIDTH, 20):
            data = [np.ascontiguousarray(table[:, k]).tobytes() for k in range(c, c + 20)]
            yield pa.RecordBatch.from_arrays([pa.array([held[0][0]] * 20, pa.int64()), pa.array(range(c, c + 20), pa.int32()), pa.array(data, pa.binary())], names=names)

    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            columns = [c.to_pylist() for c in batch.slice(a, 2000).columns]
            if len(held[0]) >= TOGETHER:
                # The last group may go on: it ends where the next anchor begins.
                last = held[0][-1]
                go_on = next((i for i, x in enumerate(columns[0]) if x != last), len(columns[0]))
                for h, c in zip(held, columns, strict=True):
                    h.extend(c[:go_on])
                if go_on < len(columns[0]):
                    yield from rows()
                    held = [[] for _ in range(7)]
                columns = [c[go_on:] for c in columns]
            for h, c in zip(held, columns, strict=True):
                h.extend(c)
    if held[0]:
        yield from rows()


class Collection:
    """Slices of groups while their columns are inserted; groups: ascending."""

    def __init__(self, groups: np.ndarray):
        n = len(groups)
        self.order, self.common = np.arange(n), np.zeros(n + 1, dtype=np.int32)
        self.rank = np.cumsum(np.concatenate(([0], groups[1:] != groups[:-1]))).astype(np.int64) * (MISSING + 1)

    def insert(self, column: np.ndarray) -> np.ndarray:
        """The slices that end, in this column, with LENGTH symbols that another slice of their group ends with."""
        symbols = column[self.order].astype(np.int64)
        # Groups stay together: positions of a group are the same before and after the round.
        key = self.rank + symbols
        to = np.argsort(key, kind="stable")
        k = key[to]
        same = np.flatnonzero((k[1:] == k[:-1]) & (symbols[to[1:]] != MISSING)) + 1
        new = np.zeros(len(key) + 1, dtype=np.int32)
        if len(same):
            ranges = np.stack((to[same - 1] + 1, to[same] + 1), axis=1).ravel()
            new[same] = np.minimum.reduceat(self.common, ranges)[::2] + 1
        self.order, self.common = self.order[to], new
        return self.order[(new[:-1] >= LENGTH) | (new[1:] >= LENGTH)]


SPANS = "__id bigint, __hash int, __a int, __b int"


def _spans(ids: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(hashes.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["__id", "__hash", "__a", "__b"])


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of COLUMNS, sorted: a round each. Of the slices that occur once the spans that are elsewhere too."""
    block = None
    for batch in batches:
        for name, c, data in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if c < 0:
                n = len(data) // 25
                cut = [data[a * n : b * n] for a, b in ((0, 8), (8, 16), (16, 20), (20, 24), (24, 25))]
                groups, ids, hashes, at, once = (np.frombuffer(x, k) for x, k in zip(cut, (np.int64, np.int64, np.int32, np.int32, np.bool_), strict=True))
                block, collection, found = name, Collection(groups), np.zeros((n, WIDTH - LENGTH + 1), dtype=bool)
                continue
            if name != block:
                raise ValueError(f"column {c} of a block without a head")
            hit = collection.insert(np.frombuffer(data, np.uint16))
            if c >= LENGTH - 1:
                found[hit, c - LENGTH + 1] = True
            if c == WIDTH - 1:
                edge = np.diff(np.pad(found & once[:, None], ((0, 0), (1, 1))).astype(np.int8), axis=1)
                row, first = np.nonzero(edge == 1)
                _, last = np.nonzero(edge == -1)
                if len(row):
                    yield _spans(ids[row], hashes[row], at[row] - LEFT + first, at[row] - LEFT + last - 1 + LENGTH)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All strings of slices, with what they are under."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            out = [(anchor, data[j : j + LENGTH], i, h, at + start - LEFT + j, once) for anchor, i, h, at, once, start, data in zip(*[c.to_pylist() for c in batch.slice(k, 500).columns], strict=True) for j in range(len(data) - LENGTH + 1)]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "string", "__id", "__hash", "__a", "once"])


def _cut(batches: Iterator[pa.RecordBatch], text: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by text, spans first."""
    owner, spans = None, []
    for batch in kernels.slices(batches, "__text", 4 << 20):
        rows, values = [], []
        for k, (i, h, kind, a, b) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("__id", "__hash", "__kind", "__a", "__b")], strict=True)):
            if (i, h) != owner:
                owner, spans = (i, h), []
            if kind == 0:
                spans.append((a, b))
                continue
            t = batch.column("__text")[k].as_py()
            raw = (t or "").encode()
            removed = n_spans = 0
            left = raw
            if spans:
                edge = np.zeros(len(raw) + 1, dtype=np.int64)
                s = np.clip(np.array(spans), 0, len(raw))
                np.add.at(edge, s[:, 0], 1)
                np.add.at(edge, s[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = int(gone.sum())
                n_spans = int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1]))))
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append(k)
            values.append((len(raw), removed, n_spans, hashlib.sha256(left).hexdigest(), None if t is None else left.decode(errors="ignore")))
        if rows:
            own = pa.array(rows, pa.int64())
            more = list(zip(*values, strict=True))
            out = {c: batch.column(c).take(own) for c in columns if c != text}
            arrays = [pa.array(more[4], pa.string()) if c == text else out[c] for c in columns]
            arrays += [pa.array(more[0], pa.int64()), pa.array(more[1], pa.int64()), pa.array(more[2], pa.int64()), pa.array(more[3])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _collected(slices: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Spans that the construction finds in slices, group by group."""
    columns = slices.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_columned, COLUMNS)
    columns = scratch.table(columns, name, release=True)
    return columns.repartition("block").sortWithinPartitions("block", "c").mapInArrow(_built, SPANS)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = TOGETHER) -> DataFrame:
    """docs with the remaining text, n_bytes, n_removed, n_spans and kept_sha256 (of the remaining bytes).

    Bytes are UTF-8; the remaining text leaves out bytes of characters that were cut in two. Null text counts as
    empty and stays null. Every row is a document, also where keys or whole rows repeat: repeated rows of 200 bytes or
    more go whole. Null keys are a key like others. Columns of docs stay; those with our names are replaced; an empty
    table gives no rows. Anchors and slices are told apart by 64-bit hashes of their own each."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    base = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "__id", "__hash", "__text", "__kind", "__a", "__b")
    rows = base.withColumns({"__id": F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))), "__hash": F.hash(text), "__text": F.col(text)})
    plain = rows.select("__id", "__hash", "__text")
    counted = plain.mapInArrow(_counted, "anchor bigint, slice bigint, n bigint, place bigint")
    counted = scratch.table(counted.groupBy("anchor", "slice").agg(F.sum("n").alias("n"), F.min("place").alias("place")), "counted", release=True)
    # Counts of an anchor add up before the shuffle, and the join can divide an anchor with many slices.
    again = counted.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).filter("all > 1").drop("all")
    live = scratch.table(counted.join(again, "anchor"), "live", release=True)
    scratch.drop("counted")
    located = plain.mapInArrow(_located, "anchor bigint, slice bigint, __id bigint, __hash int, at int").join(live, ["anchor", "slice"])
    # One place of each slice stands for it where its anchor has others.
    stands = (F.col("kinds") > 1) & (F.col("place") == place_column())
    located = scratch.table(located.select("anchor", "__id", "__hash", "at", (F.col("n") > 1).alias("again"), stands.alias("stands"), (F.col("kinds") > hot).alias("hot")), "located", release=True)
    scratch.drop("live")
    whole = located.filter("again").select("__id", "__hash", (F.col("at") - LEFT).alias("__a"), (F.col("at") + RIGHT).alias("__b"))
    asked = located.filter("stands").select("__id", "__hash", F.lit(None).cast("string").alias("__text"), "anchor", "at", (~F.col("again")).alias("once"), "hot")
    texts = plain.select("*", F.lit(None).cast("bigint").alias("anchor"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("boolean").alias("once"))

    def sliced(which: str) -> DataFrame:
        both = asked.filter(which).drop("hot").unionByName(texts).repartition("__id", "__hash").sortWithinPartitions("__id", "__hash", F.asc_nulls_last("anchor"))
        return both.mapInArrow(_sliced, SLICES)

    spans = whole.unionByName(_collected(sliced("not hot"), scratch, "columns"))
    if not asked.filter("hot").isEmpty():
        parts = scratch.table(sliced("hot").mapInArrow(_divided, SLICES), "parts", release=True)
        sizes = scratch.table(parts.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "sizes")
        spans = spans.unionByName(_collected(parts.join(sizes.filter(F.col("kinds") <= hot).select("anchor"), "anchor", "left_semi"), scratch, "more_columns"))
        strings = scratch.table(parts.join(sizes.filter(F.col("kinds") > hot).select("anchor"), "anchor", "left_semi").mapInArrow(_strings, "anchor bigint, string binary, __id bigint, __hash int, __a int, once boolean"), "strings")
        twice = strings.groupBy("anchor", "string").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        found = strings.join(twice, ["anchor", "string"], "left_semi").filter("once")
        spans = spans.unionByName(found.select("__id", "__hash", "__a", (F.col("__a") + LENGTH).alias("__b")))
    spans = scratch.table(spans, "spans", release=True)
    scratch.drop("located")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema.fields if f.name != text]
    marks = spans.select(*blank, F.col("__id"), F.col("__hash"), F.lit(None).cast("string").alias("__text"), F.lit(0).alias("__kind"), "__a", "__b")
    columns = [c for c in base.columns if c != text]
    own = rows.select(*columns, "__id", "__hash", "__text", F.lit(1).alias("__kind"), F.lit(None).cast("int").alias("__a"), F.lit(None).cast("int").alias("__b"))
    both = marks.unionByName(own).repartition("__id", "__hash").sortWithinPartitions("__id", "__hash", "__kind")
    out = extended(base, n_bytes="bigint", n_removed="bigint", n_spans="bigint", kept_sha256="string")
    names = base.columns
    return both.mapInArrow(lambda b: _cut(b, text, names), out)
