"""Mixture-controlled packing of token sequences by deficit round-robin over source queues."""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections import deque
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import kernels, tokens
from weft.llm.scratch import Scratch, partitions, pick

#: Tokens in a chunk, about: what one task packs alone; and what a worker holds of all sources before it writes them down.
CHUNK = 1 << 20
#: Queues at most; of more sources the largest half as many have their own, all others share the rest by a hash.
QUEUES = 1024
PARTS = "part string, source string, size bigint, ids array<bigint>, sizes array<bigint>, data binary"
SLICES = "chunk bigint, source string, at bigint, ids array<bigint>, starts array<bigint>, sizes array<bigint>, wholes array<bigint>, data binary"
PIECES = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _batch(rows: list[tuple], names: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names.split(" "))


def _parts(batches: Iterator[pa.RecordBatch], tokenizer: str, end: int, size: int) -> Iterator[pa.RecordBatch]:
    """Documents as token ids, those of one source a row; rows are written whenever `size` tokens are held of all sources.

    A row is named by what it holds, and by its place only where two hold the same, so that two runs over the same files
    pack alike."""
    last = np.uint32(end).tobytes()
    encoder = tokens.held(("texts", tokenizer), lambda: tokens.Texts(tokenizer))
    held: dict[str | None, tuple[list, list, list]] = {}
    total = written = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal written
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        for source, (ids, sizes, raw) in held.items():
            raw = b"".join(raw)
            name = hashlib.blake2b(raw + repr((source, ids, sizes)).encode(), digest_size=16).hexdigest()
            written += 1
            yield _batch([(f"{name}-{TaskContext.get().partitionId()}-{written}", source, sum(sizes), ids, sizes, zstandard.ZstdCompressor(level=1).compress(_narrow(raw)))], "part source size ids sizes data", kinds)
        held.clear()

    for batch in kernels.slices(batches, "text"):
        for key, source, own in zip(batch.column("id").to_pylist(), batch.column("source").to_pylist(), encoder(batch.column("text")), strict=True):
            own += last
            ids, sizes, raw = held.setdefault(source, ([], [], []))
            ids.append(key)
            sizes.append(len(own) // 4)
            raw.append(own)
            total += sizes[-1]
            if total >= size:
                yield from flush()
                total = 0
    yield from flush()


class Plan:
    """How far each source's queue has been served before each chunk.

    While sources last, they are served by their shares, those that are left by theirs among them; sources without a
    share follow, by their sizes. So source s has given min(total, share * v) where v grows until all are dry."""

    def __init__(self, totals: Mapping, shares: Mapping, window: int, chunk: int):
        self.totals, self.shares = dict(totals), {s: float(shares.get(s, 0.0)) for s in totals}
        listed = sorted((s for s in totals if self.shares[s] > 0), key=lambda s: totals[s] / self.shares[s])
        # Corners (tokens served of all listed sources, v), where one of them runs dry.
        self.corners, served, v, rate = [(0.0, 0.0)], 0.0, 0.0, sum(self.shares[s] for s in listed)
        for s in listed:
            dry = totals[s] / self.shares[s]
            served, v, rate = served + max(rate, 0.0) * (dry - v), dry, rate - self.shares[s]
            self.corners.append((served, v))
        self.listed = sum(totals[s] for s in listed)
        self.all = sum(totals.values())
        # Each source's limit is a whole number, so that a chunk differs from its size by less than one token a source.
        n = len(totals)
        self.sequences = max(1, chunk // window, -(-4 * n // window))
        self.size = max(1, self.sequences * window - n)
        self.chunks = -(-self.all // self.size)

    def given(self, source: str | None, chunk: int) -> float:
        t, total, share = chunk * self.size, self.totals[source], self.shares[source]
        if chunk >= self.chunks:
            return total
        if not share:
            return min(total, total * max(t - self.listed, 0) / (self.all - self.listed))
        k = bisect.bisect_right(self.corners, t, key=lambda c: c[0])
        if k == len(self.corners):
            return total
        (x0, y0), (x1, y1) = self.corners[k - 1], self.corners[k]
        return min(total, share * min(y1, y0 + (y1 - y0) / (x1 - x0) * (t - x0)))

    def limit(self, source: str | None, chunk: int) -> int:
        return int(self.given(source, chunk))

    def cuts(self, source: str | None, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(chunk, start, end) of the parts of a source's queue between start and end."""
        c = bisect.bisect_right(range(self.chunks + 1), start, key=lambda c: self.limit(source, c)) - 1
        while start < end:
            stop = min(end, self.limit(source, c + 1))
            if stop > start:
                yield c, start, stop
                start = stop
            c += 1


def _slices(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Parts cut where the plan's chunks end."""
    lists = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.string(), pa.int64(), lists, lists, lists, lists, pa.binary()]
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            data, ids, sizes = _wide(row["data"]), np.array(row["ids"], dtype=object), np.array(row["sizes"], dtype=np.int64)
            ends = np.cumsum(sizes)
            begins, before = ends - sizes, row["before"]
            for chunk, a, b in plan.cuts(row["source"], before, before + row["size"]):
                x, y = a - before, b - before
                i, j = int(np.searchsorted(ends, x, side="right")), int(np.searchsorted(begins, y, side="left"))
                starts = np.maximum(x - begins[i:j], 0)
                held = np.minimum(ends[i:j], y) - begins[i:j] - starts
                yield _batch([(chunk, row["source"], a, ids[i:j].tolist(), starts.tolist(), held.tolist(), sizes[i:j].tolist(), _bytes(data[x:y]))], "chunk source at ids starts sizes wholes data", kinds)


def _bytes(a: np.ndarray) -> bytes:
    """A byte that says the width, then the ids as 16 bits if they fit."""
    return b"\x02" + a.astype(np.uint16).tobytes() if not len(a) or a.max() < 1 << 16 else b"\x04" + a.astype(np.uint32).tobytes()


def _narrow(raw: bytes) -> bytes:
    return _bytes(np.frombuffer(raw, np.uint32))


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if raw[0] == 2 else np.uint32, offset=1)


def _wide(data: bytes) -> np.ndarray:
    return _ids(zstandard.ZstdDecompressor().decompress(data))


def deal(sources: list, sizes: list[int], shares: Mapping, owed: Mapping, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece, in order.

    Each window gives every source that is left its share among them besides what it is owed; a source serves its
    oldest documents, up to what it has been given in whole tokens. Sources without a share wait for the others, then
    go by their sizes. Room that is left goes to the source that is owed most, as a debt; so only the last window of a
    chunk isn't full."""
    queues: dict = {}
    for i, s in enumerate(sources):
        if sizes[i]:
            queues.setdefault(s, deque()).append(i)
    left = dict.fromkeys(queues, 0)
    for i, s in enumerate(sources):
        if sizes[i]:
            left[s] += sizes[i]
    begun = dict.fromkeys(range(len(sizes)), 0)
    deficit = {s: float(owed.get(s, 0.0)) for s in sorted(queues, key=str)}
    sequence = 0
    while queues:
        room, offset = window, 0
        deficit = {s: x for s, x in deficit.items() if s in queues}
        weight = {s: shares.get(s, 0.0) for s in deficit}
        if not any(weight.values()):
            weight = {s: left[s] for s in deficit}
        each = (window - sum(deficit.values())) / sum(weight.values())  # what is owed and given makes up the window
        for s in deficit:
            deficit[s] += weight[s] * each
        while room and queues:
            # The first rounds give what is due; then, with nothing due, the room goes to whom most is owed.
            due = [s for s in queues if deficit[s] >= 1]
            for s in due or [max(queues, key=lambda s: deficit[s])]:
                give = min(room, left[s], int(deficit[s]) if due else room)
                deficit[s] -= give
                left[s] -= give
                room -= give
                while give:
                    i = queues[s][0]
                    n = min(give, sizes[i] - begun[i])
                    yield i, begun[i], n, sequence, offset
                    begun[i] += n
                    give -= n
                    offset += n
                    if begun[i] == sizes[i]:
                        queues[s].popleft()
                if not left[s]:
                    del queues[s]
                if not room:
                    break
        sequence += 1


def _packed(batches: Iterator[pa.RecordBatch], plan: Plan, window: int) -> Iterator[pa.RecordBatch]:
    """Slices, those of a chunk behind one another, to the chunks' pieces."""

    def packed(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        chunk = rows[0]["chunk"]
        flat = lambda name: [x for r in rows for x in r[name]]
        keys, starts, sizes, wholes = flat("ids"), flat("starts"), flat("sizes"), flat("wholes")
        ids, at = np.concatenate([_ids(r["data"]).astype("<u4") for r in rows]), np.concatenate(([0], np.cumsum(sizes)))
        sources = [r["source"] for r in rows for _ in r["ids"]]
        owed = {s: plan.given(s, chunk) - plan.limit(s, chunk) for s in set(sources)}
        out = []
        for i, start, n, sequence, offset in deal(sources, sizes, plan.shares, owed, window):
            a = int(at[i]) + start
            out.append((keys[i], starts[i] + start, n, zlib.crc32(ids[a : a + n].tobytes()), wholes[i], chunk * plan.sequences + sequence, offset))
        for a in range(0, len(out), 50_000):
            yield _batch(out[a : a + 50_000], "id start length ids_crc32 doc_tokens sequence_id offset", [pa.int64()] * 7)

    rows: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if rows and rows[0]["chunk"] != row["chunk"]:
                yield from packed(rows)
                rows = []
            rows.append(row)
    if rows:
        yield from packed(rows)


def _before(parts: DataFrame) -> DataFrame:
    """The tokens of a part's source in the parts before it.

    Sums within 4096 groups of a source's parts, then over the groups, so that no task adds up all parts."""
    sums = parts.select("part", "source", "size", F.substring("part", 1, 3).alias("group"))
    inside = Window.partitionBy("source", "group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows a source at most
    groups = sums.groupBy("source", "group").agg(F.sum("size").alias("n")).select(F.col("source").alias("of"), F.col("group").alias("at"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n"))
    run = sums.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return run.join(groups, run["source"].eqNullSafe(groups["of"]) & (run["group"] == groups["at"])).select("part", (F.col("own") + F.col("n")).alias("before"))


def _queued(held: DataFrame, named: set) -> DataFrame:
    """held with the name of a queue as its source: all sources, if there are at most QUEUES or `named` has them; else
    the largest, by documents, and pools of the others. So plan and totals are bounded whatever the sources are."""
    counted = held.groupBy("source").agg(F.count("*").alias("n"))
    if counted.count() <= QUEUES:
        return held
    own = [r["source"] for r in counted.orderBy(F.desc("n"), "source").limit(QUEUES // 2).collect()]
    kept = F.coalesce(F.col("source").isin([s for s in {*own, *named} if s is not None]), F.lit(None in own))
    pool = F.concat(F.lit("\0pool "), F.pmod(F.xxhash64("source"), F.lit(QUEUES // 2)).cast("string"))
    return held.withColumn("source", F.when(kept, F.col("source")).otherwise(pool))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", source: str = "source", window: int = 4096, end: int = 2, shares: Mapping[str, float] | None = None) -> DataFrame:
    """Pieces of documents in sequences of `window` tokens: the key, start, length, ids_crc32, doc_tokens, sequence_id,
    offset.

    A document's ids are the tokenizer's, then `end`. `shares` are the target proportions of the sources (default:
    their proportions of all tokens, so that no queue runs dry before the others), which hold wherever a source's rows
    are stored: all sources' queues are cut into chunks by prefix sums of their tokens, so that each chunk has what the
    shares give it and is packed without waiting for another. Sources that run dry leave their share to the others;
    sources that `shares` lacks come last. Every id lies in one piece; each chunk leaves one sequence that isn't full.
    Sequence numbers have no gaps as long as sources are fewer than half a window's tokens.

    Null texts are empty documents (one token); a null source is a source of its own; keys aren't looked up, so that
    null and repeated ones do no harm; other columns aren't read; an empty table gives no pieces. Beyond QUEUES
    sources the small ones that `shares` doesn't name share queues, and so their proportions hold together."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    held = _queued(pick(docs, id=key, text=text, source=source).withColumn("source", F.col("source").cast("string")), set(shares or ()))
    parts = scratch.table(held.mapInArrow(lambda b: _parts(b, tokenizer, end, CHUNK), PARTS), "parts")
    totals = {r["source"]: r["n"] for r in parts.groupBy("source").agg(F.sum("size").alias("n")).collect()}  # one row a source
    whole = sum(totals.values()) or 1
    given = dict(shares) if shares is not None else {s: n / whole for s, n in totals.items()}
    scale = sum(given.values()) or 1.0
    plan = Plan(totals, {s: x / scale for s, x in given.items()}, window, CHUNK)
    before = scratch.table(_before(parts), "before")
    slices = parts.join(before, "part").mapInArrow(lambda b: _slices(b, plan), SLICES)
    dealt = slices.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "at")
    pieces = dealt.mapInArrow(lambda b: _packed(b, plan, window), PIECES)
    return pieces.withColumnRenamed("id", key)
