"""Document fingerprints: I-Match over randomised subsets of a lexicon."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import kernels
from weft.llm.scratch import extended, partitions, pick

#: Document frequencies of lexicon terms, as parts of all documents: from neither too rare nor too common.
LEAST, MOST = 1e-3, 0.2
#: Independent nestings of subsets, and their depth: subset (f, j) keeps 2**-j of the lexicon. Of each nesting a text
#: is signed by the subsets that keep about four of its terms or fewer; larger ones would differ at any edit.
FAMILIES, DEPTH = 12, 20
#: Bytes of a signature: no two different ones of any corpus are taken for equal.
SIGNATURE = 16
_SEEDS = np.array([0xC2B2AE3D27D4EB4F * (2 * f + 1) & (1 << 64) - 1 for f in range(FAMILIES)], dtype=np.uint64)
_FLUSH = 2 << 20


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents that have it), added up over some MB of text."""

    def flush() -> pa.RecordBatch:
        terms, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])

    held, size = [], 0
    for batch in kernels.slices(batches, "text"):
        h, row, _, _ = kernels.words(*kernels.utf8(batch.column("text")))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        if len(h):
            held.append(h[np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))])
            size += len(held[-1])
        if size >= _FLUSH:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Hashes of the terms in the band of document frequencies, sorted.

    A term of it is in `least` of the documents, so there are at most (mean distinct terms of a document) / least of
    them: the lexicon's size doesn't grow with the corpus. Frequencies are counted over all documents."""
    held = pick(docs, text=text)
    n = held.count()
    counts = held.mapInArrow(_counts, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    kept = counts.filter((F.col("n") >= F.lit(max(1.0, least * n))) & (F.col("n") <= F.lit(max(1.0, most * n)))).select("term")
    found = kept.toArrow().column("term").to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


class Signer:
    """Signatures of texts under a lexicon."""

    def __init__(self, lexicon: np.ndarray):
        self.lexicon = lexicon
        self.near = np.zeros(1 << 20, dtype=bool)
        self.near[(lexicon >> np.uint64(44)).astype(np.int64)] = True

    def _in_band(self, h: np.ndarray) -> np.ndarray:
        out = self.near[(h >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.lexicon, h[at]), len(self.lexicon) - 1)
            out[at] = self.lexicon[place] == h[at]
        return out

    def __call__(self, texts: list[str]) -> list[dict[str, str]]:
        """Signatures of each text. One without a term of the lexicon is signed by all its terms."""
        h, row, _, _ = kernels.words(*kernels.utf8(pa.array(texts, pa.large_string())))
        ends = np.cumsum(np.bincount(row, minlength=len(texts))) if len(row) else np.zeros(len(texts), np.int64)
        band = self._in_band(h) if len(self.lexicon) else np.zeros(len(h), dtype=bool)
        out, a = [], 0
        for b in ends:
            own = h[a:b][band[a:b]]
            out.append(sign(np.unique(own if len(own) else h[a:b])))
            a = b
        return out


def sign(terms: np.ndarray) -> dict[str, str]:
    """Signatures by the name of the subset; terms are sorted and distinct. 'n' has their number, '' is of all."""
    one = lambda x: hashlib.blake2b(x.tobytes(), digest_size=SIGNATURE).hexdigest()
    out = {"n": str(len(terms))}
    if not len(terms):
        return out
    out[""] = one(terms)
    low = max(1, len(terms).bit_length() - 2)
    mixed = kernels.mix(terms[None, :] ^ _SEEDS[:, None])
    inside = mixed & np.uint64((1 << low) - 1) == 0
    for f in np.flatnonzero(inside.any(axis=1)).tolist():
        own, bits = terms[inside[f]], mixed[f][inside[f]]
        j = low
        while len(own) and j < DEPTH:
            out[f"{f}.{j}"] = one(own)
            j += 1
            deeper = bits & np.uint64((1 << j) - 1) == 0
            own, bits = own[deeper], bits[deeper]
    return out


def likeness(a: dict[str, str], b: dict[str, str]) -> float:
    """1 for equal term sets, else equal signatures among those that either has at the levels that both sign."""
    if a.get("") == b.get(""):
        return 1.0
    low = max(1, max(int(a["n"]), int(b["n"])).bit_length() - 2)
    names = {k for x in (a, b) for k in x if "." in k and int(k.partition(".")[2]) >= low}
    return sum(a.get(k) == b.get(k) for k in names) / len(names) if names else 0.0


def said(signatures: dict[str, str]) -> str:
    return ",".join(f"{k}:{v}" for k, v in signatures.items())


def fingerprint(docs: DataFrame, text: str = "text", terms: np.ndarray | None = None) -> DataFrame:
    """docs with `fingerprint`: one signature a subset, equal for equal texts. Null text counts as empty."""
    terms = lexicon(docs, text) if terms is None else terms
    held = docs.drop("fingerprint")
    schema = extended(held, fingerprint="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(terms)
        for batch in kernels.slices(batches, text):
            signed = signer([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([said(s) for s in signed])], names=schema.names)

    return held.mapInArrow(run, schema)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for batch in kernels.slices(batches, "text", 8 << 20):
        raw = [z.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "place", "tie")], pa.array(raw, pa.binary())], names=["id", "place", "tie", "data"])


OUT = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and place, each bucket ended by the first row of the next one."""
    signer, z = Signer(terms), zstandard.ZstdDecompressor()
    bucket, last = None, None
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            texts = [z.decompress(x).decode() for x in part.column("data").to_pylist()]
            signed = signer(texts)
            pairs = []
            for b, tail, key, t, s in zip(part.column("bucket").to_pylist(), part.column("tail").to_pylist(), part.column("id").to_pylist(), texts, signed, strict=True):
                if b != bucket:
                    bucket, last = b, None
                if last is not None:
                    pairs.append((*last, t, s))
                # Of rows that are equal in id at the next bucket's head the first counts.
                last = None if tail else (key, t, s)
            if not pairs:
                continue
            edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, _, after, _ in pairs]
            changed = signer(edited)
            columns = [
                pa.array([p[0] for p in pairs], pa.int64()),
                pa.array([len(p[1]) for p in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array([said(p[2]) for p in pairs]),
                pa.array([said(c) for c in changed]),
                pa.array([likeness(p[2], c) for p, c in zip(pairs, changed, strict=True)], pa.float64()),
                pa.array([likeness(p[2], p[4]) for p in pairs], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in OUT.split(", ")])


def against_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: fingerprints of its text and of its edited text, whose last half is the next row's beginning, with
    likenesses of the first to the second and to the next row's. Next is by descending key, null keys last, rows of
    one key by a hash of the text; after the last comes the first, which for a single row is itself.

    Rows are dealt to buckets of keys, and those of a key that fills buckets alone to buckets by the hash of their
    texts; the head of each is also sent to the bucket before it, so that no task sees all rows. The driver holds the
    buckets' bounds and heads. Rows equal in key and text stay together. An empty table gives no rows."""
    spark = docs.sparkSession
    terms = lexicon(docs, text)
    held = pick(docs, id=key, text=text).withColumns({"place": F.coalesce(F.col("id").cast("bigint"), F.lit(-(1 << 63))), "tie": F.xxhash64("text")})
    n = partitions(spark)
    places = held.select("place")
    bounds = sorted(set(places.select(F.col("place").cast("double").alias("p")).approxQuantile("p", [i / n for i in range(1, n)], 0.1 / n) or []))
    array = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs]) if xs else F.array().cast("array<bigint>")
    # Keys with more rows than a bucket should have (as many as buckets at most) have buckets of their own.
    most = max(1, places.count() // n)
    hot = {r["place"]: -(-r["c"] // most) for r in places.groupBy("place").agg(F.count("*").alias("c")).filter(F.col("c") > most).collect()}
    above = lambda xs: F.size(F.filter(array(xs), lambda x: x > F.col("place"))).cast("long")
    parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast("long") for k in hot.items() for x in k]), F.col("place")), F.lit(0)) if hot else F.lit(0)
    part = F.floor(F.shiftrightunsigned(F.col("tie").bitwiseXOR(F.lit(-(1 << 63))), 32) * parts / F.lit(1 << 32))
    bucket = F.shiftleft(above(bounds), 42) + F.shiftleft(2 * above(hot) + F.when(parts > 0, 1).otherwise(0), 21) + part
    small = held.mapInArrow(_small, "id bigint, place bigint, tie bigint, data binary").withColumn("bucket", bucket)
    first = F.max(F.struct(F.col("place"), F.bitwise_not("tie").alias("tie")))
    heads = {r["bucket"]: (r["h"]["place"], ~r["h"]["tie"]) for r in held.groupBy(bucket.alias("bucket")).agg(first.alias("h")).collect()}
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    # One row a bucket: its first row, and the bucket that its head is also sent to.
    sent = spark.createDataFrame([(b, *heads[b], before[b]) for b in order], "bucket bigint, head bigint, head_tie bigint, before bigint")
    placed = small.join(F.broadcast(sent), "bucket")
    here = F.struct(F.col("bucket"), F.lit(0).alias("tail"))
    there = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("tail"))
    to = F.explode(F.when((F.col("place") == F.col("head")) & (F.col("tie") == F.col("head_tie")), F.array(here, there)).otherwise(F.array(here)))
    dealt = placed.withColumn("to", to).select("to.bucket", "to.tail", "id", "place", "tie", "data")
    dealt = dealt.repartition(max(1, n), "bucket").sortWithinPartitions("bucket", "tail", F.desc("place"), "tie")
    return dealt.select("bucket", "tail", "id", "data").mapInArrow(lambda b: _compared(b, terms), OUT).withColumnRenamed("id", key)
