"""N-gram Jaccard join by token-combination prefixes.

All shingles are ordered by (documents that have them, hash), the rarest first. Two sets that link have their first
common shingle in the prefix of both. If it is rare, it is a key alone. If it is frequent, all common shingles are;
then the prefixes are extended until two neighbouring shingles of both sets must be common, and neighbours are keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import frequencies, kernels
from weft.llm.components import components
from weft.llm.scratch import Scratch, pick, stable

#: Five words a shingle; texts link at 75 % or more.
SHINGLE, NUM, DEN = 5, 75, 100
#: Shingles of so many documents are of the frequent class: keys are pairs of them. Others are keys alone, so that no
#: such key has more classes.
FREQUENT = 16
#: Words of the parity bitmaps by which pairs are ruled out.
WORDS = 8
#: Rows of a key in a chunk, about; keys with more are dealt out.
CHUNK = 2048


def name(tokens: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets are one class."""
    x = kernels.mix(tokens)
    return int((np.bitwise_xor.reduce(x) ^ kernels.mix(np.array([np.sum(x * kernels.WEIGHTS[0]) + np.uint64(len(x))], np.uint64))[0]).astype(np.int64))


def _sets(offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    return kernels.shingles(offsets, data, SHINGLE)


def keys(tokens: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set (its tokens in order of their hashes, with frequencies), each with the least frequency of its
    tokens. Two different sets that link have a key in common.

    At most floor(n / 4) of n tokens aren't common, so the first common one is among floor(n / 4) + 1. Let it be
    frequent: then the r rare ones are among those, all o common ones are frequent (m there are), and of the sets'
    d <= o / 3 differing tokens at most m / 3 - r are frequent. Of the first d + 2 common ones some two have no
    differing token between them: they are neighbours in both sets. d differing ones and those two are within
    reach of the extended prefix."""
    n = len(tokens)
    order = np.lexsort((tokens, often))
    t, f = tokens[order], often[order]
    rare, prefix = int(np.searchsorted(f, FREQUENT)), n // 4 + 1
    out, least = [t[: min(rare, prefix)]], [f[: min(rare, prefix)]]
    m = n - rare
    differ = min(m // 3 - rare, n // 2)
    if m >= 2 and rare < prefix and differ >= 0:
        reach = min(m, differ + 2 + min(n // 4 - rare, differ))
        a, b = t[rare : rare + reach - 1], t[rare + 1 : rare + reach]
        out.append(kernels.mix(a * kernels.WEIGHTS[1] + kernels.mix(b)))
        least.append(f[rare : rare + reach - 1])
    return np.concatenate(out), np.concatenate(least)


def _kept(batch: pa.RecordBatch, own: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of rows what goes with their tokens: id (and whether there is one), row key and class."""
    column = batch.column("id")
    lacks = np.asarray(column.is_null()).astype(np.uint32)
    ids = column.fill_null(0).to_numpy().view(np.uint64)
    return ids, lacks, *[batch.column(c).to_numpy().view(np.uint64) for c in ("row", "row2")], np.array([name(s) if len(s) else 0 for s in own], np.int64).view(np.uint64)


KEYED = "id bigint, row bigint, row2 bigint, n bigint, class bigint, held binary"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their sets' size and class, and the first of each class in a block with what the index needs of it, if
    it shares any key of its own: its keys, and all its tokens that other documents have."""
    block, seen = None, set()
    for at, (ids, lacks, row, row2, cls), sets in frequencies.joined(batches):
        if at != block:
            block, seen = at, set()
        held = []
        for c, (tokens, often) in zip(cls.tolist(), sets, strict=True):
            one = None
            if len(tokens) and c not in seen:
                seen.add(c)
                k, least = keys(tokens, often)
                if (least > 1).any():
                    some = often > 1
                    low = int(often.min())
                    one = frequencies.pack(k[least > 1], least[least > 1], tokens[some], often[some], np.array([low, int((often == low).sum())], np.uint32))
            held.append(one)
        columns = [pa.array(ids.view(np.int64), mask=lacks.astype(bool)), *[pa.array(x.view(np.int64)) for x in (row, row2)], pa.array(np.array([len(t) for t, _ in sets], np.int64)), pa.array(cls.view(np.int64)), pa.array(held, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "row2", "n", "class", "held"])


def _bits(tokens: np.ndarray) -> bytes:
    """Parities of the tokens in each of 64 * WORDS places: sets differ by as many tokens as bits at least."""
    return np.packbits(np.bincount((tokens % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) % 2 == 1).tobytes()


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: index rows of a class, without the keys of tokens that no other class has; kind 1: its own row, with its
    number `u` of such tokens, the other tokens and their bitmap. A class with no index row has neither."""
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            rows: list[tuple] = []
            for c, n, copies, held in zip(*[part.column(x).to_pylist() for x in ("class", "n", "copies", "held")], strict=True):
                own, least, tokens, often, (low, at_low) = frequencies.unpack(held)
                own = np.unique(own[least > copies])
                if not len(own):
                    continue
                u = int(at_low) if int(low) == copies else 0
                others = tokens[often > copies]
                rows.append((np.full(len(own) + 1, c), np.append(own.view(np.int64), 0), n, u, [None] * len(own) + [_bits(others)], [None] * len(own) + [others.tobytes()]))
            if rows:
                sizes = [len(r[1]) for r in rows]
                columns = [pa.array(np.concatenate([r[i] for r in rows])) for i in (0, 1)] + [pa.array(np.repeat(np.array([r[i] for r in rows], np.int32), sizes)) for i in (2, 3)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array([x for r in rows for x in r[i]], pa.binary()) for i in (4, 5)]], names=["class", "key", "n", "u", "bits", "tokens"])


def _can(n: np.ndarray, u: np.ndarray, m: int, v: int, apart: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m can link, of which u and v tokens are in no other class and `apart` or more of the
    rest differ. Linked sets differ by a seventh of their sizes' sum at most."""
    n, u = n.astype(np.int64), u.astype(np.int64)
    room = (DEN - NUM) * (n + m) // (DEN + NUM)
    return (DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)) & (u + v + apart <= room)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and `u`: each class with the first ones of fitting sizes (whose tokens most others have),
    and with the one before it. Leaders of a key are as many as sizes that don't fit each other."""
    key, leaders, before = None, [], None
    for batch in batches:
        a, b = [], []
        for k, c, n, u in zip(*[batch.column(x).to_pylist() for x in ("key", "class", "n", "u")], strict=True):
            if k != key:
                key, leaders, before = k, [], None
            fits = [x for x in leaders if DEN * min(n, x[1]) >= NUM * max(n, x[1])]
            for x in [*fits[:1], *([before] if before and before not in fits[:1] else [])]:
                if DEN * min(n, x[1]) >= NUM * max(n, x[1]) and u + x[2] <= (DEN - NUM) * (n + x[1]) // (DEN + NUM):
                    a.append(min(c, x[0]))
                    b.append(max(c, x[0]))
            if not fits:
                leaders.append((c, n, u))
            before = (c, n, u)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by chunk, those of the chunk itself before those that are compared with all of them: of each of
    the latter the classes of other components that it can link with, as one list."""
    chunk, held, table = None, [], None

    def built() -> tuple:
        cls, n, u, bits, comp, asks = zip(*held, strict=True)
        return np.array(cls, np.int64), np.array(n), np.array(u), np.frombuffer(b"".join(bits), np.uint64).reshape(-1, WORDS), np.array(comp, np.int64), np.array(asks)

    for batch in batches:
        out = []
        for k, salt, c, n, u, bits, comp, asks, turn in zip(*[batch.column(x).to_pylist() for x in ("key", "salt", "class", "n", "u", "bits", "component", "asks", "turn")], strict=True):
            if (k, salt) != chunk:
                chunk, held, table = (k, salt), [], None
            if not turn:
                held.append((c, n, u, bits, comp, asks))
                continue
            if not held:
                continue
            table = built() if table is None else table
            cls, sizes, own, words, comps, asking = table
            differ = np.bitwise_count(words ^ np.frombuffer(bits, np.uint64)).sum(axis=1)
            # Where both ask, the lesser does it for both.
            found = cls[_can(sizes, own, n, u, differ) & (comps != comp) & (~asking | (cls > c))]
            if len(found):
                out.append((c, found.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["class", "others"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of one class, sorted by it, to distinct pairs."""

    def pairs() -> pa.RecordBatch:
        found = np.unique(np.concatenate(lists))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(found, own)), pa.array(np.maximum(found, own))], names=["a", "b"])

    own, lists, size = None, [], 0
    for batch in batches:
        for c, others in zip(batch.column("class").to_pylist(), batch.column("others").to_pylist(), strict=True):
            if c != own:
                if lists:
                    yield pairs()
                own, lists, size = c, [], 0
            lists.append(np.frombuffer(others, np.int64))
            size += len(lists[-1])
            if size > 1 << 20:
                lists = [np.unique(np.concatenate(lists))]
                size = 0
    if lists:
        yield pairs()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by centre: first the centre's own set, then those to compare it with."""
    centre, held, size = None, None, 0
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            a, b = [], []
            for c, salt, other, n, tokens in zip(*[batch.column(x).to_pylist() for x in ("a", "salt", "b", "n", "tokens")], strict=True):
                s = np.frombuffer(tokens, np.uint64)
                if other is None:
                    centre, held, size = (c, salt), s, n
                elif centre == (c, salt):
                    both = np.concatenate((held, s))
                    both.sort(kind="stable")  # two runs
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    if DEN * common >= NUM * (size + n - common):
                        a.append(c)
                        b.append(other)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verify(pairs: DataFrame, sets: DataFrame, scratch: Scratch, step: str) -> DataFrame:
    """Pairs (a, b) that link. Each set travels once for each pair that it is the second of, and as a first once for
    each 512 pairs, so that a class with very many pairs is dealt out."""
    parts = scratch.table(pairs.groupBy("a").agg(F.ceil(F.count("*") / 512).cast("int").alias("parts")), f"parts-{step}")
    firsts = sets.join(parts, F.col("class") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("b"), "n", "tokens")
    salted = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), "b")
    seconds = salted.join(sets, F.col("class") == F.col("b")).select("a", "salt", "b", "n", "tokens")
    both = firsts.unionByName(seconds).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return scratch.table(both.mapInArrow(_verified, "a bigint, b bigint"), f"links-{step}", release=True)


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, text, and two hashes of both, which name a row."""
    held = pick(docs, id=key, text=text).withColumn("id", F.col("id").cast("bigint"))
    return held.withColumns(row_names("id", "text"))


def row_names(key: str, text: str) -> dict[str, Column]:
    return {"row": F.xxhash64(key, text), "row2": F.xxhash64(text, F.lit(1), key)}


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, row, row2 (names of the row by its key and text), n (size of its set), component_id, and first:
    whether the row is the one that stands for its group (of least key, null keys last; rows equal in key and text are
    all first). Rows without shingles have no component_id and are first."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    held = stable(_marked(docs, key, text), scratch)
    keyed = scratch.table(frequencies.exchanged(held, "text", _sets, _kept).mapInArrow(_keyed, KEYED), "keyed", release=True)
    rows = keyed.select("id", "row", "row2", "n", "class")
    place = F.struct(F.col("id").isNull().alias("lacks"), "id", "row", "row2")
    classes = scratch.table(rows.filter("n > 0").groupBy("class").agg(F.count("*").alias("copies"), F.min(place).alias("first")), "classes")
    # A class that occurs in several blocks has equal keys in all of them.
    one = keyed.filter("held IS NOT NULL").select("class", "n", "held").dropDuplicates(["class"]).join(classes.select("class", "copies"), "class")
    indexed = scratch.table(one.mapInArrow(_exploded, "class bigint, key bigint, n int, u int, bits binary, tokens binary"), "indexed")
    index, sets = indexed.filter("bits IS NULL").select("key", "class", "n", "u"), indexed.filter("bits IS NOT NULL").select("class", "n", "u", "bits", "tokens")
    near = index.repartition("key").sortWithinPartitions("key", "u", "n", "class").mapInArrow(_near, "a bigint, b bigint").distinct()
    near = scratch.table(near, "near")
    links = _verify(near, sets, scratch, "near")
    known = scratch.table(components(links, scratch, "first"), "known")
    # Under one key the largest component only answers; all others ask. Large keys are dealt to chunks.
    placed = scratch.table(index.join(known, index["class"] == known["node"], "left").select("key", "class", F.coalesce("component", "class").alias("component")), "placed")
    each = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    several = each.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("c").alias("all"), F.max_by("component", F.struct("c", "component")).alias("largest")).filter("kinds > 1")
    several = scratch.table(several.select("key", "largest", F.ceil(F.col("all") / CHUNK).cast("int").alias("salts")), "several")
    own = sets.select("class", "n", "u", "bits")
    rest = scratch.table(placed.join(several, "key").select("key", "class", "component", "salts", (F.col("component") != F.col("largest")).alias("asks")).join(own, "class"), "rest")
    columns = ["key", "salt", "class", "n", "u", "bits", "component", "asks", "turn"]
    answers = rest.withColumns({"salt": F.pmod(F.xxhash64("class"), F.col("salts")).cast("int"), "turn": F.lit(False)}).select(columns)
    asked = rest.filter("asks").withColumns({"salt": F.explode(F.sequence(F.lit(0), F.col("salts") - 1)), "turn": F.lit(True)}).select(columns)
    lists = answers.unionByName(asked).repartition("key", "salt").sortWithinPartitions("key", "salt", "turn").mapInArrow(_across, "class bigint, others binary")
    apart = lists.repartition("class").sortWithinPartitions("class").mapInArrow(_listed, "a bigint, b bigint")
    more = _verify(scratch.table(apart.join(near, ["a", "b"], "left_anti"), "apart"), sets, scratch, "apart")
    if not more.isEmpty():
        known = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), scratch, "second")
    found = scratch.table(classes.join(known, F.col("class") == F.col("node"), "left").select("class", "first", F.coalesce("component", "class").alias("component")), "found")
    least = scratch.table(found.groupBy("component").agg(F.min("first").alias("least")), "least")
    by_class = scratch.table(found.join(least, "component").select("class", "least"), "by_class")
    full = rows.filter("n > 0").join(by_class, "class").select("id", "row", "row2", "n", F.col("least.id").alias("component_id"), ((F.col("row") == F.col("least.row")) & (F.col("row2") == F.col("least.row2"))).alias("first"))
    return full.unionByName(rows.filter("n = 0").select("id", "row", "row2", "n", F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("first")))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key (a long), n_shingles and component_id, the least key that links reach from it.

    Rows with equal sets are one class before anything is paired. Classes under common index keys are first verified
    along leaders and neighbours, which joins nearly all that belongs together; then those of different components
    under a key are held against each other in chunks, by sizes, tokens of their own and bitmaps of the others, and
    verified where these leave room for a link. So every link of different sets is found or lies within a component
    already, and no group emits all its pairs.

    Null or empty texts have no shingles and are components of their own; a null key is never the least, and its row
    has a null component_id if nothing else is reached. Rows that repeat a key keep their own components. No other
    column of docs is read; an empty table gives no rows. Shingles are compared by 64-bit hashes."""
    found = linked(docs, key, text)
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, with all its columns: that of the least key (null keys last; of equal keys the least by a
    hash), and of rows that repeat it in key and text one. Rows without words are linked with nothing and all stay."""
    own = row_names("__key", text)
    marked = docs.withColumn("__key", F.col(key).cast("bigint")).withColumns({f"__{k}": v for k, v in own.items()})
    worded = F.coalesce(F.col(text), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    kept = linked(docs, key, text).filter("n > 0 AND first").select(F.col("row").alias("__row"), F.col("row2").alias("__row2")).distinct()
    single = marked.filter(worded).join(kept, ["__row", "__row2"], "left_semi").dropDuplicates(["__row", "__row2"])
    return single.select(*docs.columns).unionByName(marked.filter(~worded).select(*docs.columns))
