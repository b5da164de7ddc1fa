"""Sharding by extendible hashing: the directory is indexed by leading bits of a row's hash, and only buckets beyond
the byte limit split on one more bit, until every shard fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.scratch import Scratch

#: Bits of the hash: so many of the key, then as many of the text.
HALF = 31
BITS = 2 * HALF


def _above(prefix: Column, bits: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", prefix, F.lit(bits) if isinstance(bits, int) else bits)


def hashed(key: Column, text: Column) -> Column:
    """The 62 bits that the directory is indexed by, the leading ones first."""
    low = F.lit((1 << HALF) - 1).cast("long")
    return F.shiftleft(F.xxhash64(key).bitwiseAND(low), HALF).bitwiseOR(F.xxhash64(text, F.lit(1)).bitwiseAND(low))


def _leaves(levels: DataFrame, limit: int, top: int) -> DataFrame:
    """Buckets that fit below one that doesn't: the shards among these levels."""
    fits = (F.col("b") <= limit) | (F.col("n") == 1)
    over = levels.filter(~fits).select((F.col("d") + 1).alias("d"), F.col("p").alias("above"))
    below = levels.filter(fits & (F.col("d") > top)).withColumn("above", F.shiftrightunsigned("p", 1)).join(over, ["d", "above"], "left_semi")
    first = levels.filter(fits & (F.col("d") == top)) if top == 0 else levels.filter(F.lit(False))
    return below.select("d", "p", "b").unionByName(first.select("d", "p", "b"))


def _counted_off(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Rows that are equal in key and text, in parts that fit. Each task numbers its own from where the tasks before it
    end, so that no task sees a whole group and all parts but the last are full."""
    tail = scratch.table(rows.withColumn("__task", F.spark_partition_id()), "tail")
    number = F.row_number().over(Window.partitionBy("__h", "__task").orderBy("__b")) - 1
    tasks = tail.groupBy("__h", "__task").agg(F.count("*").alias("__n"), F.sum("__b").alias("__all"))
    before = Window.partitionBy("__h").orderBy("__task")  # a row a task
    starts = tasks.select("__h", "__task", (F.sum("__n").over(before) - F.col("__n")).alias("__start"), F.sum("__all").over(Window.partitionBy("__h")).alias("__s"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("__b", F.lit(1))))
    numbered = tail.withColumn("__number", number).join(starts, ["__h", "__task"])
    part = F.floor((F.col("__start") + F.col("__number")) / each).cast("string")
    return numbered.withColumns({"__name": F.concat(F.lit(f"{BITS}:"), F.col("__h").cast("string"), F.lit("+"), part), "__d": F.lit(BITS)}).drop("__task", "__number", "__start")


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 4 << 20) -> DataFrame:
    """docs with shard_id ('depth:prefix'), shard_depth, row_bytes and shard_bytes.

    Rows are placed by a hash of the key and, within a key, of the text, so that a hot key splits as well. Rows equal
    in both are counted off in parts that fit ('62:prefix+part', shard_bytes then of all parts). Beyond the limit is
    a shard of a single row at most. A null key or text hashes like any other value; null text has 0 bytes; an empty
    table gives no rows; other columns stay, and of clashing names ours win.

    The texts' sizes are read in one pass that counts buckets at a depth set by the total; all shallower levels follow
    from these counts, and so does the leaf of each bucket at that depth, by which a row finds its shard in one join.
    Further passes take only the rows of buckets that are still too large."""
    scratch = Scratch(docs.sparkSession, "shards")
    own = {"__h": hashed(docs[key], docs[text]), "__b": F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long")}
    rows, depth = docs.withColumns(own).drop("shard_id", "shard_depth", "row_bytes", "shard_bytes"), 0
    total = rows.agg(F.sum("__b").alias("b")).first()["b"] or 0
    step = (total // limit).bit_length() + 3
    out = None
    while True:
        fine = min(depth + step, BITS)
        at = _above(F.col("__h"), BITS - fine)
        counted = scratch.table(rows.groupBy(at.alias("f")).agg(F.sum("__b").alias("b"), F.count("*").alias("n")), f"counted{depth}")
        each = counted.withColumn("d", F.explode(F.sequence(F.lit(depth), F.lit(fine)))).withColumn("p", _above(F.col("f"), F.lit(fine) - F.col("d")))
        levels = scratch.table(each.groupBy("d", "p").agg(F.sum("b").alias("b"), F.sum("n").alias("n")), f"levels{depth}")
        leaves = _leaves(levels, limit, depth).withColumnRenamed("b", "__s")
        found = scratch.table(each.select("f", "d", "p").join(leaves, ["d", "p"]).select(F.col("f").alias("__f"), F.col("d").alias("__d"), F.col("p").alias("__p"), "__s"), f"directory{depth}")
        rows = rows.withColumn("__f", at)
        name = F.concat_ws(":", F.col("__d").cast("string"), F.col("__p").cast("string"))
        placed = rows.join(found, "__f").withColumn("__name", name).drop("__f", "__p")
        out = placed if out is None else out.unionByName(placed)
        left = levels.filter((F.col("b") > limit) & (F.col("n") > 1) & (F.col("d") == fine)).select(F.col("p").alias("__f"))
        if left.isEmpty():
            break
        rows, depth = rows.join(left, "__f", "left_semi").drop("__f"), fine
        if depth == BITS:
            out = out.unionByName(_counted_off(rows, limit, scratch))
            break
    return out.withColumns({"shard_id": F.col("__name"), "shard_depth": F.col("__d").cast("int"), "row_bytes": F.col("__b"), "shard_bytes": F.col("__s")}).drop("__h", "__d", "__b", "__s", "__name")
