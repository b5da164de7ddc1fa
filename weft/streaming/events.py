"""Activity events: the monotonic gate, debouncing, suppression and dispatch, in batch and as streams."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.schema import EVENTS

#: Milliseconds.
CURSOR_MS, PICK_MS, SUPPRESS_MS = 300, 200, 500


def emit(folder: str, tool: str, target: str, target_type: str) -> None:
    """One event as one file, which appears whole; failures don't reach the caller."""
    try:
        Path(folder).mkdir(parents=True, exist_ok=True)
        row = {"tool": tool, "target": target, "target_type": target_type, "ts_ms": time.time_ns() // 1_000_000}
        part = Path(folder, f".{uuid.uuid4().hex}")
        part.write_text(json.dumps(row))
        part.rename(Path(folder, f"{row['ts_ms']}-{uuid.uuid4().hex}.json"))
    except OSError:
        pass


def stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).json(folder)


def gate(events: DataFrame, ts: str = "ts_ms", order: str = "seq", key: str | None = None) -> DataFrame:
    """Events later than all that arrived before them: duplicates and late ones go.

    The running maximum needs the order of arrival. It is taken inside parts of it first, then over the parts' maxima,
    so that no task sees all events."""
    keys = [key] if key else []
    if key:
        before = F.max(ts).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        return events.withColumn("__m", before).filter(F.col("__m").isNull() | (F.col(ts) > F.col("__m"))).drop("__m")
    from weft.plans.lineage import cut

    parts = cut(events.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    inside = F.max(ts).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    over = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    earlier = parts.groupBy("__part").agg(F.max(ts).alias("__t")).select("__part", F.max("__t").over(over).alias("__e"))
    held = parts.withColumn("__m", inside).join(F.broadcast(earlier), "__part")
    last = F.greatest("__m", "__e")  # null only if there is nothing before
    return held.filter(last.isNull() | (F.col(ts) > last)).drop("__part", "__m", "__e")


def gate_stream(events: DataFrame, ts: str = "ts_ms", order: str | None = None) -> DataFrame:
    """The gate over a stream. There is one slot for all tools: its state is the last time that passed. Rows of a
    micro-batch are taken in order of arrival (`order`, if there is such a column)."""
    schema = events.schema

    def passed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        # Only what is to be sorted is gathered; else batches go through one by one.
        parts = [pd.concat(list(batches)).sort_values(order, kind="stable")] if order else batches
        for rows in parts:
            before = rows[ts].cummax().shift()
            if last is not None:
                before = before.fillna(last).clip(lower=last)
            kept = rows[before.isna() | (rows[ts] > before)]
            if len(kept):
                last = int(kept[ts].iloc[-1])
            yield kept[schema.names]
        if last is not None:
            state.update((last,))

    return events.withColumn("__slot", F.lit(0)).groupBy("__slot").applyInPandasWithState(passed, schema, "last bigint", "append", GroupStateTimeout.NoTimeout)


def debounce(events: DataFrame, value: str, ts: str = "ts", gap: str = "300 milliseconds", keys: tuple[str, ...] = ()) -> DataFrame:
    """The last value before each quiet gap: start, end, n, value. Streams need a watermark on `ts`."""
    grouped = events.groupBy(F.session_window(ts, gap).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n"), F.max_by(value, F.struct(ts, value)).alias(value)).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", value)


def suppressed(events: DataFrame, kind: str = "event_type", click: str = "click", cursor: str = "cursor", ts_ms: str = "ts_ms", keys: tuple[str, ...] = (), window_ms: int = SUPPRESS_MS) -> DataFrame:
    """Without cursor events that come up to `window_ms` after a click (of the same keys).

    Without keys the last click is taken inside ranges of time first, then over the ranges, so that no task sees all
    events."""
    clicked = F.when(F.col(kind) == click, F.col(ts_ms))
    if keys:
        last = F.max(clicked).over(Window.partitionBy(*keys).orderBy(ts_ms).rangeBetween(-window_ms, 0))
        return events.withColumn("__c", last).filter((F.col(kind) != cursor) | F.col("__c").isNull()).drop("__c")
    from weft.plans.lineage import cut

    parts = cut(events.repartitionByRange(ts_ms).withColumn("__part", F.spark_partition_id()))
    inside = F.max(clicked).over(Window.partitionBy("__part").orderBy(ts_ms).rangeBetween(Window.unboundedPreceding, 0))
    over = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    earlier = parts.groupBy("__part").agg(F.max(clicked).alias("__t")).select("__part", F.max("__t").over(over).alias("__e"))
    held = parts.withColumn("__c", inside).join(F.broadcast(earlier), "__part").withColumn("__c", F.greatest("__c", "__e"))
    return held.filter((F.col(kind) != cursor) | F.col("__c").isNull() | (F.col(ts_ms) - F.col("__c") > window_ms)).drop("__part", "__c", "__e")


def dispatch(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events with the node that they light up: a file by its path, others by name, queries none. A stream joins the
    static nodes; of several nodes with a name the first in ord is taken beforehand."""
    files = nodes.filter("type = 'File'").groupBy(F.col("path").alias("target")).agg(F.min_by("id", "ord").alias("__file"))
    short = F.regexp_extract("qualified_name", r"([^:]*)$", 1)
    names = nodes.select(F.explode(F.array_distinct(F.array(F.coalesce("name", F.lit("")), F.coalesce("qualified_name", F.lit("")), F.coalesce(short, F.lit(""))))).alias("target"), "id", "ord")
    named = names.filter("target <> ''").groupBy("target").agg(F.min_by("id", "ord").alias("__name"))
    joined = events.join(files, "target", "left").join(named, "target", "left")
    return joined.withColumn("node_id", F.when(F.col("target_type") == "file", F.col("__file")).when(F.col("target_type").isin("function", "entity"), F.col("__name"))).drop("__file", "__name")
