"""Graph and vector snapshots: Parquet tables by repository, and JSON for exchange."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from weft.schema import EDGES, NODES, VECTORS, struct

#: Names of attributes in exchanged JSON, where they differ from the columns.
_CAMEL = {
    "qualified_name": "qualifiedName", "line_count": "lineCount", "start_line": "startLine", "end_line": "endLine", "is_exported": "isExported", "is_async": "isAsync",
    "is_abstract": "isAbstract", "return_type": "returnType", "community_id": "communityId", "member_count": "memberCount", "is_default": "isDefault",
}
_KINDS = {f.name: f.dataType.simpleString() for f in [*NODES.fields, *EDGES.fields]}


def _attributes(names: list[str]) -> str:
    return ", ".join(f"{_CAMEL.get(n, n)}: {_KINDS[n]}" for n in names)


_NODE_NAMES = [n for n in NODES.fieldNames() if n not in ("id", "ord")]
_EDGE_NAMES = [n for n in EDGES.fieldNames() if n not in ("src", "dst", "ord", "repo")]
SNAPSHOT = struct(f"nodes array<struct<key: string, attributes: struct<{_attributes(_NODE_NAMES)}>>>, edges array<struct<source: string, target: string, attributes: struct<{_attributes(_EDGE_NAMES)}>>>")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two tables, partitioned by repository; only the repositories at hand are replaced."""
    for df, name in ((nodes, "nodes"), (edges, "edges")):
        held = df.withColumn("repo_part", F.coalesce("repo", F.lit("")))
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_part").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """None if there is no graph."""
    try:
        return tuple(spark.read.schema(s).parquet(f"{path}/{name}").select(s.fieldNames()) for s, name in ((NODES, "nodes"), (EDGES, "edges")))
    except AnalysisException:
        return None


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Nodes and edges of an exchanged snapshot, in its order; None if it is missing or no such JSON."""
    try:
        raw = spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path)
        if raw.filter("nodes IS NOT NULL").isEmpty():
            return None
    except Exception:  # noqa: BLE001  a snapshot that can't be read counts as none
        return None
    value = lambda row, n: F.col(f"{row}.attributes.{_CAMEL.get(n, n)}").alias(n)
    n = raw.select(F.posexplode("nodes").alias("ord", "x"))
    nodes = n.select(F.col("x.key").alias("id"), *[value("x", c) for c in _NODE_NAMES], F.col("ord").cast("bigint").alias("ord"))
    e = raw.select(F.posexplode("edges").alias("ord", "x"))
    edges = e.select(F.col("x.source").alias("src"), F.col("x.target").alias("dst"), *[value("x", c) for c in _EDGE_NAMES], F.lit(None).cast("string").alias("repo"), F.col("ord").cast("bigint").alias("ord"))
    return nodes.select(NODES.fieldNames()), edges.select(EDGES.fieldNames())


def _json_rows(df: DataFrame, names: list[str], ends: dict[str, str]) -> Iterator[str]:
    """Rows as JSON in order, streamed partition by partition to the driver."""
    shown = F.to_json(F.struct(*[F.col(c).alias(k) for k, c in ends.items()], F.struct(*[F.col(n).alias(_CAMEL.get(n, n)) for n in names]).alias("attributes")))
    for row in df.orderBy("ord").select(shown.alias("j")).toLocalIterator():
        yield row["j"]


def export_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON file for exchange with other tools, written beside and then moved into place."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.part", "w") as f:
        f.write('{"attributes": {}, "options": {"type": "directed", "multi": false, "allowSelfLoops": false}, "nodes": [')
        f.write(",\n".join(_json_rows(nodes, _NODE_NAMES, {"key": "id"})))
        f.write('], "edges": [')
        f.write(",\n".join(_json_rows(edges, _EDGE_NAMES, {"source": "src", "target": "dst"})))
        f.write("]}")
    os.replace(f"{path}.part", path)


@F.pandas_udf(ArrayType(FloatType()))
def from_base64(values: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return values.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), "<f4").tolist())


@F.pandas_udf(StringType())
def to_base64(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())


def save_vectors(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(VECTORS).parquet(path)
    except AnalysisException:
        return None


def import_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """VECTORS of a JSON object id -> {text, embedding in base64}; None if missing or broken."""
    try:
        held = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<text:string,embedding:string>>", {"mode": "FAILFAST"}).alias("m"))
        if held.filter("m IS NOT NULL").isEmpty():
            return None
    except Exception:  # noqa: BLE001  a store that can't be read counts as none
        return None
    return held.select(F.explode("m").alias("id", "v")).select("id", "v.text", from_base64("v.embedding").alias("embedding"))


def export_vectors(store: DataFrame, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    rows = store.select("id", "text", to_base64("embedding").alias("e")).orderBy("id").toLocalIterator()
    with open(f"{path}.part", "w") as f:
        f.write("{" + ",\n".join(f"{json.dumps(r['id'])}: {json.dumps({'text': r['text'], 'embedding': r['e']})}" for r in rows) + "}")
    os.replace(f"{path}.part", path)


def json_rows(df: DataFrame) -> list[dict]:
    """Few rows as dictionaries."""
    return [json.loads(r["j"]) for r in df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("j")).collect()]


def as_json(df: DataFrame) -> str:
    """A result as text: pretty JSON of all its rows, fetched partition by partition, or a line that there is none."""
    found = df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("j"))
    rows = [json.loads(r["j"]) for r in found.toLocalIterator()]
    return json.dumps(rows, indent=2, ensure_ascii=False) if rows else "No results found."
