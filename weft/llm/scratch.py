"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local master, whose executors share the driver's disk (tests), may do
    without it and gets a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written by one run of an operator. A written table cuts the lineage and outlives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{folder(spark)}/weft/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, release: bool = False) -> DataFrame:
        """df, written and reread. With `release`, where large shuffles are behind it, their files go: Spark deletes them
        when the driver collects its garbage, which may be long after."""
        path, schema = f"{self.root}/{name}", df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if release:
            del df
            for pause in (0.2, 0):  # what the listeners still hold goes with the second
                gc.collect()
                self.spark._jvm.System.gc()
                time.sleep(pause)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Nodes of plans that give the same rows in the same partitions and order whenever they run.
_PLAIN = ("Scan parquet", "ColumnarToRow", "Project", "Filter", "WholeStageCodegen", "InputAdapter")


def stable(df: DataFrame, scratch: Scratch, name: str = "rows") -> DataFrame:
    """df, if it is a plain scan of Parquet, which gives the same partitions whenever it is read; else as a table."""

    def plain(node) -> bool:
        if not node.nodeName().startswith(_PLAIN):
            return False
        expressions, below = node.expressions(), node.children()
        return all(expressions.apply(i).deterministic() for i in range(expressions.size())) and all(plain(below.apply(i)) for i in range(below.size()))

    return df if plain(df._jdf.queryExecution().sparkPlan()) else scratch.table(df, name)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under our own names, so that extra or clashing columns don't matter."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def extended(df: DataFrame, **columns: str) -> StructType:
    """The schema of df with more columns."""
    return StructType([*df.schema.fields, *[StructField(name, DataType.fromDDL(kind)) for name, kind in columns.items()]])
