"""Cutting the lineage of iterative plans, and numbering rows without a single task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def prepared(spark: SparkSession) -> None:
    """Make sure that checkpoints have a folder: the one that spark.checkpoint.dir names. Only a local master, whose
    executors share the driver's disk, may do without it and gets a folder of our own."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """df computed and written to the checkpoint folder, which all executors share."""
    prepared(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, column: str, *order: str) -> DataFrame:
    """df with the row's rank in `order` from 0. Rows are dealt by range, counted by part and numbered inside."""
    dealt = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__inside", inside).join(F.broadcast(starts), "__part").withColumn(column, F.col("__start") + F.col("__inside")).drop("__part", "__start", "__inside")
