"""Graph views over the driver's tables: parts as functions and files, orders as what links them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.schema import EDGES, NODES

REPO = "warehouse"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(df: DataFrame, schema, **values: Column) -> DataFrame:
    return df.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def part_nodes(spark: SparkSession, sf_dir: str, kind: str = "Function") -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    more = {"path": key, "language": F.col("p_brand"), "line_count": F.col("p_size")} if kind == "File" else {"parameters": F.concat(F.lit("("), "p_type", F.lit(")"))}
    return typed(
        p, NODES, id=F.concat(F.lit(f"{kind}::"), key), type=F.lit(kind), name=F.col("p_name"), qualified_name=F.concat_ws(":", "p_brand", "p_name"), repo=F.lit(REPO),
        start_line=F.col("p_size"), end_line=F.col("p_size") + 10, ord=F.col("p_partkey"), **more,
    )


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, d): parts next to each other among an order's lines."""
    lines = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    pairs = lines.select(F.col("l_partkey").alias("s"), F.lead("l_partkey").over(w).alias("d"))
    return pairs.filter("d IS NOT NULL AND s <> d").distinct()


def part_edges(spark: SparkSession, sf_dir: str, kind: str = "CALLS", ends: str = "Function") -> DataFrame:
    e = part_pairs(spark, sf_dir)
    at = lambda c: F.concat(F.lit(f"{ends}::"), F.col(c).cast("string"))
    return typed(e, EDGES, src=at("s"), dst=at("d"), type=F.lit(kind), repo=F.lit(REPO), ord=F.col("s") * 10_000_000 + F.col("d"))


def place_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as folders, nations as files, customers as functions and suppliers as classes."""
    r, n, c, s = (table(spark, sf_dir, x) for x in ("region", "nation", "customer", "supplier"))
    node = lambda df, kind, key, name, base, **more: typed(df, NODES, id=F.concat(F.lit(f"{kind}::"), F.col(key).cast("string")), type=F.lit(kind), name=F.col(name), repo=F.lit(REPO), ord=F.lit(base).cast("bigint") + F.col(key), **more)
    folders = node(r, "Folder", "r_regionkey", "r_name", 5 * 10**12, path=F.col("r_name"))
    files = node(n, "File", "n_nationkey", "n_name", 0, path=F.col("n_name"), language=F.lower(F.substring("n_name", 1, 2)), line_count=F.length("n_name"))
    functions = node(c, "Function", "c_custkey", "c_name", 10**12, qualified_name=F.concat_ws(":", F.col("c_nationkey").cast("string"), "c_name"), parameters=F.concat(F.lit("("), "c_mktsegment", F.lit(")")))
    classes = node(s, "Class", "s_suppkey", "s_name", 2 * 10**12, qualified_name=F.concat_ws(":", F.col("s_nationkey").cast("string"), "s_name"))
    return folders.unionByName(files).unionByName(functions).unionByName(classes)


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c, s = (table(spark, sf_dir, x) for x in ("nation", "customer", "supplier"))
    at = lambda kind, key: F.concat(F.lit(f"{kind}::"), F.col(key).cast("string"))
    a = typed(n, EDGES, src=at("Folder", "n_regionkey"), dst=at("File", "n_nationkey"), type=F.lit("CONTAINS_FILE"), repo=F.lit(REPO), ord=F.col("n_nationkey").cast("bigint"))
    b = typed(c, EDGES, src=at("File", "c_nationkey"), dst=at("Function", "c_custkey"), type=F.lit("CONTAINS"), repo=F.lit(REPO), ord=F.col("c_custkey") + 10**12)
    d = typed(s, EDGES, src=at("File", "s_nationkey"), dst=at("Class", "s_suppkey"), type=F.lit("CONTAINS"), repo=F.lit(REPO), ord=F.col("s_suppkey") + 2 * 10**12)
    return a.unionByName(b).unionByName(d)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: repo, path 'source/lang/id', language, file (rank), with their text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.lit(REPO).alias("repo"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), F.col("doc_id").alias("file"), "text")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, k, href): links of pages in order."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("k", "href"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in communities: by nation (level 0), and by market segment (level 1)."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("Function::"), F.col("c_custkey").cast("string")).alias("node_id"), "c_nationkey", "c_mktsegment")
    low = c.select("node_id", F.lit(0).alias("level"), F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("community_id"))
    return low.unionByName(c.select("node_id", F.lit(1).alias("level"), F.concat(F.lit("segment"), "c_mktsegment").alias("community_id")))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FILES rows: a small source for each part, in the language of its key."""
    p = table(spark, sf_dir, "part")
    k, other = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 7).cast("string")
    text = lambda t: F.concat(*[F.lit(x) if i % 2 == 0 else (k if x == "K" else other) for i, x in enumerate(t)])
    body = {
        0: ("python", ".py", ["import os\n\n\ndef fn_", "K", "(a, b):\n    # call_0()\n    return call_", "O", "(a)\n"]),
        1: ("typescript", ".ts", ['import { x } from "pkg";\n\nexport function fn_', "K", "(a: string): number {\n  // skip()\n  return call_", "O", "(a);\n}\n"]),
        2: ("c", ".c", ["#include <stdio.h>\n\nint fn_", "K", "(int a) {\n  /* skip() */\n  return call_", "O", "(a);\n}\n"]),
        3: ("cpp", ".cpp", ["#include <vector>\n\nint fn_", "K", "(int a) {\n  // skip()\n  return call_", "O", "(a);\n}\n"]),
        4: ("swift", ".swift", ["import Foundation\n\npublic func fn_", "K", "(a: Int) -> Int {\n  // skip()\n  return call_", "O", "(a)\n}\n"]),
        5: ("javascript", ".js", ['import x from "pkg";\n\nfunction fn_', "K", "(a) {\n  // skip()\n  return call_", "O", "(a);\n}\n"]),
    }
    slot = F.col("p_partkey") % 6
    pick = lambda f: F.coalesce(*[F.when(slot == i, f(b)) for i, b in body.items()])
    content = pick(lambda b: text(b[2]))
    path = F.concat(F.lit("src/m"), other, F.lit("/f"), k, pick(lambda b: F.lit(b[1])))
    return p.select(F.lit(REPO).alias("repo"), path.alias("path"), F.lit(None).cast("string").alias("absolute_path"), pick(lambda b: F.lit(b[0])).alias("language"), F.octet_length(content).cast("bigint").alias("size"), content.alias("content"))


def class_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FILES rows: a source with a class for each customer, in TypeScript, C# or Python. It extends the class of the
    customer twelve before, whose file is beside it, or one that isn't there."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"))
    k, base = F.col("n").cast("string"), F.when(F.col("n") >= 12, (F.col("n") - 12).cast("string")).otherwise("x")
    ts = """import { Item_P } from "./cP";
import fs from "fs";

export interface Shape_K { size: number; }

export const limit_K: number = 5;

export class Item_K extends Item_P implements Shape_K {
  async load(path: string): Promise<void> {
    helper_K(path);
  }
  stop(): number { return 1; }
}

export default function make_K(a: number): Item_K {
  return build(a);
}
"""
    cs = """using System;

public interface IItem_K { void Run(); }

public abstract class Item_K : Item_P, IItem_K {
    public void Run() { Helper_K(); }
    private int Count(int a) { return a; }
}
"""
    py = """from .cP import Item_P
import os

LIMIT_K = 3

class Item_K(Item_P):
    def run(self, a):
        return helper_K(a)

    async def stop(self):
        pass
"""
    kinds = (("typescript", ".ts", ts), ("csharp", ".cs", cs), ("python", ".py", py))
    filled = lambda text: F.replace(F.replace(F.lit(text.replace("cP", "c<P>").replace("_P", "_<P>").replace("_K", "_<K>")), F.lit("<K>"), k), F.lit("<P>"), base)
    pick = lambda f: F.coalesce(*[F.when(F.col("n") % 3 == i, f(kind)) for i, kind in enumerate(kinds)])
    content = pick(lambda x: filled(x[2]))
    path = F.concat(F.lit("lib/m"), (F.col("n") % 4).cast("string"), F.lit("/c"), k, pick(lambda x: F.lit(x[1])))
    return c.select(F.lit(REPO).alias("repo"), path.alias("path"), F.lit(None).cast("string").alias("absolute_path"), pick(lambda x: F.lit(x[0])).alias("language"), F.octet_length(content).cast("bigint").alias("size"), content.alias("content"))
