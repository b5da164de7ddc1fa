"""Node descriptions, embedders and exact vector search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.scalars import dot, round3
from weft.operators.search import checked

DIMENSIONS, BATCH, SEARCH_K = 384, 32, 10
#: Node types that are embedded.
EMBEDDED = ("Function", "Class", "Interface", "File", "Community")
MEMBERS = 20


def _names(pairs: DataFrame, key: str, column: str, most: int | None = None) -> DataFrame:
    """(id, column): names joined in the order of the edges, the first `most` only."""
    if most is not None:
        pairs = pairs.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).filter(F.col("__r") <= most)
    listed = F.array_sort(F.collect_list(F.struct("ord", "name")))
    return pairs.groupBy(F.col(key).alias("id")).agg(F.array_join(F.transform(listed, lambda x: x["name"]), ", ").alias(column))


def descriptions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, type, text) of every node: its template with the names around it."""
    names = nodes.select("id", "name", F.col("type").alias("kind"))
    out = edges.select("src", "dst", "type", "ord").join(names.withColumnRenamed("id", "dst"), "dst")
    contains = out.filter("type = 'CONTAINS'")
    methods = _names(out.filter("type = 'HAS_METHOD'"), "src", "methods")
    functions = _names(contains.filter("kind = 'Function'"), "src", "functions")
    classes = _names(contains.filter("kind = 'Class'"), "src", "classes")
    imports = _names(out.filter("type IN ('IMPORTS', 'IMPORTS_EXTERNAL')"), "src", "imports")
    into = edges.filter("type = 'BELONGS_TO_COMMUNITY'").select("src", "dst", "ord").join(names.select(F.col("id").alias("src"), "name"), "src")
    members = _names(into.select("dst", "name", F.struct("ord", "src").alias("ord")), "dst", "members", MEMBERS)
    counts = into.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    joined = nodes
    for part in (methods, functions, classes, imports, members, counts):
        joined = joined.join(part, "id", "left")
    c = lambda name, default="": F.coalesce(F.col(name).cast("string"), F.lit(default))
    kind = F.col("type")
    text = (
        F.when(kind == "Function", F.concat(F.lit("function "), c("name"), F.lit(" ("), c("parameters"), F.lit("): "), c("return_type", "void"), F.lit(" in "), c("path")))
        .when(kind == "Class", F.concat(F.lit("class "), c("name"), F.lit(" methods: "), c("methods"), F.lit(" in "), c("path")))
        .when(kind == "Interface", F.concat(F.lit("interface "), c("name"), F.lit(" in "), c("path")))
        .when(kind == "File", F.concat(F.lit("file "), c("name"), F.lit(" ("), c("language"), F.lit(") contains: "), c("functions"), F.lit(", "), c("classes"), F.lit(" imports: "), c("imports")))
        .when(kind == "Community", F.concat(F.lit("code community: "), c("members"), F.lit(" ("), F.coalesce("member_count", "n", F.lit(0)).cast("string"), F.lit(" members)")))
        .otherwise(F.concat(kind, F.lit(" "), c("name"), F.lit(" in "), c("path")))
    )
    return joined.select("id", "type", text.alias("text"))


class Embedder(Protocol):
    """What turns texts into unit vectors; made once a worker by its factory."""

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class Service:
    """An embedder that is made when it is first needed. A failure is kept and reported, and making it is tried again
    at the next call, as a model may have been fetched meanwhile."""

    def __init__(self, make):
        self.make, self.error, self._made = make, None, None

    def initialize(self) -> dict:
        """{ok} or {ok, error}."""
        if self._made is None:
            try:
                self._made, self.error = self.make(), None
            except Exception as e:  # noqa: BLE001  any failure to load is a state of the service
                self.error = f"{type(e).__name__}: {e}"
        return {"ok": True} if self.ready else {"ok": False, "error": self.error}

    @property
    def ready(self) -> bool:
        return self._made is not None

    def embedder(self) -> Embedder:
        if not self.initialize()["ok"]:
            raise RuntimeError(f"the embedding model isn't loaded: {self.error}")
        return self._made


class HashingEmbedder:
    """Signed feature hashing of words and of their trigrams, to unit length: lexical likeness, not meaning. It stands
    in where no model is at hand."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def _features(self, text: str) -> Iterator[tuple[str, float]]:
        for word in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\W\d_a-zA-Z]+", text):
            word = word.lower()
            yield word, 1.0
            padded = f"^{word}$"
            for i in range(len(padded) - 2):
                yield padded[i : i + 3], 0.3

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), dtype=np.float64)
        for row, text in enumerate(texts):
            for feature, weight in self._features(text):
                h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
                out[row, h % self.dimensions] += weight if h >> 63 else -weight
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).astype(np.float32)


def embed_texts(rows: DataFrame, make=HashingEmbedder, text: str = "text") -> DataFrame:
    """rows with an `embedding`; the embedder is made once a task, texts go to it in batches."""

    @F.pandas_udf("array<float>")
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for batch in batches:
            texts = batch.fillna("").tolist()
            parts = [embedder.embed(texts[i : i + BATCH]) for i in range(0, len(texts), BATCH)]
            yield pd.Series([v.tolist() for part in parts for v in part])

    return rows.withColumn("embedding", embedded(F.col(text)))


def generate(nodes: DataFrame, edges: DataFrame, make=HashingEmbedder) -> DataFrame:
    """VECTORS of the embedded node types."""
    texts = descriptions(nodes, edges).filter(F.col("type").isin(*EMBEDDED)).select("id", "text")
    return embed_texts(texts, make).select("id", "text", "embedding")


def add(store: DataFrame, new: DataFrame) -> DataFrame:
    """A store with rows added or replaced by id; of ids that repeat in `new` one row counts, the greatest by its text."""
    rest = [c for c in new.columns if c != "id"]
    once = new.groupBy("id").agg(F.max(F.struct(*rest)).alias("row")).select("id", *[F.col("row")[c].alias(c) for c in rest]).select(*new.columns)
    return store.join(once.select("id"), "id", "left_anti").unionByName(once)


def remove(store: DataFrame, ids: Sequence[str]) -> DataFrame:
    return store.filter(~F.col("id").isin(*ids)) if ids else store


def similarity(vector: Sequence[float], column: str = "embedding") -> Column:
    return dot(F.col(column), F.array(*[F.lit(float(x)) for x in vector]))


def search(store: DataFrame, vector: Sequence[float], k: int = SEARCH_K) -> DataFrame:
    """id, text, score: the k rows with the greatest dot product, exactly; ties by id. Tasks keep their own best k."""
    return store.select("id", "text", similarity(vector).alias("score")).orderBy(F.desc("score"), "id").limit(checked(k))


def semantic_search(store: DataFrame, nodes: DataFrame, query: str, k: int = SEARCH_K, embedder: Embedder | None = None) -> DataFrame:
    """Search by a text, with the nodes' attributes where they still exist and the score to three places."""
    vector = (embedder or HashingEmbedder()).embed([query])[0]
    found = search(store, [float(x) for x in vector], k)
    about = nodes.select("id", "type", "name", "qualified_name")
    return found.join(about, "id", "left").select("id", "type", "name", "qualified_name", "text", round3(F.col("score")).alias("score"))
