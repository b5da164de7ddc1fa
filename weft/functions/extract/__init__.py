"""Extraction of declarations from source files: a registry by language, and the operator over files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weft.functions.extract.cfamily import extract_c, extract_cpp, extract_csharp, extract_swift
from weft.functions.extract.python import extract as extract_python
from weft.functions.extract.script import extract as extract_script
from weft.schema import PARSED

EXTRACTORS: dict[str, Callable[[str], dict]] = {
    "typescript": extract_script,
    "javascript": extract_script,
    "python": extract_python,
    "c": extract_c,
    "cpp": extract_cpp,
    "csharp": extract_csharp,
    "swift": extract_swift,
}
_LISTS = ("functions", "classes", "interfaces", "variables", "imports", "exports")


def extract_text(language: str, content: str) -> dict:
    """The lists of one source; empty ones for languages without an extractor."""
    make = EXTRACTORS.get(language)
    return make(content) if make else {name: [] for name in _LISTS}


def extract(files: DataFrame) -> DataFrame:
    """PARSED rows of FILES rows. Sizes and line counts are computed by Spark, lists in Python; a file whose extractor
    fails keeps its row with empty lists and the error. Files that are placed already (`build.placed`) keep their rank."""
    rank = [c for c in ("file",) if c in files.columns]
    schema = StructType(PARSED.fields + [StructField(c, LongType()) for c in rank])
    code = F.col("language").isin(*EXTRACTORS)
    text = F.coalesce("content", F.lit(""))
    lines = F.size(F.split(text, "\n"))
    sized = files.select(
        "repo", "path", "language", *rank,
        F.when(code, F.octet_length(text)).otherwise(0).cast("bigint").alias("size"),
        F.when(code | (text != ""), lines).otherwise(0).cast("int").alias("lineCount"),
        F.when(code, text).alias("content"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                found, error = {name: [] for name in _LISTS}, None
                if row.content is not None:
                    try:
                        found = extract_text(row.language, row.content)
                    except Exception as e:  # noqa: BLE001  one bad file doesn't end the scan
                        error = f"{type(e).__name__}: {e}"
                rows.append({"repo": row.repo, "path": row.path, "language": row.language, "size": row.size, "lineCount": row.lineCount, **found, "error": error, **{c: getattr(row, c) for c in rank}})
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return sized.mapInPandas(run, schema)


def diagnostics(parsed: DataFrame) -> DataFrame:
    """language, passed, failed."""
    return parsed.groupBy("language").agg(F.count_if(F.col("error").isNull()).alias("passed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
