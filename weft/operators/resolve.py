"""Imports to files: candidates in order, the first that exists wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.scalars import dirname, normalised

#: Endings that are tried, by language.
ENDINGS = {
    "python": (".py", "/__init__.py"),
    "c": (".c", ".h", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"),
    "cpp": (".cpp", ".cxx", ".cc", ".hpp", ".hxx", ".hh", ".h", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"),
    "other": (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"),
}


def candidates(specifier: Column, path: Column, language: Column) -> Column:
    """Paths that an import may mean, the preferred first."""
    base = normalised(F.concat(dirname(path), F.when(dirname(path) == "", "").otherwise("/"), F.regexp_replace(specifier, "^/+", "")))
    tried = lambda kind, exact: F.concat(*([F.array(base)] if exact else []), F.array(*[F.concat(base, F.lit(e)) for e in ENDINGS[kind]]))
    # A dot is the package itself, each further one a folder up; the rest is a path of names.
    dots = F.length(F.regexp_extract(specifier, r"^(\.*)", 1))
    names = F.translate(F.regexp_replace(specifier, r"^\.+", ""), ".", "/")
    folder = F.when(dirname(path) == "", F.lit(".")).otherwise(dirname(path))
    module = normalised(F.concat(folder, F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0))), F.lit("/"), names))
    python = F.when(dots > 0, F.array(*[F.concat(module, F.lit(e)) for e in ENDINGS["python"]])).otherwise(F.array().cast("array<string>"))
    return F.when(language == "python", python).when(language == "c", tried("c", True)).when(language == "cpp", tried("cpp", True)).otherwise(tried("other", True))


def first_existing(wanted: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """wanted (keys, repo, candidates) with resolved: the first candidate among paths (repo, path), or null."""
    each = wanted.select(*keys, "repo", F.posexplode("candidates").alias("pos", "path"))
    hits = each.join(paths.select("repo", "path").distinct(), ["repo", "path"])
    best = hits.groupBy("repo", *keys).agg(F.min_by("path", "pos").alias("resolved"))
    return wanted.join(best, ["repo", *keys], "left")


def resolve_imports(parsed: DataFrame) -> DataFrame:
    """Parsed files with resolvedPath in their imports; external ones and those without a file keep null."""
    each = parsed.select("repo", "path", "language", F.posexplode("imports").alias("k", "i"))
    wanted = each.filter("NOT i.isExternal").select("repo", F.col("path").alias("from"), "k", candidates(F.col("i.specifier"), F.col("path"), F.col("language")).alias("candidates"))
    found = first_existing(wanted, parsed.select("repo", "path"), ["from", "k"]).filter("resolved IS NOT NULL")
    lists = found.groupBy("repo", F.col("from").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("k", "resolved"))).alias("__resolved"))
    joined = parsed.join(lists, ["repo", "path"], "left")
    with_path = F.transform("imports", lambda i, k: i.withField("resolvedPath", F.when(~i["isExternal"], F.try_element_at(F.col("__resolved"), k))))
    return joined.withColumn("imports", with_path).drop("__resolved").select(parsed.columns)
