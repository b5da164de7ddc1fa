"""Scan of source repositories as a Python data source.

    spark.dataSource.register(RepositorySource)
    spark.read.format("repository").option("paths", "/src/a,/src/b").load()

Directories are partitions, opened level by level until there are enough of them; loose files of one are another. Ignored directories are pruned
before they are entered, extensions tested before files are read, and contents of binary kinds never read. Roots must be
on storage that all executors see."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weft.functions.scalars import BINARY, IGNORED, LANGUAGES, SUPPORTED
from weft.schema import FILES

#: Partitions that a scan is divided into, if there are as many directories.
PARTS = 256


@dataclass(frozen=True)
class Config:
    """What is walked. Relative paths with a segment in `ignore`, or with another extension, are left out."""

    ignore: tuple[str, ...] = IGNORED
    extensions: tuple[str, ...] = SUPPORTED
    data_dir: str | None = None
    repo_path: str | None = None
    data_file: str | None = None
    embeddings_file: str | None = None
    model_cache: str | None = None

    @classmethod
    def load(cls, **overrides) -> Config:
        """Defaults, then the environment (WEFT_DATA_DIR, WEFT_REPO_PATH, WEFT_DATA_FILE, WEFT_EMBEDDINGS_FILE,
        WEFT_MODEL_CACHE), then overrides; the repository is else the working folder."""
        names = ("data_dir", "repo_path", "data_file", "embeddings_file", "model_cache")
        return cls(**{"repo_path": os.getcwd(), **{n: v for n in names if (v := os.environ.get(f"WEFT_{n.upper()}"))}, **overrides})

    def _within(self, kind: str) -> str:
        return default_paths(self.data_dir, "")[kind] if self.data_dir else default_paths(self.repo_path or ".")[kind]

    def graph(self) -> str:
        return self.data_file or self._within("graph")

    def vectors(self) -> str:
        return self.embeddings_file or self._within("vectors")

    def models(self) -> str:
        return self.model_cache or os.path.join(os.path.dirname(self.graph()), "model-cache")


def default_paths(workspace: str, folder: str = ".weft") -> dict[str, str]:
    """Where a workspace keeps its graph and vectors."""
    return {"graph": os.path.join(workspace, folder, "graph.json"), "vectors": os.path.join(workspace, folder, "embeddings.json")}


def repo_name(path: str) -> str:
    return [x for x in path.replace("\\", "/").split("/") if x][-1] if path.strip("/\\") else ""


def _extension(name: str) -> str:
    dot = name.rfind(".")
    return name[dot:] if dot > 0 else ""


def _rows(root: str, below: str, names: list[str] | None, config: Config) -> Iterator[tuple]:
    """Files of a directory (or those named), then of its directories, each in order of name; what can't be read and
    what is neither a file nor a directory is passed over."""
    if names is None:
        try:
            names = sorted(os.listdir(os.path.join(root, below)))
        except OSError:
            return
    for name in names:
        path = os.path.join(below, name) if below else name
        full = os.path.join(root, path)
        if os.path.basename(name) in config.ignore or os.path.islink(full):
            continue
        if os.path.isdir(full):
            yield from _rows(root, path, None, config)
            continue
        ext = _extension(os.path.basename(name))
        if ext not in config.extensions or not os.path.isfile(full):
            continue
        try:
            size = os.stat(full).st_size
            content = ""
            if ext not in BINARY:
                with open(full, encoding="utf-8", errors="replace", newline="") as f:
                    content = f.read()
        except OSError:
            continue
        yield repo_name(root), path.replace(os.sep, "/"), full, LANGUAGES.get(ext, "other"), size, content


class _Part(InputPartition):
    def __init__(self, root: str, names: list[str] | None):
        self.root, self.names = root, names


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], config: Config):
        self.roots, self.config = roots, config

    def partitions(self) -> list[InputPartition]:
        """Folders with their loose files, and folders below them: the largest are opened level by level until there are
        `PARTS`, so that a repository with a single top folder is read by many tasks as well."""
        parts, level = [], [(root, "") for root in self.roots]
        while level and len(parts) + len(level) < PARTS:
            below = []
            for root, at in level:
                try:
                    names = sorted(n for n in os.listdir(os.path.join(root, at)) if n not in self.config.ignore)
                except OSError:
                    continue
                full = lambda n, root=root, at=at: os.path.join(root, at, n)
                folders = {n for n in names if os.path.isdir(full(n)) and not os.path.islink(full(n))}
                below += [(root, os.path.join(at, n) if at else n) for n in names if n in folders]
                loose = [n for n in names if n not in folders]
                if loose:
                    parts.append(_Part(root, [os.path.join(at, n) if at else n for n in loose]))
            level = below
        parts += [_Part(root, [at]) for root, at in level if at]
        if level and not all(at for _, at in level):
            parts += [_Part(root, None) for root, at in level if not at]
        return parts or [_Part("", [])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition.root:
            yield from _rows(partition.root, "", partition.names, self.config)


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self):
        return FILES

    def reader(self, schema) -> DataSourceReader:
        pick = lambda key, default: tuple(x for x in self.options.get(key, "").split(",") if x) or default
        return _Reader([p for p in self.options.get("paths", "").split(",") if p], Config(pick("ignore", IGNORED), pick("extensions", SUPPORTED)))


def walk(spark: SparkSession, *roots: str, config: Config | None = None) -> DataFrame:
    """FILES rows of repositories."""
    config = config or Config.load()
    spark.dataSource.register(RepositorySource)
    read = spark.read.format("repository").option("paths", ",".join(os.path.abspath(r) for r in roots))
    return read.option("ignore", ",".join(config.ignore)).option("extensions", ",".join(config.extensions)).load()
