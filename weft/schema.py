"""The tables of the engine: parsed files, nodes, edges, memberships, vectors, events."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

_SIMPLE = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "boolean": BooleanType(), "float": FloatType(), "double": DoubleType()}


def _type(text: str) -> DataType:
    text = text.strip()
    if text.startswith("array<"):
        return ArrayType(_type(text[6:-1]))
    return struct(text[7:-1]) if text.startswith("struct<") else _SIMPLE[text]


def struct(text: str) -> StructType:
    """A schema from 'name type, ...' or 'name: type, ...', without a session."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(text[at:i].strip())
            at = i + 1
    named = [p.replace(":", " ", 1).split(None, 1) if ":" in p.split("<")[0] else p.split(None, 1) for p in parts]
    return StructType([StructField(name, _type(kind)) for name, kind in named])


_FUNCTION = "name: string, parameters: string, returnType: string, startLine: int, endLine: int, isExported: boolean, isAsync: boolean, kind: string, calls: array<string>"
PARSED = struct(
    "repo string, path string, language string, size bigint, lineCount int, "
    f"functions array<struct<{_FUNCTION}>>, "
    f"classes array<struct<name: string, startLine: int, endLine: int, isExported: boolean, isAbstract: boolean, superClass: string, interfaces: array<string>, methods: array<struct<{_FUNCTION}>>>>, "
    "interfaces array<struct<name: string, startLine: int, endLine: int, isExported: boolean>>, "
    "variables array<struct<name: string, type: string, isExported: boolean, startLine: int, kind: string>>, "
    "imports array<struct<specifier: string, names: array<string>, isDefault: boolean, isExternal: boolean, resolvedPath: string>>, "
    "exports array<struct<name: string, isDefault: boolean, kind: string>>, error string"
)
NODES = struct(
    "id string, type string, name string, qualified_name string, repo string, path string, extension string, language string, line_count int, size bigint, "
    "start_line int, end_line int, is_exported boolean, is_async boolean, is_abstract boolean, kind string, parameters string, return_type string, community_id string, "
    "level int, member_count int, ord bigint"
)
EDGES = struct("src string, dst string, type string, specifier string, is_default boolean, names array<string>, count bigint, repo string, ord bigint")
FILES = struct("repo string, path string, absolute_path string, language string, size bigint, content string")
MEMBERSHIP = struct("node_id string, level int, community_id string")
VECTORS = struct("id string, text string, embedding array<float>")
EVENTS = struct("tool string, target string, target_type string, ts_ms bigint")

#: Order of the phases in which nodes are made: ord = phase * PHASE + file * FILE + item.
PHASE, FILE = 10**17, 10**8
PHASES = {"File": 0, "Function": 1, "Class": 2, "Interface": 3, "Module": 4, "Folder": 5, "Community": 6}
NODE_TYPES = tuple(PHASES)
EDGE_TYPES = ("CONTAINS", "HAS_METHOD", "IMPORTS", "IMPORTS_EXTERNAL", "CALLS", "EXTENDS", "CONTAINS_FILE", "CONTAINS_FOLDER", "BELONGS_TO_COMMUNITY", "PARENT_COMMUNITY")
COMMUNITY_EDGES = ("BELONGS_TO_COMMUNITY", "PARENT_COMMUNITY")
