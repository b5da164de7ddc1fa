"""Scalar expressions of the reference semantics, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by file extension.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cxx": "cpp", ".cc": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".hh": "cpp",
    ".cs": "csharp", ".swift": "swift", ".json": "json", ".md": "markdown", ".mdx": "markdown",
    ".css": "css", ".scss": "css", ".less": "css", ".html": "html", ".htm": "html",
}
#: Path segments that are never walked, and extensions that are.
IGNORED = ("node_modules", ".git", "dist", "build", "__pycache__", ".venv", ".next", "coverage", ".cache")
SUPPORTED = (
    *LANGUAGES,
    ".svg", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".yaml", ".yml", ".toml", ".xml", ".txt",
    ".sh", ".bash", ".zsh", ".bat", ".cmd", ".ps1", ".sql", ".graphql", ".gql", ".proto", ".lock",
)
#: Extensions whose content isn't read.
BINARY = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".lock")


def node_id(kind: Column | str, *parts: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit("::"), *parts)


def segments(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: x != "")


def last_segment(path: Column) -> Column:
    """Also the repository's name, from its path; null for none."""
    return F.try_element_at(segments(path), F.lit(-1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """From the last dot of the name; none for names that begin with their only dot."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def dirname(path: Column) -> Column:
    """Empty for a path of one segment."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def language(path: Column) -> Column:
    ext = extension(path)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, ext), F.lit("other"))


def ignored(path: Column, names: tuple[str, ...] = IGNORED) -> Column:
    return F.arrays_overlap(F.split(path, r"[/\\]"), F.array(*[F.lit(n) for n in names]))


def normalised(path: Column) -> Column:
    """The path without '.', empty segments and resolvable '..'; '.' if nothing is left."""
    up = F.lit("..")
    step = lambda done, x: F.when((x == "") | (x == "."), done).when(
        (x == up) & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != up), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    ).otherwise(F.concat(done, F.array(x)))
    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def prefixes(path: Column) -> Column:
    """All proper prefixes of a path, shortest first."""
    parts = segments(path)
    n = F.size(parts)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def line_count(content: Column) -> Column:
    return F.size(F.split(content, "\n"))


def round3(x: Column) -> Column:
    """To three places, halves upwards."""
    return F.floor(x * 1000 + 0.5) / 1000


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length, added up in double and in order."""
    n = F.least(F.size(a), F.size(b))
    short = lambda x: F.slice(x, F.lit(1), n)
    return F.aggregate(F.zip_with(short(a), short(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def path_of(path: Column, qualified_name: Column) -> Column:
    """A node's path; else its qualified name up to the last ':'."""
    before = F.regexp_extract(qualified_name, r"^(.+):[^:]*$", 1)
    return F.coalesce(path, F.when(before != "", before))
