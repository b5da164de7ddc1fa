"""Secret scans: patterns, and sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm import kernels
from weft.llm.scratch import extended

#: The patterns of known secrets, by kind; the group that counts and its least length.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("password|passwd|secret|token|api_?key", "(?i:password|passwd|secret|token|api_?key)"), re.ASCII), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
KINDS = [*PATTERNS, "entropy"]

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Character classes, the narrowest first, with the least entropy (bits a character) of a window wholly of the class.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 3.0),
    ("alnum", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 3.7),
    ("base64", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"), 3.9),
)
#: Candidates that are public by their form.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"(?i).*(example|sample|dummy|placeholder|changeme|xxxx).*"),
    re.compile(r"(sha1|sha256|sha384|sha512|md5)[-=_].*"),  # checksums that name themselves
    re.compile(r"(.{1,6})\1{2,}.{0,5}"),  # one short piece again and again
    re.compile(r"[0-9-]{6,}T?[0-9-]*"),  # numbers and dates
    re.compile(r"[A-Za-z][a-z]+([A-Z][a-z]{2,})+"),  # words joined by capitals
)
#: A url after its scheme, up to white space, a quote, comma, semicolon, bracket, angle, bar or backslash; its host and path
#: end at the query, the fragment or '&'. Paths that are credentials themselves name a hook.
URL = re.compile(r"""://([^\s"'`“”‘’«»,;()\[\]{}<>|\\^]*)""")
_AFTER_PATH, _AFTER_HOST, _HOOK = re.compile(r"[?#&]"), re.compile(r"[/?#&]"), re.compile(r"(?i)hook")
_WORD = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+")
_N_LOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]
_CLASS = np.zeros(256, dtype=bool)
_CLASS[[ord(c) for c in CLASSES[-1][1]]] = True


def windows(s: str) -> list[tuple[int, int]]:
    """Maximal spans of s covered by windows with enough entropy for their character class.

    A window without letters is a number or a date, however long: public, as in ALLOW. Nothing but entropy judges the
    others. Counts of the window's characters, letters and class members change by one character in and one out."""
    out: list[tuple[int, int]] = []
    count: dict[str, int] = {}
    total, letters, members = 0.0, 0, [0] * len(CLASSES)
    for i, c in enumerate(s):
        n = count.get(c, 0)
        total += _N_LOG[n + 1] - _N_LOG[n]
        count[c] = n + 1
        letters += c.isalpha()
        for k, (_, own, _) in enumerate(CLASSES):
            members[k] += c in own
        if i >= WINDOW:
            old = s[i - WINDOW]
            n = count[old]
            total += _N_LOG[n - 1] - _N_LOG[n]
            count[old] = n - 1
            letters -= old.isalpha()
            for k, (_, own, _) in enumerate(CLASSES):
                members[k] -= old in own
        if i >= WINDOW - 1 and letters:
            entropy = math.log2(WINDOW) - total / WINDOW
            least = next(least for m, (_, _, least) in zip(members, CLASSES, strict=True) if m == WINDOW)
            if entropy >= least:
                a = i - WINDOW + 1
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((a, i + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of known patterns, in order."""
    return sorted((m.start(), k, m.end()) for k, (pattern, group, least) in enumerate(PATTERNS.values()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least)


def url_paths(text: str) -> list[tuple[int, int]]:
    """Spans of hosts and paths of urls, in order; without user names and passwords, queries, fragments and paths of hooks."""
    out = []
    for m in URL.finditer(text):
        url = m.group(1)
        host_end = e.start() if (e := _AFTER_HOST.search(url)) else len(url)
        a = url.rfind("@", 0, host_end) + 1
        b = e.start() if (e := _AFTER_PATH.search(url, a)) else len(url)
        if _HOOK.search(url, a, b):
            b = host_end
        out.append((m.start(1) + a, m.start(1) + b))
    return out


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: base ones and what else is of high entropy and doesn't stand in the host or path of a
    url."""
    base = base_spans(text)
    more = []
    paths, k = None, 0
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if any(p.fullmatch(s) for p in ALLOW):
            continue
        paths = url_paths(text) if paths is None else paths
        while k < len(paths) and paths[k][1] < m.end():
            k += 1
        if k < len(paths) and paths[k][0] < m.end():  # the candidate ends in it; it may have begun with the '//'
            continue
        for a, b in windows(s):
            more += [(x, len(PATTERNS), y) for x, y in _beside(text, m.start() + a, m.start() + b, base)]
    return base, sorted(base + more)


def _beside(text: str, a: int, b: int, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """A run of high entropy without the base spans in it. What is left beside one, its head or tail, is part of the
    same secret; only separators and a plain word, such as the beginning of the assigned name, are not."""
    touched = False
    for x, _, y in [*base, (b, 0, b)]:
        if y > a and x < b or x == b:
            touched |= x < b
            left, right = a, min(x, b)
            if touched:
                while left < right and text[left] in "_=/+-":
                    left += 1
                while left < right and text[right - 1] in "_=/+-":
                    right -= 1
            own = text[left:right]
            if own and not (touched and (len(own) < 4 or _WORD.fullmatch(own))):
                yield left, right
            a = max(a, y)


def _suspects(batch: pa.RecordBatch, text: str) -> np.ndarray:
    """Rows that can have spans at all: with a candidate run of bytes, 16 of them at least, or with ':' or '='."""
    offsets, data = kernels.utf8(batch.column(text))
    held = np.zeros(len(data) + 2, dtype=np.int8)
    held[1:-1] = _CLASS[data]
    edge = np.diff(held)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = starts[ends - starts >= 16]
    marks = np.flatnonzero((data == 58) | (data == 61))
    out = np.zeros(batch.num_rows, dtype=bool)
    for at in (long, marks):
        out[np.clip(np.searchsorted(offsets, at, side="right") - 1, 0, batch.num_rows - 1)] = True
    # A run may have begun in the row before.
    for a, b in zip(starts[ends - starts >= 16], ends[ends - starts >= 16], strict=True):
        out[np.searchsorted(offsets, a, side="right") - 1 : np.searchsorted(offsets, b, side="left")] = True
    return out


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, text: str = "text", redact: str | None = None) -> DataFrame:
    """docs with n_assign, n_access, n_hex, n_entropy, base_spans, spans ('kind:start:end', comma-joined, in code points).

    With `redact`, each span in the text is replaced by it (overlapping ones by one). Null text has no spans and stays
    null; empty text likewise; rows are judged one by one, so that repeated ones get equal results; columns of docs
    with our names are replaced."""
    own = ["n_assign", "n_access", "n_hex", "n_entropy", "base_spans", "spans"]
    held = docs.drop(*own)
    schema = extended(held, **dict(zip(own, ["bigint"] * 4 + ["string"] * 2, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.slices(batches, text, 8 << 20):
            n = batch.num_rows
            counts = np.zeros((4, n), dtype=np.int64)
            said = [[""] * n, [""] * n]
            texts = batch.column(text)
            changed: dict[int, str] = {}
            for i in np.flatnonzero(_suspects(batch, text)):
                t = texts[int(i)].as_py()
                if t is None:
                    continue
                base, every = spans(t)
                for _, k, _ in every:
                    counts[k, i] += 1
                said[0][i], said[1][i] = _joined(base), _joined(every)
                if redact is not None and every:
                    parts, at = [], 0
                    for a, _, b in every:
                        if a >= at:
                            parts += [t[at:a], redact]
                        at = max(at, b)
                    changed[int(i)] = "".join(parts) + t[at:]
            columns = list(batch.columns)
            if changed:
                values = texts.to_pylist()
                for i, t in changed.items():
                    values[i] = t
                columns[batch.schema.get_field_index(text)] = pa.array(values, type=texts.type)
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c) for c in counts], *[pa.array(x) for x in said]], names=schema.names)

    return held.mapInArrow(run, schema)

