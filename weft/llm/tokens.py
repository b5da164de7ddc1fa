"""Tokenizers held by each Python worker, and texts cut where no token can cross.

A place is a stable boundary for a tokenizer if the tokens of a text are those of its two sides, whatever stands
around. Encoding then needs each distinct piece between stable boundaries once.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections import ChainMap
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from weft.llm import kernels

#: Pieces that a worker remembers, and the longest piece that it does; beyond, the memory starts anew.
MOST_PIECES, LONGEST = 600_000, 64

_held: dict = {}
_DOUBLE, _SINGLE = re.compile(r" \s|\s "), re.compile(r"(?<=\S) (?=\S)")


def held(key: tuple, make: Callable):
    """One object of a kind in each worker process."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def library(path: str):
    """The tokenizer of a .json file (tokenizers), a .model file (sentencepiece) or a .tiktoken file (tiktoken)."""

    def make():
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            return t
        if path.endswith(".model"):
            import sentencepiece

            return sentencepiece.SentencePieceProcessor(model_file=path)
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return held(("library", path), make)


#: Text of these characters alone can be pre-tokenized here: ASCII, and Latin letters that no normalisation changes.
_PLAIN = re.compile(r"[\t\n\x0b\f\r -~À-ÖØ-öø-ÿ]*")
#: The patterns that the two kinds of .json files split by, over these characters.
_BYTE_LEVEL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+", re.ASCII)
_WORD_ENDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+", re.ASCII)
_SAMPLES = ("hello world, it's 1234 o'clock!?", " Été à la plage: 12%\n\n  Über-groß; señor", "a\tb  c (x)... don't WE'RE", "...'s", " x")
#: Beside these, what is cut into segments.
_PLAIN_SAMPLES = ("", *_SAMPLES, "IT'S 'stuff' x'y 5's a5b\u00c0\u00df\u00ff\u00e0!\u00ed'", "\u00dcber\t\v\f\rwe'll'd''ve 'm9 #1.5e-3", " \n ")


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level models have for each byte: its own where it is printable Latin-1, else
    the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words:
    """Ids of short pieces of text by a .json tokenizer. Plain pieces are split here and go to the library's model word
    by word, each distinct word once; all others, and all pieces of tokenizers of other forms, go to the library whole.
    """

    def __init__(self, path: str):
        import json

        with open(path) as f:
            spec = json.load(f)
        self.whole, self.words = library(path), {}
        self.special = [t["content"] for t in spec["added_tokens"]]
        normalizer = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]]) if n]
        splitter = spec["pre_tokenizer"] or {}
        kinds = [x["type"] for x in splitter.get("pretokenizers", [splitter])]
        self.lower, self.pattern = "Lowercase" in normalizer, None
        if not normalizer and kinds == ["ByteLevel"]:
            self.pattern = _BYTE_LEVEL
        elif normalizer == ["NFC", "Replace", "Lowercase"] and kinds == ["Split", "ByteLevel"]:
            self.pattern = _WORD_ENDS
        self.map = _byte_characters()
        self.before = " " if self.pattern is _BYTE_LEVEL else ""  # what a word may begin with
        # The short way holds only where it gives what the library does.
        if self.pattern and any(array("I", self.plain(t)).tolist() != self.whole.encode(t, add_special_tokens=False).ids for t in _SAMPLES):
            self.pattern = None

    def word(self, word: str) -> bytes:
        """The ids of a pre-token."""
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= MOST_PIECES // 6:
                self.words.clear()
            shown = word if word.isascii() and word.isalpha() else "".join([self.map[b] for b in word.encode()])
            ids = self.words[word] = array("I", [t.id for t in self.whole.model.tokenize(shown)]).tobytes()
        return ids

    def plain(self, text: str) -> bytes:
        text = text.lower() if self.lower else text
        # Most pieces are a word, or a word and a mark.
        if text.lstrip(self.before).isalpha() and len(text) < 1000 and text[1:2] != " ":
            return self.word(text)
        return b"".join([self.word(w) for w in self.pattern.findall(text)])

    def __call__(self, pieces: list[str]) -> list[bytes]:
        if self.pattern:
            whole = "\n".join(pieces)
            if _PLAIN.fullmatch(whole) and not any(s in whole for s in self.special):
                return [self.plain(p) for p in pieces]
        out: list = [None] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            if self.pattern and len(p) < 1000 and _PLAIN.fullmatch(p) and not any(s in p for s in self.special):
                out[i] = self.plain(p)
            else:
                rest.append(i)
        for i, e in zip(rest, self.whole.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False) if rest else [], strict=True):
            out[i] = array("I", e.ids).tobytes()
        return out


def encode_bytes(path: str, pieces: list[str]) -> list[bytes]:
    """Ids of each piece as 32-bit numbers."""
    if path.endswith(".json"):
        return held(("words", path), lambda: Words(path))(pieces)
    return [array("I", ids).tobytes() for ids in encode(path, pieces)]


def encode(path: str, pieces: list[str]) -> list[list[int]]:
    """Ids of each piece, as the library gives them by default, without begin, end or added special tokens."""
    if path.endswith(".json"):
        return [array("I", x).tolist() for x in encode_bytes(path, pieces)]
    t = library(path)
    if path.endswith(".model"):
        return t.encode(pieces, num_threads=1)
    return [t.encode_ordinary(p) for p in pieces]


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: 0 in no plain text, 1 white space, 2 a letter's, 3 an apostrophe, 4 another mark or digit; and what
    lower case makes of it. Plain letters beyond ASCII are two bytes, 0xC3 and one that says which."""
    kind, lower = np.zeros(256, np.uint8), kernels.LOWER.copy()
    kind[33:127] = 4
    kind[kernels.SPACE] = 1
    kind[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 2
    kind[[0x97, 0xB7]] = 0  # the signs for times and divided by
    kind[ord("'")] = 3
    lower[0x80:0x9F] += 32
    return kind, lower


_KIND, _LOWER = _byte_classes()


class Texts:
    """Ids of whole texts, by tokenizers that drop white space.

    Of the form with `_WORD_ENDS`, plain texts are cut at white space, where letters end, and where letters begin unless
    an apostrophe stands before them: no match of the pattern has a letter before something else, only one that begins
    with an apostrophe has one behind, and matches look at nothing around them. So each distinct segment in a column is
    encoded once, and the texts' ids are taken from these by place. All other texts are cut at spaces, and so are all
    texts of tokenizers of other forms."""

    def __init__(self, path: str):
        self.path, self.words = path, held(("words", path), lambda: Words(path)) if path.endswith(".json") else None
        self.pieces, self.segments = Memory(lambda pieces: encode_bytes(path, pieces)), Memory(self._segments)
        self.short = self.words is not None and self.words.pattern is _WORD_ENDS
        # The short way holds only where it gives what the library does.
        if self.short and self._plain(*kernels.utf8(pa.array(_PLAIN_SAMPLES))) != [array("I", self.words.whole.encode(t, add_special_tokens=False).ids).tobytes() for t in _PLAIN_SAMPLES]:
            self.short = False

    def __call__(self, column: pa.Array) -> list[bytes]:
        """The ids of each text as 32-bit numbers; null counts as empty."""
        if not self.short:
            return self._cut(column.to_pylist())
        offsets, data = kernels.utf8(column)
        plain = self._is_plain(offsets, data)
        if plain.all():
            return self._plain(offsets, data)
        one = iter(self._plain(*kernels.utf8(column.filter(pa.array(plain)))))
        other = iter(self._cut(column.filter(pa.array(~plain)).to_pylist()))
        return [next(one if p else other) for p in plain.tolist()]

    def _cut(self, texts: list[str | None]) -> list[bytes]:
        cut = [split_spaces(t or "") for t in texts]
        known = self.pieces([p for pieces in cut for p in pieces])
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def _is_plain(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Which texts are plain and have no special string (in either case)."""
        odd = np.flatnonzero(_KIND[data] == 0)
        out = np.ones(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, odd, side="right") - 1] = False
        low = _LOWER[data].tobytes()
        special = [s.encode().lower() for s in self.words.special]
        if any(s in low for s in special):
            out &= [not any(s in low[a:b] for s in special) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return out

    def _plain(self, offsets: np.ndarray, data: np.ndarray) -> list[bytes]:
        # A space before each text, so that no segment crosses texts.
        n = len(offsets) - 1
        kind = np.insert(_KIND[data], offsets[:-1], 1)
        low = np.insert(_LOWER[data], offsets[:-1], 32)
        letter, solid = kind == 2, kind != 1
        first = np.zeros(len(kind), bool)
        first[1:] = solid[1:] & (~solid[:-1] | (letter[1:] != letter[:-1]) & ~(letter[1:] & (kind[:-1] == 3)))
        starts = np.flatnonzero(first)
        last = solid.copy()
        last[:-1] &= first[1:] | ~solid[1:]
        ends = np.zeros(len(starts) + 1, np.int64)  # without white space
        np.cumsum(np.flatnonzero(last) + 1 - starts, out=ends[1:])
        strings = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[solid])])
        del kind, low, letter, solid, first, last
        found = strings.dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.segments(distinct)
        ids = pa.array(list(map(known.__getitem__, distinct)), pa.large_binary()).take(found.indices)
        if not len(ids):
            return [b""] * n
        at = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        cuts = at[np.searchsorted(starts, np.append(offsets[:-1] + np.arange(n), len(data) + n))].tolist()
        raw = memoryview(ids.buffers()[2])
        return [bytes(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _segments(self, segments: list[str]) -> list[bytes]:
        """Ids of segments; those of letters alone are one word."""
        words, tokenize = self.words, self.words.whole.model.tokenize
        shown = "\n".join(segments).encode().decode("latin-1")
        for c in set(shown) - {"\n"}:
            if words.map[ord(c)] != c:
                shown = shown.replace(c, words.map[ord(c)])
        out = []
        for segment, s in zip(segments, shown.split("\n"), strict=True):
            if segment.isalpha():
                out.append(array("I", [t.id for t in tokenize(s)]).tobytes())
            elif len(segment) <= LONGEST:
                out.append(words.plain(segment))
            else:
                out.append(array("I", words.whole.encode(segment, add_special_tokens=False).ids).tobytes())
        return out


def split_words(text: str) -> list[str]:
    """text cut before each single space between two other characters that aren't white space.

    A byte-level pattern takes such a space into the token that follows, so no pre-token crosses the cut, and none on
    either side looks past it: the only look-ahead asks whether white space is followed by more, and begins at white
    space. Joined, the pieces are the text."""
    if not text:
        return []
    parts = text.split(" ")
    if _DOUBLE.search(text) or not parts[0] or not parts[-1]:
        parts = _SINGLE.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]]


def split_spaces(text: str) -> list[str]:
    """text cut at spaces and line ends, for tokenizers that drop white space; the pieces have none of both."""
    return [p for p in text.replace("\n", " ").split(" ") if p]


#: Characters that must lie between a common boundary and the ends of what was encoded, besides special strings.
MARGIN = 8


class Encoded:
    """A chunk's encoding: its number of tokens, and where its pre-tokens begin, as offsets in the whole text with the
    tokens before them."""

    def __init__(self, start: int, end: int, total: int, starts: np.ndarray, before: np.ndarray):
        self.start, self.end, self.total, self.starts, self.before = start, end, total, starts, before

    def at(self, place: int) -> int:
        """The tokens before a boundary; 0 before the chunk's start."""
        return int(self.before[np.searchsorted(self.starts, place)]) if place > self.start else 0


class Encoder:
    """Encodings of chunks by a library, with offsets.

    A boundary is proven where a pre-token begins in both of two overlapping chunks, more than `margin` characters from
    the one's end and the other's start. Pre-tokens are found from left to right, each from where it begins and with a
    look-ahead that is shorter than the margin (or runs to the end of white space, which is then no boundary). So the
    left chunk has the whole text's pre-tokens up to there, and the right one has them from there on. Special strings
    that cross the place would be seen whole by both. Merges stay inside pre-tokens.

    A .json file's pieces between single spaces are encoded once and remembered, and begin with a pre-token each; of
    pieces without such spaces the library itself says where pre-tokens begin. A .model file is taken whole, if no piece
    of its vocabulary goes on with white space behind anything else: then a piece that begins with white space is a
    boundary. Other .model files have none."""

    def __init__(self, path: str):
        self.path, self.library, self.margin = path, library(path), MARGIN
        if path.endswith(".model"):
            names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
            self.proven = not any(re.search("[^\u2581]\u2581", n) for n in names)
        else:
            self.memory = held(("counts", path), lambda: Memory(lambda pieces: [len(x) // 4 for x in encode_bytes(path, pieces)]))
            if path.endswith(".json"):
                self.margin += max([len(t.content) for t in self.library.get_added_tokens_decoder().values()], default=0)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of texts that need no chunks."""
        if self.path.endswith(".model"):
            return [len(x) for x in encode(self.path, texts)]
        cut = [split_words(t) for t in texts]
        known = self.memory([p for pieces in cut for p in pieces])
        return [sum(map(known.__getitem__, pieces)) for pieces in cut]

    def __call__(self, text: str, start: int, end: int) -> Encoded:
        own = text[start:end]
        if self.path.endswith(".model"):
            pieces = self.library.encode(own, return_type="proto").pieces
            # Offsets are of bytes.
            raw = np.frombuffer(own.encode(), np.uint8)
            place = np.concatenate(([0], np.cumsum(raw & 0xC0 != 0x80)))
            first = [(int(place[p.begin]), i) for i, p in enumerate(pieces) if self.proven and p.piece.startswith("\u2581")]
            first = [(p, i) for p, i in first if own[p : p + 1] == " " and own[p - 1 : p].strip()]
            return Encoded(start, end, len(pieces), np.array([start + p for p, _ in first], np.int64), np.array([i for _, i in first], np.int64))
        pieces = split_words(own)
        known = self.memory(pieces)
        n = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        ends, before = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))), np.cumsum(n)
        starts, earlier = [start + ends - np.fromiter(map(len, pieces), np.int64, len(pieces))], [before - n]
        if self.path.endswith(".json"):
            for k in np.flatnonzero(np.diff(ends, prepend=0) > LONGEST).tolist():
                e = self.library.encode(pieces[k], add_special_tokens=False)
                words = e.word_ids
                inner = [i for i in range(1, len(words)) if words[i] is not None and words[i] != words[i - 1]]
                # Offsets leave out the white space that a pre-token begins with, if the library trims it.
                places = [e.offsets[i - 1][1] for i in inner]
                some = [(p, i) for p, i in zip(places, inner, strict=True) if e.offsets[i][0] == p]
                base = int(starts[0][k])
                starts.append(np.array([base + p for p, _ in some], np.int64))
                earlier.append(np.array([int(earlier[0][k]) + i for _, i in some], np.int64))
        at, tokens = np.concatenate(starts), np.concatenate(earlier)
        order = np.argsort(at, kind="stable")
        return Encoded(start, end, int(before[-1]) if len(before) else 0, at[order], tokens[order])


def resynchronised(text: str, encoder: Callable[[str, int, int], Encoded], chunk: int, overlap: int, margin: int, spliced: list | None = None) -> int:
    """The tokens of a huge text, from the encodings of overlapping chunks.

    Each chunk begins `overlap` before the end of the one before. The two are spliced at the last boundary that is
    proven by both: tokens before it are the left chunk's, those behind it the right one's. Where they have none in
    common the overlap widens, at last by encoding a longer left chunk. `spliced` gets the places."""
    left, total, at = encoder(text, 0, min(chunk, len(text))), 0, 0
    while left.end < len(text):
        wide, right = overlap, None
        while right is None:
            begin = max(at, left.end - wide)
            found = encoder(text, begin, min(len(text), begin + max(chunk, 2 * wide)))
            common = np.intersect1d(left.starts, found.starts)
            common = common[(common > at) & (common >= begin + margin) & (common <= left.end - margin)]
            if len(common):
                right = found
            elif begin > at:
                wide *= 2
            else:
                break
        if right is None:
            # Nothing in the whole chunk: it goes on.
            left = encoder(text, left.start, min(len(text), left.end + max(chunk, left.end - left.start)))
            continue
        place = int(common[-1])
        total += left.at(place) - left.at(at)
        left, at = right, place
        if spliced is not None:
            spliced.append(place)
    return total + left.total - left.at(at)


class Memory:
    """What a function says of pieces, remembered within bounds. `of` maps a list of distinct pieces to their values."""

    def __init__(self, of: Callable[[list[str]], list]):
        self.of, self.known, self.older = of, {}, {}

    def __call__(self, pieces: list[str]) -> dict:
        """A dict that has at least these pieces."""
        new = set(pieces).difference(self.known)
        if not new:
            return self.known
        if len(self.known) + len(new) > MOST_PIECES // 2:
            # Two generations: what is used again comes over, what isn't goes with the older one.
            self.older, self.known = self.known, {p: self.known[p] for p in set(pieces) if p in self.known}
        again = {p: self.older[p] for p in new if p in self.older}
        self.known.update(again)
        new.difference_update(again)
        if not new:
            return self.known
        new = list(new)
        values = dict(zip(new, self.of(new), strict=True))
        long = {p: v for p, v in values.items() if len(p) > LONGEST}
        self.known.update(values if not long else {p: v for p, v in values.items() if p not in long})
        return ChainMap(long, self.known) if long else self.known
