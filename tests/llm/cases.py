"""Small documents with every odd case, and plain versions of the operators to hold them against."""

import random
import re
from collections import Counter, defaultdict

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "ing", "or", "é", "st", "wh"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def documents():
    base, passage = prose(1, 150), prose(2, 70)
    near = base.split(" ")
    near[40] = "changed"
    more = list(near)
    more[90:92] = ["once", "again"]
    texts = [
        base, base, " ".join(near), " ".join(more), "NULL", "", " \n\t ", "x", "one two three", "One TWO three", prose(3, 30) + " " + passage, passage + "\n" + prose(4, 40), passage,
        "line a\n" * 30, "word " * 400, "ab" * 3000, prose(5, 3000), prose(6, 30) + "\n\npassword=Ab3dEf9h1\n" + prose(7, 10), "AKIA" + "ABCDEFGH12345678", "tail  double   spaces \n and\ttabs ", "日本語のテキスト " * 30,
        "### $$$ %%% " * 20, prose(8, 19), prose(9, 20), prose(10, 40) + " <|endoftext|> it's we'll", "é" * 250, base + "é" * 3,
    ]
    return [(i * 3 + 1, None if t == "NULL" else t, ["a", "b", None][i % 3] if i else "hot") for i, t in enumerate(texts)]


def frame(spark, rows=None, slices=3):
    rows = documents() if rows is None else rows
    extra = [(*r, "mine", i, None) for i, r in enumerate(rows)]
    df = spark.createDataFrame(extra, "doc_id bigint, text string, source string, n_words string, anchor int, spans string")
    return df.repartition(slices) if rows else df


def plain_words(text):
    return SPLIT.findall(text or "")


def shingles(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = plain_words(lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeated(rows, length=200):
    """Of each row whether each byte goes."""
    raw = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def quality(text):
    w = plain_words(text)
    text = text or ""
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if plain_words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)
