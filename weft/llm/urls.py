"""URL filters: a rule list by host and path, and a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.scratch import extended


#: (verdict, host, path), as the contract lists them.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: One strict term rejects a url; of the soft ones it takes two different.
STRICT = (
    # adult
    "porn", "porno", "pornhub", "pornstar", "pornstars", "xxx", "xvideos", "hentai", "milf", "camgirl", "camgirls", "sexcam", "sexcams", "sextube", "escort", "escorts", "blowjob", "gangbang", "nsfw", "upskirt",
    # drugs without a prescription
    "viagra", "cialis", "levitra", "tramadol", "xanax", "kamagra",
    # piracy, fraud
    "warez", "keygen", "keygens", "serialz", "phishing", "carding", "fullz", "cvvshop", "ransomware", "cryptolocker",
)
SOFT = (
    # gambling
    "bet", "bets", "betting", "casino", "casinos", "poker", "slots", "slot", "jackpot", "bonus", "roulette", "blackjack", "baccarat", "bingo", "lottery", "win", "winner", "odds", "wager",
    # money
    "free", "loan", "loans", "payday", "cheap", "discount", "rich", "profit", "profits", "forex", "bitcoin", "refinance", "cash", "giveaway",
    # health
    "pills", "pharmacy", "diet", "steroids", "weightloss", "detox", "prescription",
    # adult and dating
    "dating", "adult", "adults", "sexy", "sex", "nude", "nudes", "naked", "erotic", "fetish", "hookup", "singles", "webcam", "webcams", "lingerie", "hot",
    # piracy
    "torrent", "torrents", "crack", "cracked", "cracks", "serial", "nulled", "hack", "hacks", "cheats", "replica", "replicas", "fullmovie",
)
LEAST_SOFT = 2


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without '://' or for null."""
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    after = F.when(has, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    plain = F.regexp_extract(after, r"^([^?#]*)", 1)
    own = F.regexp_extract(plain, r"^([^/]*)", 1)
    # By places, not by a pattern: line ends belong to the path as well.
    return F.translate(own, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.substring(plain, F.length(own) + 1, F.length(plain))


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(name, verdict) of the longest rule that fits, or null."""
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        out = F.when(fits(h, p), F.struct(F.lit(h + p).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def automaton(strict: Sequence[str], soft: Sequence[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for term in terms:
            found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def counts(found, url: str) -> tuple[int, int]:
    """Strict hits and distinct soft terms in a lower-cased url that stand between characters other than letters and digits."""
    strict, soft = 0, set()
    for end, (term, weight) in found.iter(url):
        start = end - len(term) + 1
        if (start == 0 or not (url[start - 1].isascii() and url[start - 1].isalnum())) and (end + 1 == len(url) or not (url[end + 1].isascii() and url[end + 1].isalnum())):
            if weight == 2:
                strict += 1
            else:
                soft.add(term)
    return strict, len(soft)


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> DataFrame:
    """pages with host, path, rule, n_strict, n_soft and verdict ('allow' or 'block').

    Null, empty and malformed urls have empty host and path, fit no rule and are judged by their terms alone (null:
    none, so allow). Terms are ASCII and found in the url with A-Z lower-cased. Columns of pages with our names are
    replaced; repeated rows get equal results."""
    held = pages.drop("host", "path", "rule", "n_strict", "n_soft", "verdict")
    schema = extended(held, n_strict="bigint", n_soft="bigint")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(strict, soft)
        for batch in batches:
            hits = [counts(found, (u or "").translate(lower)) for u in batch.column(url).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in hits], pa.int64()), pa.array([b for _, b in hits], pa.int64())], names=schema.names)

    marked = held.mapInArrow(run, schema)
    host, path = parts(F.col(url))
    marked = marked.withColumns({"host": host, "path": path}).withColumn("__rule", rule(F.col("host"), F.col("path"), rules))
    bad = (F.col("n_strict") > 0) | (F.col("n_soft") >= LEAST_SOFT)
    own = F.when(bad, F.lit("block")).otherwise(F.lit("allow"))
    return marked.withColumns({"rule": F.col("__rule.name"), "verdict": F.coalesce(F.col("__rule.verdict"), own)}).drop("__rule")
