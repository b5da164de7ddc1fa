"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Each rule is evaluated once. The ledger keeps its measurements and one bit per failed rule; a policy is a named,
versioned mask over these bits, so that another policy or an ablation needs no second look at the texts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.scratch import let

#: The spaces that end words, and the symbols that are counted.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Letters of scripts whose words aren't parted by spaces.
UNSPACED = "[" + "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")) + "]"

#: Bits of the ledger, by name. Bits never change their meaning; new rules take new bits.
RULES = {
    "few_words": (0, lambda c: c["n_words"] < 20),
    "repeated_words": (1, lambda c: 100 * c["n_repeat_words"] > 30 * c["n_words"]),
    "symbols": (2, lambda c: 10 * c["n_symbols"] > 3 * c["n_words"]),
    "repeated_lines": (3, lambda c: 10 * c["n_dup_lines"] > 3 * c["n_lines"]),
    "short_words": (4, lambda c: c["word_chars"] < 2 * c["n_words"]),
    "long_words": (5, lambda c: c["word_chars"] > 20 * c["n_words"]),
    "no_letters": (6, lambda c: 10 * c["n_letter_words"] < 6 * c["n_words"]),
    "capitals": (7, lambda c: 10 * c["n_capitals"] > 4 * c["word_chars"]),
}
#: Rules in a form for every script, under the same bits of `failed_any_script`: a letter of an unspaced script counts as
#: a word, the length of words is judged where spaces part them, and letters need no case.
ANY_SCRIPT = RULES | {
    "few_words": (0, lambda c: c["n_units"] < 20),
    "symbols": (2, lambda c: 10 * c["n_symbols"] > 3 * c["n_units"]),
    "long_words": (5, lambda c: c["spaced_chars"] > 20 * c["n_spaced_words"]),
    "no_letters": (6, lambda c: 10 * c["n_any_letter_words"] < 6 * c["n_words"]),
}
BASE_RULES = ("few_words", "repeated_words")


def mask(*names: str) -> int:
    return sum(1 << RULES[name][0] for name in names)


#: Versioned policies: a document is kept if it fails none of the mask's rules.
POLICIES: Mapping[str, int] = {
    "base-1": mask(*BASE_RULES),
    "web-1": mask(*RULES),
    "web-2": mask(*RULES),
}
#: The ledger's column that a policy's mask is for.
LEDGERS = {"base-1": "failed_bits", "web-1": "failed_bits", "web-2": "failed_any_script"}


def _repeated_words(words: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more in the text.

    Window hashes settle texts without repeats. In the others equal hashes are neighbours after a sort; they count
    only if the words themselves are equal.
    """
    n = F.size(words)

    def covered(hashed: Column) -> Column:
        at = F.sequence(F.lit(0), n - WINDOW)
        windows = F.transform(at, lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(WINDOW)]))

        def repeats(win: Column) -> Column:
            def marked(s: Column) -> Column:
                same = lambda x, k: (F.get(s, k)["h"] == x["h"]) & (F.slice(words, F.get(s, k)["i"] + 1, F.lit(WINDOW)) == F.slice(words, x["i"] + 1, F.lit(WINDOW)))
                found = F.filter(s, lambda x, k: F.coalesce(F.when(k > 0, same(x, k - 1)), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
                places = F.sort_array(F.transform(found, lambda x: x["i"]))
                spans = lambda p: F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(
                    F.aggregate(F.zip_with(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(F.lit(WINDOW), b - a).cast("long")), F.lit(WINDOW).cast("long"), lambda t, x: t + x)
                )
                return let(places, spans)

            return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(
                let(F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), marked)
            )

        return let(windows, repeats)

    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), covered))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with measurements (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letter_words,
    n_capitals, n_spaced_words, spaced_chars, n_units, n_any_letter_words), `failed_bits` and `failed_any_script`. Null text counts as empty; every row, repeated ones too, is measured alone; columns
    of docs with these names are replaced."""
    blank = f"[{SPACES}]"
    own = F.coalesce(docs[text], F.lit(""))
    held = docs.withColumn("__text", own).withColumn("__words", F.filter(F.split("__text", f"{blank}+"), lambda w: w != ""))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.trim(F.translate(x, SPACES[1:], "")) != "")
    measured = held.withColumn("__lines", lines).withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate("__text", SPACES, "")).cast("long"),
            "n_symbols": (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": _repeated_words(F.col("__words")),
            "n_letter_words": F.size(F.filter("__words", lambda w: F.lower(w) != F.upper(w))).cast("long"),
            "n_capitals": (F.length("__text") - F.length(F.translate("__text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        }
    )
    # Only texts with such letters, or without case, are looked at once more.
    unspaced = F.col("__text").rlike(UNSPACED)
    spaced = F.filter("__words", lambda w: ~w.rlike(UNSPACED))
    measured = measured.withColumns(
        {
            "n_spaced_words": F.when(unspaced, F.size(spaced).cast("long")).otherwise(F.col("n_words")),
            "spaced_chars": F.when(unspaced, F.length(F.array_join(spaced, "")).cast("long")).otherwise(F.col("word_chars")),
            "n_units": F.when(unspaced, (F.size(spaced) + F.regexp_count("__text", F.lit(UNSPACED))).cast("long")).otherwise(F.col("n_words")),
            "n_any_letter_words": F.when(RULES["no_letters"][1](measured), F.size(F.filter("__words", lambda w: w.rlike(r"\p{L}"))).cast("long")).otherwise(F.col("n_letter_words")),
        }
    )
    for name, rules in (("failed_bits", RULES), ("failed_any_script", ANY_SCRIPT)):
        bits = None
        for bit, rule in rules.values():
            one = F.when(rule(measured), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
            bits = one if bits is None else bits.bitwiseOR(one)
        measured = measured.withColumn(name, bits)
    return measured.drop("__text", "__words", "__lines")


def kept(policy: str = "web-2") -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col(LEDGERS[policy]).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(entries: DataFrame, policy: str = "web-1") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that fail no other, which dropping the rule would keep.

    One pass: equal bitmasks are counted first, so what is left has at most 2**rules rows."""
    held = F.lit(POLICIES[policy]).cast("long")
    counted = entries.groupBy(F.col(LEDGERS[policy]).bitwiseAND(held).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for name, (bit, _) in RULES.items() if POLICIES[policy] >> bit & 1])
    each = counted.select("bits", "n", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(hit & (F.bit_count(F.col("bits")) == 1), F.col("n"))), F.lit(0)).alias("n_only_this"),
    )
