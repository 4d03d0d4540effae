"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample.

Everything is built-in expressions on one narrow stage. A rule is a condition that rejects a
document. Before the run, a bounded sample tells for each rule which share it rejects and how long
it takes; rules are then asked in the order of rejected share per second, and the first that holds
ends the cascade. The order changes the cost only: the verdict is the same in any order.

Null and empty texts have no words: every count is 0 and the base test fails. Long texts cost in
proportion to their length (one sort where a window repeats). Repeated rows and ties are judged
row by row. An empty table gives an empty result; extra columns are kept out of the way.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word rule: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[ \t\n\x0B\f\r]+"
NOT_SPACE = r"[^ \t\n\x0B\f\r]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Bits of a packed number that hold a window's position; the others hold its hash.
POSITION_BITS = 24
SAMPLE_ROWS = 500


@dataclass(frozen=True)
class Rule:
    """Rejects a document where its condition over the measures holds."""

    name: str
    condition: str

    @property
    def rejects(self) -> Column:
        return F.expr(self.condition)


#: Shares are of words, or of the characters in words.
RULES = [
    Rule("many symbols", "10 * n_symbols > n_words"),
    Rule("odd word length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("repeated lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("mostly capitals", "10 * length(regexp_replace(text, '[^\\p{Lu}]+', '')) > 4 * word_chars"),
    Rule("many shouts", "5 * length(regexp_replace(text, '[^!]+', '')) > n_words"),
]


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once per row and hands it to ``use``."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column, n: Column) -> Column:
    """Words covered by windows that occur at least twice in the array.

    Hashes tell first whether any window can repeat. Only then hash and position, packed into one
    number, are sorted: neighbours of equal hash are the repeated windows, and the union of their
    ranges is counted. Where such neighbours differ in their words, or a text has more words than a
    packed position can hold, the windows themselves are sorted instead; the result is exact.
    """
    starts = F.sequence(F.lit(0), n - WINDOW)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    listed = F.sort_array(F.transform(
        starts, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("w"), i.alias("i"))
    ))
    position = lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")
    kin = lambda x, y: F.shiftright(x, POSITION_BITS) == F.shiftright(y, POSITION_BITS)
    known = lambda c: F.coalesce(c, F.lit(False))

    def by_window(s: Column) -> Column:
        same = lambda x, k: known(x["w"] == F.get(s, k)["w"])
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def by_hash(s: Column) -> Column:
        hits = F.filter(s, lambda x, k: known(kin(x, F.get(s, k - 1))) | known(kin(x, F.get(s, k + 1))))
        window = lambda x: F.slice(words, position(x) + 1, WINDOW)
        clash = lambda h: F.exists(
            F.sequence(F.lit(1), F.size(h) - 1),
            lambda k: kin(F.get(h, k), F.get(h, k - 1)) & (window(F.get(h, k)) != window(F.get(h, k - 1))),
        )
        found = lambda h: F.when(clash(h), bind(listed, by_window)).otherwise(
            F.sort_array(F.transform(h, position))
        )
        return bind(hits, found)

    def repeated(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, POSITION_BITS).bitwiseOR(i.cast("long"))))
        short = n < (1 << POSITION_BITS)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.array().cast("array<int>")).when(
            short, bind(packed, by_hash)
        ).otherwise(bind(listed, by_window))

    covered = F.aggregate(
        bind(hashed, repeated),
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(-WINDOW).alias("last")),
        lambda a, x: F.struct((a["total"] + F.least(F.lit(WINDOW), x - a["last"])).alias("total"), x.alias("last")),
        lambda a: a["total"],
    )
    return F.when(n >= WINDOW, covered).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base measures.

    A generator of one row computes them, with words and lines bound as lambda variables: the
    optimiser can then repeat neither the splits nor the measures.
    """
    trimmed = F.btrim(F.col("text"), F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_SPACE))
    measures = F.transform(F.array(words), lambda w: bind(lines, lambda x: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(w, F.size(w)).alias("n_repeat_words"),
        F.size(x).cast("long").alias("n_lines"),
    )))
    whole = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return whole.select("doc_id", "text", F.inline(measures))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ordered(sample: DataFrame, chosen: list[Rule]) -> list[Rule]:
    """Rules by rejected share of the sample per second of work, highest first.

    Each rule is timed by itself over the cached measures, after one run that warms it up. A rule
    that rejects nothing comes last, cheapest first.
    """
    sample = sample.cache()
    found = []
    try:
        n = max(1, sample.count())
        for rule in chosen:
            asked = sample.agg(F.sum(F.when(rule.rejects, 1).otherwise(0)).alias("n"))
            asked.first()
            start = time.perf_counter()
            rejected = asked.first()["n"] or 0
            cost = time.perf_counter() - start
            found.append((-(rejected / n) / cost, cost, rule))
    finally:
        sample.unpersist()
    return [rule for *_, rule in sorted(found, key=lambda x: x[:2])]


def cascade(chosen: list[Rule]) -> Column:
    """True where neither the base test nor a rule rejects; later rules aren't evaluated after a rejection."""
    out = F.when(base_failed(), False)
    for rule in chosen:
        out = out.when(rule.rejects, False)
    return out.otherwise(True)


def apply_rules(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The measures and the verdict of every document."""
    spark = docs.sparkSession
    head = docs.select("doc_id", "text").head(sample_rows)  # costs only: every document meets every rule it has to
    sample = measured(spark.createDataFrame(head, docs.select("doc_id", "text").schema)).where(~base_failed())
    return measured(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), cascade(ordered(sample, RULES)).alias("kept"),
    )
