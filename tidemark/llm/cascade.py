"""Quality rules as a short-circuit cascade, in Spark expressions only.

A rule names the text statistics that it needs and the condition that rejects a document. Its cost
and its rejection rate are measured on a sample; the cascade then asks the rules in the order of
rejections per second, and a later rule is not evaluated for a document that an earlier one rejects.

Defined results: a null text has no words and every count is 0. Rows with equal ids are judged each
by its own text. Columns of the input that clash with a result's name are replaced. An empty table
gives an empty result. The verdict never depends on the order of the rules.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _covered(hashes: Column, window: int) -> Column:
    """Words inside windows whose hash stands at two places or more."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        twice = F.transform(
            s,
            lambda x, j: F.when(
                F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)),
                x["i"],
            ),
        )
        return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda i, j: F.least(F.lit(window), F.get(p, j + 1) - i))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(ordered, lambda s: let(places(s), total))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside ``window``-word windows that stand twice or more in the text."""
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - (window - 1)),
        lambda i: F.xxhash64(F.slice(words, i, window)),
    )
    counted = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h, window)),
    )
    return F.when(F.size(words) >= window, counted).otherwise(F.lit(0).cast("long"))


def symbol_count(text: Column) -> Column:
    return (F.size(F.split(F.coalesce(text, F.lit("")), SYMBOLS, -1)) - 1).cast("long")


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def duplicate_lines(text: Column) -> Column:
    return let(filled_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def base_counts(text: Column) -> Column:
    """Struct of the base statistics of a text; its words are split once."""
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbol_count(text).alias("n_symbols"),
            duplicate_lines(text).alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )


def stutters(text: Column) -> Column:
    """Words equal to the word before them."""
    return let(
        words_of(text), lambda w: F.size(F.filter(F.transform(w, lambda x, i: x == F.get(w, i + 1)), lambda same: same))
    ).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives the condition under which a row goes; null counts as kept."""

    name: str
    rejects: Callable[[], Column]


#: Shares in percent and bounds of the quality rules.
BASE_MIN_WORDS, BASE_MAX_REPEAT = 20, 30
MAX_SYMBOLS, MAX_DUP_LINES, MAX_SHOUTED, MAX_STUTTERS = 20, 60, 30, 30
WORD_CHARS = (2, 15)


def quality_rules() -> list[Rule]:
    """Rules over the columns of ``base_counts`` and the text itself."""
    n, text = F.col("n_words"), F.coalesce(F.col("text"), F.lit(""))
    return [
        Rule("symbols", lambda: F.lit(100) * F.col("n_symbols") > F.lit(MAX_SYMBOLS) * n),
        Rule("duplicate_lines", lambda: let(filled_lines(text), lambda x: F.lit(100) * F.col("n_dup_lines") > F.lit(MAX_DUP_LINES) * F.size(x))),
        Rule("short_words", lambda: F.col("word_chars") < F.lit(WORD_CHARS[0]) * n),
        Rule("long_words", lambda: F.col("word_chars") > F.lit(WORD_CHARS[1]) * n),
        Rule("shouted", lambda: F.lit(100) * (F.size(F.split(text, "!!", -1)) - 1) > F.lit(MAX_SHOUTED) * n),
        Rule("stutters", lambda: F.lit(100) * stutters(text) > F.lit(MAX_STUTTERS) * n),
    ]


def measure(sample: DataFrame, rules: Sequence[Rule], repeats: int = 2, turns: int = 8) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, rejection rate) of each rule on ``sample``.

    A job asks a rule ``turns`` times about every row; what the same job takes without a rule is taken off, so
    that the cost is that of the rule and not of starting jobs.
    """
    asked = sample.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(turns))))

    def run(condition: Column) -> tuple[float, int, int]:
        seconds = []
        for _ in range(repeats):
            started = time.perf_counter()
            rows, gone = asked.agg(F.count(F.lit(1)), F.count_if(condition)).first()
            seconds.append(time.perf_counter() - started)
        return min(seconds), rows // turns, gone // turns

    idle, rows, _ = run(F.col("_turn") < 0)
    found = []
    for rule in rules:
        seconds, _, gone = run(rule.rejects())
        # one rejected and one kept row more, so that no rate is exactly 0 or 1; a millionth of a second at least
        found.append((rule, max((seconds - idle) / turns, 1e-6), (gone + 1) / (rows + 2)))
    return found


def best_order(measured: Sequence[tuple[Rule, float, float]]) -> list[Rule]:
    """Rules by rejection per cost, most first; ties by name."""
    return [r for r, cost, rate in sorted(measured, key=lambda x: (-x[2] / max(x[1], 1e-9), x[0].name))]


def cascade(rules: Sequence[Rule]) -> Column:
    """True for a row that no rule rejects; rules are asked in the given order and the first rejection ends."""
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(rule.rejects(), F.lit(False)).otherwise(kept)
    return kept


def with_base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    counted = docs.drop(*names, "_counts").withColumn("_counts", base_counts(F.col(text)))
    return counted.select("*", *[F.col(f"_counts.{c}").alias(c) for c in names]).drop("_counts")


def quality_verdicts(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = 512) -> DataFrame:
    """All rows of ``docs`` with the base statistics, ``base_failed`` and ``kept``.

    ``sample_rows`` bounds the rows on which the order of the rules is estimated. They are taken in
    hash order of the id, so every source can be among them; they decide the order, never a verdict.
    """
    counted = with_base_counts(docs)
    rules = list(quality_rules() if rules is None else rules)
    # the smallest hashes only are sorted, about four times as many rows as wanted
    most = int(min(1.0, 4 * sample_rows / max(1, docs.count())) * 2**30)
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**30)) < F.lit(most))
    picked = with_base_counts(drawn.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(2**30)), "text").limit(sample_rows)).persist()
    try:
        ordered = best_order(measure(picked, rules))
    finally:
        picked.unpersist()
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(BASE_MAX_REPEAT) * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(ordered))
    )
