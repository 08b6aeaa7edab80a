"""Operator 7: quality rules as a short-circuit cascade.

Each rule is a native expression that is true for a text it rejects. On a
sample, every rule is timed and its rejections are counted; the cascade asks the
rule with most rejections per second first, and CASE WHEN leaves the later ones
unevaluated for a rejected text. The verdict does not depend on the order, so
the sample and the timing change only the speed.

Defined cases: a null text is an empty one, without words; an empty text fails
the rule on few words; lines without a word are no lines; repeated rows are
judged each; an empty table gives an empty result; clashing column names of the
input do not matter, since only the text is read.

Equal 8-word windows are found by 64-bit hashes of their words within one text.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tremorframe.llm.common import SPACE, whole, word_array
from tremorframe.session import stage_table

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
PLACE = (1 << 20) - 1
SAMPLE_ROWS = 500


def pair_hash(hashes: Column, ahead: int) -> Column:
    """Hash of each element with the one ``ahead`` places later; the last ``ahead`` have no meaning."""
    later = F.slice(hashes, ahead + 1, F.greatest(F.size(hashes), F.lit(1)))
    return F.zip_with(hashes, later, lambda a, b: F.xxhash64(a, b))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, and only where the whole is."""
    return F.element_at(F.transform(F.array(value), use), 1)


def half_window_hashes(words: Column) -> Column:
    """Hash of every 4-word window, by doubling: 1, 2, 4 words."""
    hashes = pair_hash(pair_hash(F.transform(words, lambda w: F.xxhash64(w)), 1), 2)
    return F.slice(hashes, 1, F.greatest(F.size(words) - (WINDOW // 2 - 1), F.lit(0)))


def window_hashes(halves: Column) -> Column:
    """Hash of every 8-word window, or nothing where none can occur twice.

    A window that occurs twice repeats the five 4-word windows in it.
    """
    spare = F.size(halves) - F.size(F.array_distinct(halves))
    full = F.slice(pair_hash(halves, WINDOW // 2), 1, F.greatest(F.size(halves) - WINDOW // 2, F.lit(0)))
    return F.when(spare > WINDOW // 2, full).otherwise(F.array().cast("array<bigint>"))


def covered_words(starts: Column) -> Column:
    """Words inside the windows at ``starts``, an array of places without order."""
    starts = F.sort_array(F.array_distinct(starts))
    nexts = F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1)))
    covered = F.zip_with(starts, nexts, lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(covered, F.lit(0).cast("long"), lambda acc, x: acc + x)


def twins_by_structs(windows: Column) -> Column:
    """Places of windows that occur twice or more; for texts of any length."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    following = F.slice(placed, 2, F.greatest(F.size(placed), F.lit(1)))
    empty = F.array().cast("array<bigint>")
    return F.flatten(
        F.zip_with(placed, following, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(empty))
    )


def twins_by_longs(windows: Column) -> Column:
    """The same by one sort of longs: 44 bits of hash over 20 bits of place.

    Two hashes that agree in 44 bits only leave a -1; the caller then takes the
    other way, as for texts of over 2**20 words.
    """
    packed = F.sort_array(
        F.transform(windows, lambda h, i: h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long")))
    )
    following = F.slice(packed, 2, F.greatest(F.size(packed), F.lit(1)))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(PLACE))

    def at(x: Column) -> Column:
        return F.get(windows, place(x).cast("int"))

    def side(pick: Callable[[Column, Column], Column]) -> Column:
        return F.array_compact(
            F.zip_with(
                packed,
                following,
                lambda a, b: F.when(
                    F.shiftright(a, 20) == F.shiftright(b, 20), F.when(at(a) == at(b), place(pick(a, b))).otherwise(-1)
                ),
            )
        )

    return F.concat(side(lambda a, b: a), side(lambda a, b: b))


def repeated_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more."""

    def counted(fast: Column) -> Column:
        slow = bind(twins_by_structs(windows), covered_words)
        return F.when(F.array_contains(fast, -1), slow).otherwise(covered_words(fast))

    long_text = F.size(windows) > PLACE
    return (
        F.when(F.size(windows) == 0, F.lit(0).cast("long"))
        .when(long_text, bind(twins_by_structs(windows), covered_words))
        .otherwise(bind(twins_by_longs(windows), counted))
        .cast("long")
    )


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    left = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))
    return F.when(text.rlike(SYMBOLS), left).otherwise(0).cast("long")


def n_exclamations(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long")


def n_stutters(words: Column) -> Column:
    """Words equal to the word before them."""
    same = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(a == b, 1))
    return F.size(F.array_compact(same)).cast("long")


def line_array(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE.replace("[", "[^")))


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true where the rule turns a text down; it may read ``_text``, ``_words``, ``_lines``."""

    name: str
    rejects: Column


def base_rules() -> list[Rule]:
    """Too few words; too much of the text in repeated windows."""
    words = F.col("_words")
    windows = bind(half_window_hashes(words), window_hashes)
    repeated = 100 * bind(windows, repeated_words) > 30 * n_words(words)
    return [Rule("few_words", n_words(words) < 20), Rule("repeated_words", repeated)]


def production_rules() -> list[Rule]:
    """The base rules with limits on symbols, exclamation marks, repeated lines and words, and word length."""
    words, lines = F.col("_words"), F.col("_lines")
    count = n_words(words)
    return [
        *base_rules(),
        Rule("symbols", 10 * n_symbols(F.col("_text")) > count),
        Rule("exclamations", 10 * n_exclamations(F.col("_text")) > 3 * count),
        Rule("stutters", 5 * n_stutters(words) > count),
        Rule("repeated_lines", (n_dup_lines(lines) >= 3) & (2 * n_dup_lines(lines) > F.size(lines))),
        Rule("word_length", (word_chars(words) < 2 * count) | (word_chars(words) > 15 * count)),
    ]


def parts(docs: DataFrame) -> DataFrame:
    """``docs`` with what the rules read: ``_text``, ``_words``, ``_lines``."""
    text = docs.withColumn("_text", whole())
    return text.withColumns({"_words": word_array(F.col("_text")), "_lines": line_array(F.col("_text"))})


def measured_order(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample of at most ``sample_rows`` rows.

    The better of two runs counts, less the time of a run without any rule.
    """
    sample = parts(stage_table(docs.select("text").limit(sample_rows), "quality-sample"))

    def run(rejects: Column) -> tuple[float, int]:
        best, hits = float("inf"), 0
        for _ in range(2):
            start = time.perf_counter()
            hits = sample.agg(F.count_if(rejects)).first()[0]
            best = min(best, time.perf_counter() - start)
        return best, hits

    idle, _ = run(F.size("_words") < 0)
    gains = []
    for rule in rules:
        seconds, hits = run(rule.rejects)
        gains.append(hits / max(seconds - idle, 1e-3))
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-gains[i], i))]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, else null; later rules are not evaluated."""
    first, *others = rules
    out = F.when(first.rejects, F.lit(first.name))
    for rule in others:
        out = out.when(rule.rejects, F.lit(rule.name))
    return out


def judged(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``_failed``, the name of the rule that rejects, or null for a text that stays."""
    rules = measured_order(docs, rules or production_rules(), sample_rows)
    # Never true. A filter on a deterministic column would be pushed below it, and
    # the words of the text split again for every place where a rule reads them.
    barrier = F.monotonically_increasing_id() < 0
    failed = F.when(barrier, F.lit("")).otherwise(cascade(rules))
    return parts(docs).withColumn("_failed", failed).drop("_text", "_words", "_lines")


def figures(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Figures and verdict of every text; the rules beside the base ones short-circuit."""
    extra = [r for r in rules or production_rules() if r.name not in {b.name for b in base_rules()}]
    order = measured_order(docs, extra, sample_rows)
    words, lines, text = F.col("_words"), F.col("_lines"), F.col("_text")
    counted = (
        parts(docs.select("doc_id", "text"))
        .withColumn("_halves", half_window_hashes(words))
        .withColumn("_windows", window_hashes(F.col("_halves")))
        .withColumns(
            {
                "n_words": n_words(words),
                "word_chars": word_chars(words),
                "n_symbols": n_symbols(text),
                "n_dup_lines": n_dup_lines(lines),
                "n_repeat_words": repeated_words(F.col("_windows")),
            }
        )
    )
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order))
    return (
        counted.withColumn("base_failed", base)
        .withColumn("failed_rule", failed)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", F.col("failed_rule").isNull().alias("kept"), "failed_rule",
        )
    )
