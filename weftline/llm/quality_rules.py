"""Operator 5, quality rules: a threshold table compiled into one Spark projection.

All measures are built-in functions on arrays of words and lines; no row leaves its task, and no user
function runs. Repeated 8-word windows are looked for by 64-bit hashes first; only texts in which two
hashes are equal sort their windows as strings, so the counts are exact.

Null and empty texts have no words: all counts are 0 and base_failed is true. Texts are measured whole.
Each input row gives one row, repeated rows included. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Common words of four languages; fixed values.
STOP_WORDS = (
    "the be to of and that have with is in for it on as was are by this from not "
    "der die das und ist ein eine von zu den dem mit auf für im des sich nicht auch als "
    "le la les de des du et est un une en pour dans que qui sur au avec par pas "
    "el los las y una con su lo se no del para como más al por"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure over another must lie in [low, high]; a bound of None is open."""

    name: str
    over: str
    of: str
    low: float | None
    high: float | None


#: The method's verdict. A rule holds where its denominator is 0.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.01, None),
    Rule("shouts_per_word", "n_shouts", "n_words", None, 0.3),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
)
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column, each: Callable[[Column], Column]) -> Column:
    """``each`` of the 1-based start of all windows."""
    return F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), each))


def repeated_words(words: Column) -> Column:
    """Number of words in windows that are found twice or more."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def exact(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda p, i: F.coalesce(F.get(pairs, i - 1)["w"] == p["w"], F.lit(False)) | F.coalesce(F.get(pairs, i + 1)["w"] == p["w"], F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda p: p["s"])), covered)

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _windows(h, lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW)))))
    unequal = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    pairs = F.array_sort(_windows(words, lambda i: F.struct(F.array_join(F.slice(words, i, F.lit(WINDOW)), " ").alias("w"), i.alias("s"))))
    return F.when(F.size(words) < WINDOW, 0).when(unequal, 0).otherwise(let(pairs, exact)).cast("long")


def measures(text: Column) -> Column:
    """A struct of all counts of a text."""

    def of_lines(lines: Column) -> list[Column]:
        return [
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•]"))).cast("long").alias("n_bullet_lines"),
        ]

    def of_words(words: Column) -> list[Column]:
        return [
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w: w.endswith("!!"))).cast("long").alias("n_shouts"),
        ]

    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols")
    return let(words, lambda w: let(lines, lambda x: F.struct(*of_words(w), *of_lines(x), symbols)))


def verdict(m: Callable[[str], Column], rules: tuple[Rule, ...] = RULES) -> Column:
    """True if all rules of the table hold."""
    out = F.lit(True)
    for r in rules:
        over, of = m(r.over).cast("double"), m(r.of).cast("double")
        if r.low is not None:
            out &= over >= F.lit(r.low) * of
        if r.high is not None:
            out &= over <= F.lit(r.high) * of
    return out


def assess(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns ``keep`` of every row, its counts, base_failed and kept."""
    keep = ["doc_id"] if keep is None else keep
    seen = docs.select(*keep, measures(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("__m"))

    def m(name: str) -> Column:
        return F.col(f"__m.{name}")

    failed = (m("n_words") < 20) | (100 * m("n_repeat_words") > 30 * m("n_words"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return seen.select(*keep, *[m(n).alias(n) for n in names], failed.alias("base_failed"), (~failed & verdict(m, rules)).alias("kept"))


def filter_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    marked = docs.withColumn("__m", measures(F.coalesce(F.col(text).cast("string"), F.lit(""))))

    def m(name: str) -> Column:
        return F.col(f"__m.{name}")

    failed = (m("n_words") < 20) | (100 * m("n_repeat_words") > 30 * m("n_words"))
    return marked.where(~failed & verdict(m, rules)).drop("__m")
