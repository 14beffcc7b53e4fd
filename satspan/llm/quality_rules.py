"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a column expression, every rule a row of :data:`RULES`
(measure, lower bound, upper bound, least words).  ``verdict`` turns the table
into one boolean column; no user function runs.

Defined results: null or empty text has no words and fails the length rule;
very long texts are measured whole; equal rows give equal results; ids may be
null, repeated and of any type; extra input columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satspan.llm.common import BLANK, words_of

WINDOW = 8

#: Very common words of the corpus languages.
STOP_WORDS = (
    "the of and to in is that it was for on are as with at be this from or an a "
    "le la les de des du et en un une que qui est pas pour dans par sur au avec "
    "der die das und ist nicht ein eine mit von zu den im auf für sich auch "
    "el los las del y que se un una por con para como es no al"
).split()


class Rule(NamedTuple):
    name: str
    measure: str
    low: float | None
    high: float | None
    least_words: int = 0


#: The threshold table. A document is kept if no rule fails.
RULES = (
    Rule("length", "n_words", 20, None),
    Rule("repeated windows", "repeat_ratio", None, 0.30),
    Rule("word length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.30),
    Rule("stop words", "stop_ratio", 0.02, None, 50),
    Rule("repeated lines", "dup_line_ratio", None, 0.40),
)


def _measures(docs: DataFrame, carried: str) -> DataFrame:
    """The measures of each row, beside the column ``carried``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select(
        carried,
        (F.length(text) - F.regexp_count(text, F.lit(BLANK))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        words_of(F.col("text")).alias("words"),
    )
    second = first.select(
        carried, "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    n = F.size("hashes")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    second = second.withColumn(
        "windows",
        F.transform(starts, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)])),
    ).drop("hashes")
    # Only texts with a window that occurs twice sort their windows.
    keyed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    third = second.withColumn(
        "sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), keyed)
    ).drop("windows")
    again = F.array_sort(
        F.transform(
            F.filter(
                F.arrays_zip(
                    F.col("sorted").alias("s"),
                    F.slice(F.col("sorted"), F.lit(2), F.size("sorted")).alias("next"),
                    F.concat(F.slice(F.col("sorted"), F.lit(1), F.lit(1)), F.col("sorted")).alias("before"),
                ),
                lambda x: x["s"].isNotNull()
                & (
                    F.coalesce(x["s"]["h"] == x["next"]["h"], F.lit(False))
                    | ((x["s"]["h"] == x["before"]["h"]) & (x["s"]["i"] != x["before"]["i"]))
                ),
            ),
            lambda x: x["s"]["i"],
        )
    )
    fourth = third.withColumn("again", again).drop("sorted")
    covered = F.aggregate(
        "again",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")
        ),
        lambda a: a["n"],
    )
    # The row number keeps Spark from moving later filters below this point,
    # where every measure would be computed anew for each of its uses.
    counted = F.when(F.monotonically_increasing_id() >= 0, F.coalesce(covered, F.lit(0)).cast("long"))
    return fourth.withColumn("n_repeat_words", counted).drop("again")


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def verdict(rules: Iterable[Rule] = RULES) -> Column:
    """True where no rule of the table fails."""
    ok = F.lit(True)
    for r in rules:
        x = F.col(r.measure)
        good = F.lit(True)
        if r.low is not None:
            good = good & (x >= r.low)
        if r.high is not None:
            good = good & (x <= r.high)
        ok = ok & (good | (F.col("n_words") < r.least_words))
    return ok


def _judged(docs: DataFrame, rules: Iterable[Rule], carried: str) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        _measures(docs, carried)
        .withColumns({
            "repeat_ratio": _ratio("n_repeat_words", "n_words"),
            "mean_word_chars": _ratio("word_chars", "n_words"),
            "symbol_ratio": _ratio("n_symbols", "n_words"),
            "stop_ratio": _ratio("n_stop", "n_words"),
            "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
            "base_failed": failed,
        })
        .withColumn("kept", ~F.col("base_failed") & verdict(rules))
    )


def score(docs: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """One row per document with all measures, ``base_failed`` and ``kept``."""
    return _judged(docs.select("doc_id", "text"), rules, "doc_id")


def keep(docs: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The rows that no rule rejects, with all their own columns."""
    rows = docs.select(F.struct("*").alias("_row"), "text")
    return _judged(rows, rules, "_row").where("kept").select("_row.*")
