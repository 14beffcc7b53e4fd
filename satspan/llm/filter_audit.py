"""Filter interaction audit: what each filter removes, in every order of the filters.

A document is a mask: one bit for each filter whose failure condition it meets.
A part's documents are a histogram over the masks, and every outcome of every
order and step is linear in it.  So the histograms (all documents, the good, the
toxic) are stacked as rows and multiplied by integer incidence matrices, one
column for each order and step: kept, removed, redundant and unique outcomes.
With five filters these are 32 rows by 600 columns.

The last filter, repeated texts, compares a text with all others: texts meet by
their sha256, and only counts and least ids by (text, part, label) meet, so a
group of copies of any size is a few rows.

Defined results: null text is an empty text, a null part an empty string; a
document whose id is null fails no comparison of ids and has no label; rows with
one id and text are not copies of each other; an id with several label rows is
good or toxic if one of them says so; null labels say nothing; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satspan.llm.common import words_of

LETTERS = "ABCDE"
#: Bit of the repeated texts; the other letters have the bits below.
REPEATED = 1 << LETTERS.index("E")

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def orders(letters: str = LETTERS) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def incidence(letters: str = LETTERS) -> dict[str, np.ndarray]:
    """The matrices: a row for each mask, a column for each order and step.

    ``shapley`` has, for the step's filter, the orders in which it is the filter
    that removes a document of that mask.
    """
    masks = np.arange(1 << len(letters))
    kept, removed, redundant, unique = [], [], [], []
    for order in orders(letters):
        alive = np.ones(len(masks), dtype=bool)
        for letter in order:
            bit = 1 << letters.index(letter)
            fails = (masks & bit) != 0
            removed.append(alive & fails)
            redundant.append(~alive & fails)
            unique.append(masks == bit)
            alive = alive & ~fails
            kept.append(alive)
    found = {
        name: np.array(columns, dtype=np.int64).T
        for name, columns in (("kept", kept), ("removed", removed), ("redundant", redundant), ("unique_fails", unique))
    }
    at = np.array([letters.index(x) for order in orders(letters) for x in order])
    by_filter = np.stack([found["removed"][:, at == k].sum(axis=1) for k in range(len(letters))], axis=1)
    return found | {"shapley": by_filter[:, at]}


def failures(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text alone."""
    n_words = F.size(words)
    return {
        "A": n_words < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n_words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _masked(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, digest of the text, and the mask without repeated texts."""
    rows = docs.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", words_of(F.col("text")))
    bits = [F.when(c, 1 << LETTERS.index(x)).otherwise(0) for x, c in failures(F.col("text"), F.col("words")).items()]
    return rows.select(
        "doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        sum(bits[1:], bits[0]).alias("mask"),
    )


def histograms(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Per part and mask: n, and how many of them are good and toxic."""
    said = labels.groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    once = _masked(docs, part).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("copies"))
    rows = once.join(said, "doc_id", "left").na.fill(0, ["good", "toxic"])
    # An id occurs once in each of these groups.
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("copies").alias("n"),
        F.min("doc_id").alias("least"),
        F.coalesce(F.min_by("copies", "doc_id"), F.lit(0)).alias("n_least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("copies"))), F.lit(0)).alias("n_null"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    own = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = groups.withColumn("first", first).withColumn("own", own).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask").alias("mask"), F.col("own").alias("n")),
            F.struct((F.col("mask") + REPEATED).alias("mask"), (F.col("n") - F.col("own")).alias("n")),
        )).alias("x"),
    )
    n = F.col("x.n")
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order and step: the counts of :data:`COUNTS`."""
    stacked = histograms(docs, labels, part).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("bins")  # a bin for each mask at most
    )
    steps = [(order, k + 1) for order in orders() for k in range(len(LETTERS))]

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = incidence()
        for batch in batches:
            for name, bins in zip(batch["part"], batch["bins"]):
                rows = np.zeros((3, 1 << len(LETTERS)), dtype=np.int64)
                for x in bins:
                    rows[:, x["mask"]] = x["n"], x["good"], x["toxic"]
                lost = rows @ matrix["removed"]
                yield pd.DataFrame({
                    "part": name,
                    "filter_order": [x[0] for x in steps],
                    "step": [x[1] for x in steps],
                    **{c: rows[0] @ matrix[c] for c in ("kept", "redundant", "unique_fails", "shapley")},
                    "removed": lost[0], "good_lost": lost[1], "toxic_lost": lost[2],
                })[["part", "filter_order", "step", *COUNTS]]

    return stacked.mapInPandas(multiply, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
