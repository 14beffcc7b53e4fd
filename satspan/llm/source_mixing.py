"""Mixing sources to target weights: capped water-filling.

Each source asks for ``weight`` shares of the whole mix and can give at most
``max_epochs`` times its own words.  The water level L solves
``sum(min(cap, weight * L)) = total``; it is found by ordering the sources by
cap / weight and testing each prefix as the capped set, so no iteration is
needed (the largest level that leaves its own row below the cap is the right
one).  A source's rate target / size then gives whole repetitions of all its
documents, and a fractional one of a seeded random part of them: documents are
dealt to ``BUCKETS`` slices by a seeded hash, slice totals find the slice in
which the wanted words end, and only that slice is ordered row by row.  The one
document in which they end gives the missing words only.

Defined results: null text has size 0 and takes 0; the null source is a source
of its own, last in order; repeated rows are documents of their own; a mix of
no words takes none; ids may be null, repeated and of any type; extra columns
are ignored by ``plan`` and kept by ``mix``.  The table of sources (a row each)
meets in one task: the order by code point and the water level are over all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satspan.llm.common import materialize, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Slices of a source's documents; one slice of one source meets in a task.
BUCKETS = 1 << 12
#: Sources whose bounds are broadcast at most (100 bytes each); more are joined.
BROADCAST_SOURCES = 100_000
SEED = 20260101


def _seeded(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def row_key(seed: int) -> Column:
    """Where a document stands in the seeded order: by its id and its text."""
    return _seeded(seed, F.col("doc_id"), F.crc32(F.coalesce(F.col("text"), F.lit(""))))


def water_fill(sources: DataFrame, total: Column, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources(source, source_size, weight)`` with ``target``.

    One row per source: the window runs over the table of sources only.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (total - F.col("cap_before")) / F.col("weight_left")
    return (
        sources.withColumn("cap", cap)
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.when(level <= F.col("cap") / F.col("weight"), level))
        .withColumn("level", F.max("level").over(whole))
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))))
        .drop("cap", "cap_before", "weight_left", "level")
    )


def weigh(sizes: DataFrame, share: float = SHARE) -> DataFrame:
    """Per source its size, weight (5, 2, 1 by code-point order) and target."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (rank - 1) % len(WEIGHTS) + 1)
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("row_count").alias("row_count"))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    return water_fill(sources.withColumn("weight", weight).withColumn("total", total), F.col("total")).drop("total")


def plan(docs: DataFrame, seed: int = SEED, share: float = SHARE) -> DataFrame:
    """Per document ``size``, ``source_size``, ``target``, ``whole`` (repetitions
    that all documents of the source get), ``part`` (words of the fractional
    one), ``taken = whole * size + part`` and ``order``, its ``row_key``."""
    key = row_key(seed)
    rows = materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("order"))
        .withColumn("slice", F.pmod(F.shiftright("order", 20), F.lit(BUCKETS)).cast("int")),
        "mixing",
    )
    slices = materialize(
        rows.groupBy("source", "slice").agg(F.sum("size").alias("size"), F.count("*").alias("row_count")),
        "mixing-slices",
    )
    sources = weigh(slices, share).withColumns({
        "rate": F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)),
    }).withColumn("whole", F.floor(F.col("rate") + 1e-12).cast("long")).withColumn(
        "wanted", F.greatest(F.round(F.col("target") - F.col("whole") * F.col("source_size")), F.lit(0.0)).cast("long")
    ).drop("rate", "weight")
    # Words of the slices before each slice: at most BUCKETS rows per source.
    running = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    ends = (
        slices.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .alias("a").join(sources.alias("b"), same)
        .where("before <= wanted and before + size > wanted")
        .select("a.source", F.col("slice").alias("end_slice"), F.col("before").alias("end_before"))
    )
    bounds = (
        sources.alias("a").join(ends.alias("b"), same, "left")
        .select("a.*", F.coalesce("end_slice", F.lit(BUCKETS)).alias("end_slice"), F.coalesce("end_before", F.lit(0)).alias("end_before"))
        .drop("row_count")
    )
    bounds = materialize(bounds, "mixing-bounds")
    if bounds.count() <= BROADCAST_SOURCES:
        bounds = F.broadcast(bounds)
    joined = rows.alias("a").join(bounds.alias("b"), same).select(
        "a.*", "source_size", "target", "whole", "wanted", "end_slice", "end_before"
    )
    at_end = F.col("slice") == F.col("end_slice")
    plain = joined.where(~at_end).withColumn(
        "part", F.when(F.col("slice") < F.col("end_slice"), F.col("size")).otherwise(F.lit(0))
    )
    within = Window.partitionBy("source").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("wanted") - F.col("end_before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    edge = joined.where(at_end).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return plain.unionByName(edge).withColumn("taken", F.col("whole") * F.col("size") + F.col("part")).drop(
        "slice", "wanted", "end_slice", "end_before"
    )


def mix(docs: DataFrame, seed: int = SEED, share: float = SHARE) -> DataFrame:
    """The mixed documents with their own columns: a row for each whole
    repetition, and one more where the fractional one takes at least half of
    the document.  Rows are told apart by id, source and text; those equal in all
    three share the rounded mean of their repetitions."""
    copies = F.col("whole") + F.when((F.col("part") * 2 >= F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    counts = (
        plan(docs, seed, share).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("order").alias("_order"))
        .agg(F.round(F.avg(copies)).cast("int").alias("_copies")).where("_copies > 0")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_key") == F.col("_order"))
    return (
        docs.withColumn("_key", row_key(seed)).join(counts, same)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(*docs.columns)
    )
