"""Contact intervals, gaps and make-before-break handover chains."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satspan.operators.access import DEALT


def intervals(access: DataFrame, keys: list[str], step: str = "t_idx") -> DataFrame:
    """Maximal runs of consecutive steps per key, with inclusive ends.  Pairs that
    are dealt by satellite (see ``in_view``) are not shuffled for it."""
    dealt = DEALT if {"sat_idx", *DEALT} <= {*keys, *access.columns} and "sat_idx" in keys else []
    order = Window.partitionBy(*dealt, *keys).orderBy(step)
    island = F.col(step) - F.row_number().over(order)
    return (
        access.select(*dealt, *keys, step).distinct().withColumn("_island", island)
        .groupBy(*dealt, *keys, "_island").agg(F.min(step).alias("start_idx"), F.max(step).alias("end_idx"))
        .drop("_island", *dealt)
    )


#: Steps that are held by one whole number.
WORD = 62


def runs_in_view(access: DataFrame, keys: list[str], n_time: int, by_plane: bool = False) -> DataFrame:
    """``keys, start_idx, end_idx, n_runs``: how many maximal runs of steps have these
    ends (``by_plane``: also ``plane_uid``, of satellites of one plane).

    A satellite's steps are the bits of ``n_time / WORD`` whole numbers, so pairs are
    neither sorted nor, where a satellite's pairs of a cell lie together (see
    ``in_view``), shuffled; the satellites with equal steps are counted before runs are
    told apart.  There are ``n_time`` squared rows for a key at most (by plane), however
    many satellites.
    """
    words = [f"_word{i}" for i in range(-(-n_time // WORD))]
    dealt = [c for c in DEALT if c in access.columns]
    known = ["plane_uid"] if "plane_uid" in access.columns else []
    plane = known if by_plane else []
    t, none = F.col("t_idx"), F.lit(0).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (t % WORD).cast("int"))
    held = [F.bit_or(F.when(F.floor(t / WORD) == i, bit).otherwise(none)).alias(w) for i, w in enumerate(words)]
    by_sat = access.groupBy(*dealt, *keys, *known, "sat_idx").agg(*held, F.count("*").alias("_rows"))
    # A satellite that is listed twice counts twice.
    times = F.col("_rows") / sum((F.bit_count(w) for w in words), F.lit(0))
    alike = by_sat.groupBy(*keys, *plane, *words).agg(F.sum(times).cast("long").alias("_times"))
    seen = lambda i: F.getbit(F.get(F.array(*words), F.floor(i / WORD).cast("int")), (i % WORD).cast("int")) == 1
    on = F.filter(F.sequence(none, F.lit(n_time - 1).cast("long")), seen)
    ends = F.arrays_zip(
        F.array_except("_on", F.transform("_on", lambda i: i + 1)).alias("s"), F.array_except("_on", F.transform("_on", lambda i: i - 1)).alias("e")
    )
    runs = alike.withColumn("_on", on).select(*keys, *plane, "_times", F.explode(ends).alias("_run"))
    return runs.groupBy(*keys, *plane, F.col("_run.s").alias("start_idx"), F.col("_run.e").alias("end_idx")).agg(F.sum("_times").alias("n_runs"))


def counts_of(runs: DataFrame, *keys: str) -> DataFrame:
    """``n_in_view`` per key and step from the runs in view."""
    steps = runs.select(*keys, F.explode(F.sequence("start_idx", "end_idx")).alias("t_idx"), "n_runs")
    return steps.groupBy(*keys, "t_idx").agg(F.sum("n_runs").alias("n_in_view"))


def worst_gap(cells: DataFrame, access: DataFrame, n_time: int, key: str = "cell_idx") -> DataFrame:
    """Longest run of steps without a satellite; all steps where there is none."""
    covered = access.select(key, "t_idx").distinct()
    ends = cells.select(key).withColumn("t_idx", F.explode(F.array(F.lit(-1), F.lit(n_time)).cast("array<bigint>")))
    steps = covered.unionByName(ends)
    gap = F.lead("t_idx").over(Window.partitionBy(key).orderBy("t_idx")) - F.col("t_idx") - 1
    return steps.withColumn("_gap", gap).groupBy(key).agg(F.max("_gap").cast("long").alias("worst_gap_steps"))


def handover(
    spans: DataFrame, n_time: int, least_overlap: int = 1, different_plane: bool = False, key: str = "cell_idx",
    different_sat: bool = True, cells: DataFrame | None = None,
) -> DataFrame:
    """Widest path over a cell's intervals from the first to the last step.

    ``spans(key, sat_idx, start_idx, end_idx[, plane_uid])``; a chain moves to a
    later-ending interval (of another satellite, of another plane) that overlaps
    by ``least_overlap`` steps or more.  Per cell: whether a chain spans all
    steps, its smallest overlap (-1 for none), number of handovers (-1 if
    infeasible) and the longest run of steps that no interval covers (0 if
    feasible).  ``cells`` names all cells, so that those without an interval stay.

    Intervals of one cell are sorted by end and folded in the row.  An interval
    is carried on only while a later one can still overlap it: those that ended
    before the start of every later one are let go.  Of those with one end, an
    interval is carried only while fewer than two (with ``different_plane`` three)
    before it are as wide and of different satellites (planes): whatever comes
    later finds one of these first.  So the fold holds some per end and width,
    however many are in view at once.
    """
    plane = F.col("plane_uid") if "plane_uid" in spans.columns else F.lit(-1)
    spans = spans.select(
        key,
        F.struct(
            F.col("end_idx").cast("long").alias("e"), F.col("start_idx").cast("long").alias("s"),
            F.col("sat_idx").cast("long").alias("sat"), plane.cast("long").alias("p"),
        ).alias("v"),
    )
    # The least start of the intervals from here on: what ended before is let go.
    rest = Window.partitionBy(key).orderBy(F.desc("v.e"), F.desc("v.s"), F.desc("v.sat")).rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("v", F.col("v").withField("low", F.min("v.s").over(rest)))
    least = max(1, least_overlap)
    whole = F.lit(n_time).cast("long")
    state = "array<struct<e:bigint,s:bigint,sat:bigint,p:bigint,width:bigint,hops:bigint>>"

    def extend(done, v):
        # The best way into v: a source has width n_time and no handover.
        start = F.struct(
            F.when(v["s"] <= 0, whole).otherwise(F.lit(-1).cast("long")).alias("width"), F.lit(0).cast("long").alias("hops")
        )

        def better(best, u):
            overlap = u["e"] - v["s"] + 1
            fits = (u["e"] < v["e"]) & (overlap >= least) & (u["width"] > 0)
            if different_sat:
                fits = fits & (u["sat"] != v["sat"])
            if different_plane:
                fits = fits & (u["p"] != v["p"]) & (u["p"] >= 0) & (v["p"] >= 0)
            width = F.least(u["width"], overlap)
            return F.when(fits & (width > best["width"]), F.struct(width.alias("width"), (u["hops"] + 1).alias("hops"))).otherwise(best)

        # An interval that no chain reaches is not carried on.
        found = F.transform(
            F.array(F.aggregate(done, start, better)),
            lambda b: F.struct(v["e"].alias("e"), v["s"].alias("s"), v["sat"].alias("sat"), v["p"].alias("p"), b["width"].alias("width"), b["hops"].alias("hops")),
        )
        open_ = F.filter(done, lambda u: (u["e"] - v["low"] + 1 >= least) | (u["e"] >= n_time - 1))
        return F.concat(open_, F.filter(found, lambda x: (x["width"] > 0) & ~needless(done, x)))

    def needless(done, x):
        # Every later interval may follow one of those before x with its end and at least its width.
        same = F.filter(done, lambda u: (u["e"] == x["e"]) & (u["width"] >= x["width"]))
        sats = F.size(F.array_distinct(F.transform(same, lambda u: u["sat"])))
        if not different_plane:
            return sats >= (2 if different_sat else 1)
        known = F.filter(same, lambda u: u["p"] >= 0)
        planes = F.size(F.array_distinct(F.transform(known, lambda u: u["p"])))
        pairs = F.size(F.array_distinct(F.transform(known, lambda u: F.struct(u["sat"], u["p"]))))
        one_plane = pairs == F.size(F.array_distinct(F.transform(known, lambda u: u["sat"])))
        return (planes >= 3) & one_plane if different_sat else planes >= 2

    none = F.struct(F.lit(-1).cast("long").alias("width"), F.lit(-1).cast("long").alias("hops"))
    chains = spans.groupBy(key).agg(F.array_sort(F.collect_list("v")).alias("v")).withColumn(
        "chains", F.aggregate("v", F.array().cast(state), extend)
    )
    goals = F.filter("chains", lambda c: (c["e"] >= n_time - 1) & (c["width"] > 0))
    best = F.aggregate(
        goals, none,
        lambda b, c: F.when(c["width"] > b["width"], F.struct(c["width"].alias("width"), c["hops"].alias("hops"))).otherwise(b),
    )
    # The union of the intervals, sorted by start: where it is open.
    gap = F.aggregate(
        F.array_sort(F.transform("v", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))),
        F.struct(F.lit(0).cast("long").alias("next"), F.lit(0).cast("long").alias("gap")),
        lambda a, x: F.struct(F.greatest(a["next"], x["e"] + 1).alias("next"), F.greatest(a["gap"], x["s"] - a["next"]).alias("gap")),
        lambda a: F.greatest(a["gap"], F.lit(n_time) - a["next"]),
    )
    found = chains.withColumns({"best": best, "_gap": gap}).select(
        key,
        (F.col("best.width") > 0).alias("feasible"),
        F.when(F.col("best.hops") > 0, F.col("best.width")).otherwise(F.lit(-1)).cast("long").alias("worst_overlap"),
        F.col("best.hops").alias("n_handovers"),
        F.when(F.col("best.width") > 0, 0).otherwise(F.col("_gap")).cast("long").alias("worst_gap_steps"),
    )
    if cells is None:
        return found
    missing = {"worst_overlap": -1, "n_handovers": -1, "worst_gap_steps": n_time}
    return cells.select(key).join(found, key, "left").fillna(False, ["feasible"]).fillna(missing)


def chains_of(runs: DataFrame, n_time: int, least_overlap: int = 1, different_plane: bool = False, key: str = "cell_idx", cells: DataFrame | None = None) -> DataFrame:
    """``handover`` over the runs in view.  Two runs of one satellite have a step between
    them, so runs that overlap are of different satellites, and those with the same
    ends (and plane) can stand for each other."""
    spans = runs.withColumn("sat_idx", F.lit(0).cast("long"))
    return handover(spans, n_time, least_overlap, different_plane, key, False, cells)


def needed_steps(overlap_s: float, step_s: float) -> int:
    """Steps of an overlap; one for none."""
    return math.ceil(overlap_s / step_s - 1e-9) + 1 if overlap_s > 0 else 1


def check_sampling(overlap_s: float | None, step_s: float) -> None:
    if overlap_s and step_s > 0.5 * overlap_s:
        raise ValueError(f"a step of {step_s} s cannot tell an overlap of {overlap_s} s; half of it is the most")


def continuity_map(
    cells: DataFrame, access: DataFrame, n_time: int, step_s: float, overlap_s: float = 0.0, different_plane: bool = False,
    keys: tuple[str, ...] = ("cell_idx",), least_overlap: int | None = None,
) -> DataFrame:
    """Per cell ``mbb_feasible``, ``mbb_overlap_worst_s`` (-1 without a handover),
    ``mbb_n_handovers`` and ``mbb_worst_gap_s``; every cell has a row.

    ``access`` by pair, or its ``runs_in_view``; ``least_overlap`` gives the steps of an
    overlap in place of ``overlap_s``."""
    check_sampling(overlap_s, step_s)
    key = "_key"
    made = F.struct(*keys)
    runs = access if "n_runs" in access.columns else runs_in_view(access, list(keys), n_time, different_plane)
    least = needed_steps(overlap_s, step_s) if least_overlap is None else least_overlap
    found = chains_of(runs.withColumn(key, made), n_time, least, different_plane, key, cells.withColumn(key, made))
    overlap = F.when(F.col("worst_overlap") < 0, -1.0).otherwise((F.col("worst_overlap") - 1) * float(step_s))
    return found.select(
        *[F.col(f"{key}.{k}").alias(k) for k in keys], F.col("feasible").alias("mbb_feasible"), overlap.alias("mbb_overlap_worst_s"),
        F.col("n_handovers").alias("mbb_n_handovers"), (F.col("worst_gap_steps") * float(step_s)).alias("mbb_worst_gap_s"),
    )


def timeline(links: DataFrame, unit: str, time: str, tail: int = 900) -> DataFrame:
    """Each link's end: the unit's next start, else the last start plus ``tail``."""
    last = links.agg(F.max(time).alias("_last"))  # one row
    return (
        links.withColumn("_next", F.lead(time).over(Window.partitionBy(unit).orderBy(time)))
        .crossJoin(F.broadcast(last))
        .withColumn("end_s", F.coalesce("_next", F.col("_last") + tail))
        .drop("_next", "_last")
    )
