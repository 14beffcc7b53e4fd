"""The flagship plan and parameter sweeps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from satspan.functions.orbit import RE
from satspan.operators import continuity
from satspan.operators.access import Propagator, above_terrain, in_view, place, places_of, satellite_states, two_body
from satspan.operators.coverage import coverage, over_cells, summary
from satspan.sources.constellation import plane_groups, walker_angles
from satspan.operators.ranking import numbered_rows
from satspan.sources.entities import EntityStore, elements
from satspan.sources.grid import EPOCH_JD, julian_day, time_steps
from satspan.sources.shared import written


#: Cell, satellite and step triples a second of the usual estimate.
WORK_PER_S = 10e6


def run_coverage(
    cells: DataFrame, satellites: DataFrame, n_steps: int, step_s: float, mask_deg: float | list[float] = 25.0,
    ks: tuple[int, ...] = (1, 2), tiled: bool = True, overlap_s: float | None = None, different_plane: bool = False,
    terrain: DataFrame | None = None, n_bins: int = 36, propagate: Propagator = satellite_states, epoch_jd: float = EPOCH_JD,
    least_overlap: int | None = None,
) -> DataFrame:
    """Availability of every cell under a constellation.

    ``mask_deg`` may list the masks of several shells: the least one holds for
    all.  ``overlap_s``, or ``least_overlap`` in steps, asks for handover chains too
    (see ``continuity_map``);
    ``terrain(cell_idx, az_bin, mask_deg)`` raises the mask by azimuth.
    """
    mask = min(mask_deg) if isinstance(mask_deg, (list, tuple)) else mask_deg
    if overlap_s is not None:
        continuity.check_sampling(overlap_s, step_s)
    if cells.isEmpty():
        raise ValueError("the area holds no cells")
    times = time_steps(cells.sparkSession, n_steps, step_s, epoch_jd)
    # Cells of one place have the same row, unless the terrain tells them apart.
    where = cells if terrain is not None else places_of(cells)
    gated = overlap_s is not None or least_overlap is not None
    access = in_view(where, propagate(satellites, times), mask, tiled=tiled, dealt=gated)
    if terrain is not None:
        access = above_terrain(access, terrain, mask, n_bins)
    if not gated:
        rows = coverage(where, access, n_steps, ks)
    else:
        # Counts and chains are two uses: the runs are worked out and written once.
        runs = written(continuity.runs_in_view(access, ["cell_idx"], n_steps, different_plane), "runs")
        chains = continuity.continuity_map(where, runs, n_steps, step_s, overlap_s or 0.0, different_plane, least_overlap=least_overlap)
        rows = coverage(where, continuity.counts_of(runs, "cell_idx"), n_steps, ks).join(chains, "cell_idx")
    if terrain is not None:
        return rows
    same = cells.withColumn("_place", place())
    found = rows.select(F.col("cell_idx").alias("_place"), *[c for c in rows.columns if c not in ("cell_idx", "lat_deg", "lon_deg", "n_cells")])
    return same.join(found, "_place").drop("_place")


def workload(n_cells: int, n_steps: int, n_sats: int, gate: bool = False) -> tuple[int, float]:
    """Triples of cell, step and satellite, and the estimated seconds."""
    work = n_cells * n_steps * n_sats
    return work, work / WORK_PER_S * (2 if gate else 1)


def pull_and_cover(store: EntityStore, cells: DataFrame, n_steps: int, step_s: float, mask_deg: float = 25.0, ref_epoch_s: int | None = None, **options) -> DataFrame:
    """Coverage by the platforms of a snapshot that can be propagated.

    Elements are brought to the reference epoch; the steps start at ``epoch_jd``
    (2026-01-01 unless given), as in the method that this follows: the elements
    are not moved from the reference epoch to the first step.
    """
    return run_coverage(cells, numbered_satellites(store, ref_epoch_s), n_steps, step_s, mask_deg, **options)


def numbered_satellites(store: EntityStore, ref_epoch_s: int | None = None) -> DataFrame:
    """The served platforms as satellites; an error if there is none."""
    found = elements(store, ref_epoch_s)
    if found.isEmpty():
        raise ValueError("no platform of the snapshot can be propagated")
    rows = plane_groups(found, "raan_rad", "inc_rad", "a_km")
    return numbered_rows(rows, "sat_idx", "sat_id")


def at_points(points: DataFrame, satellites: DataFrame, n_steps: int, step_s: float, ref_epoch_s: float, mask_deg: float = 10.0, ks: tuple[int, ...] = (1, 2)) -> DataFrame:
    """The engine's availability at observed points, from the reference epoch on, by
    two-body motion."""
    cells = points.select("lat_deg", "lon_deg").distinct().withColumn("cell_idx", F.xxhash64("lat_deg", "lon_deg"))
    return run_coverage(cells, satellites, n_steps, step_s, mask_deg, ks, propagate=two_body, epoch_jd=julian_day(ref_epoch_s)).drop("cell_idx")


def compare(engine: DataFrame, observed: DataFrame, k: int = 1) -> DataFrame:
    """Per point both availabilities and ``delta`` (engine less observed); points
    of one side only are kept with a null delta."""
    side = lambda df, name: df.select("lat_deg", "lon_deg", F.col(f"availability_k{k}").alias(name))
    return side(engine, "engine").join(side(observed, "observed"), ["lat_deg", "lon_deg"], "full").withColumn("delta", F.col("engine") - F.col("observed"))


def delta_summary(compared: DataFrame, close: float = 0.01) -> DataFrame:
    """One row: points, mean and largest delta, share within ``close``."""
    d = F.col("delta")
    return compared.where(d.isNotNull()).agg(
        F.count("*").alias("n_points"), F.avg(d).alias("mean_delta"), F.max(F.abs(d)).alias("max_abs_delta"),
        F.avg(F.when(F.abs(d) <= close, 1.0).otherwise(0.0)).alias("share_close"),
    )


#: What names a candidate of a sweep.
CANDIDATE = ["n_sats", "planes", "inclination_deg"]
MAX_SHAPES = 256


def inclinations(low: float, high: float, step: float) -> list[float]:
    """Inclinations from low to high, both included, to a tenth of a degree."""
    step = max(step, 0.1)
    return [round(low + i * step, 1) for i in range(int((high - low) / step + 1e-9) + 1)]


def shapes(spark: SparkSession, planes: list[int], per_plane: list[int], inclination_deg: list[float]) -> DataFrame:
    """``n_sats, planes, inclination_deg`` of every combination; an error where
    there are more than MAX_SHAPES of planes and satellites per plane."""
    if len(planes) * len(per_plane) > MAX_SHAPES:
        raise ValueError(f"{len(planes) * len(per_plane)} shapes; {MAX_SHAPES} is the most")
    rows = [(p * s, p, float(i)) for p in planes for s in per_plane for i in inclination_deg]
    return spark.createDataFrame(rows, "n_sats long, planes long, inclination_deg double")


def sizes_of(spark: SparkSession, sizes: list[int], planes: int, inclination_deg: list[float]) -> DataFrame:
    """``n_sats, planes, inclination_deg`` of every size at every inclination."""
    for n in sizes:
        if n % planes:
            raise ValueError(f"{n} satellites do not divide into {planes} planes")
    return spark.createDataFrame([(n, planes, float(i)) for n in sizes for i in inclination_deg], "n_sats long, planes long, inclination_deg double")


def candidate_satellites(candidates_: DataFrame, altitude_km: float, phasing: int = 1) -> DataFrame:
    """All candidates' Walker satellites in one table, with the candidate's columns."""
    sats = candidates_.withColumn("sat_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_sats") - 1)))
    return sats.withColumns({
        **walker_angles(F.col("sat_idx"), F.col("n_sats"), F.col("planes"), F.least(F.lit(phasing), F.col("planes") - 1)),
        "a_km": F.lit(RE + altitude_km), "ecc": F.lit(0.0), "inc_rad": F.radians("inclination_deg"), "argp_rad": F.lit(0.0),
    })


def shape_sweep(
    cells: DataFrame, candidates_: DataFrame, altitude_km: float, n_steps: int, step_s: float, target: float, mask_deg: float = 25.0,
    ks: tuple[int, ...] = (1, 2), overlap_s: float | None = None, grade: float = 0.95, phasing: int = 1,
) -> DataFrame:
    """One job over all candidates: a summary row by candidate.

    With ``overlap_s`` also ``pct_mbb``, the share of cells with a handover
    chain, and ``mbb_pass``, whether that reaches the grade.
    """
    spark = cells.sparkSession
    keys = ("cell_idx", *CANDIDATE)
    sats = candidate_satellites(candidates_, altitude_km, phasing)
    places = places_of(cells)
    access = in_view(places, satellite_states(sats, time_steps(spark, n_steps, step_s)), mask_deg, dealt=overlap_s is not None)
    if overlap_s is not None:
        runs = written(continuity.runs_in_view(access, list(keys), n_steps), "runs")
        access = continuity.counts_of(runs, *keys)
    every = places.crossJoin(F.broadcast(candidates_.select(*CANDIDATE)))  # MAX_SHAPES candidates, or a list of sizes
    rows = coverage(every, access, n_steps, ks, keys)
    gate = [F.lit(None).cast("double").alias("pct_mbb")]
    if overlap_s is not None:
        chains = continuity.continuity_map(every.select(*keys), runs, n_steps, step_s, overlap_s, keys=keys)
        rows = rows.join(chains.select(*keys, "mbb_feasible"), list(keys))
        gate = [over_cells(F.col("mbb_feasible").cast("double")).alias("pct_mbb")]
    aggs = [over_cells(F.col("sats_in_view_mean")).alias("mean_sats_in_view"), *gate]
    for k in ks:
        a = F.col(f"availability_k{k}")
        aggs += [over_cells(F.when(a >= target, 1.0).otherwise(0.0)).alias(f"pct_k{k}"), over_cells(a).alias(f"mean_avail_k{k}")]
    out = rows.groupBy(*CANDIDATE).agg(*aggs).withColumns({
        "sats_per_plane": F.floor(F.col("n_sats") / F.col("planes")), "mbb_pass": F.col("pct_mbb") >= grade
    })
    return out


def passing(rows: DataFrame, grade: float, ks: tuple[int, ...] = (1, 2), gate: bool = False) -> DataFrame:
    """``passed``: every k reaches the grade, and with a gate the chains do."""
    ok = F.lit(True)
    for k in ks:
        ok = ok & (F.col(f"pct_k{k}") >= grade)
    return rows.withColumn("passed", ok & F.coalesce("mbb_pass", F.lit(False)) if gate else ok)


def smallest_by(rows: DataFrame, grade: float, ks: tuple[int, ...] = (1, 2), group: str = "inclination_deg") -> DataFrame:
    """Per group the least size per k that meets the grade, and of those whose
    chains pass (``min_n_mbb``); null if none does."""
    sizes = [F.min(F.when(F.col(f"pct_k{k}") >= grade, F.col("n_sats"))).alias(f"min_n_k{k}") for k in ks]
    return rows.groupBy(group).agg(*sizes, F.min(F.when(F.col("mbb_pass"), F.col("n_sats"))).alias("min_n_mbb"))


def best_inclination(smallest_rows: DataFrame, ks: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Per k the inclination of the least size, the lowest on ties."""
    first = lambda k: F.min(F.when(F.col(f"min_n_k{k}").isNotNull(), F.struct(F.col(f"min_n_k{k}").alias("n"), F.col("inclination_deg").alias("i"))))
    one = smallest_rows.agg(*[first(k).alias(f"b{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"b{k}.n").alias("min_n"), F.col(f"b{k}.i").alias("inclination_deg")) for k in ks])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def long_rows(rows: DataFrame, ks: tuple[int, ...] = (1, 2)) -> DataFrame:
    """A row per candidate and k: the table behind the sweep charts."""
    each = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"pct_k{k}").alias("pct"), F.col(f"mean_avail_k{k}").alias("mean_avail")) for k in ks])
    return rows.select(*CANDIDATE, F.explode(each).alias("r"), F.coalesce(~F.col("mbb_pass"), F.lit(False)).alias("gate_failed")).select(*CANDIDATE, "r.*", "gate_failed")


def shape_heatmap(rows: DataFrame, per_plane: list[int], value: str = "pct_k1") -> DataFrame:
    """Planes down, satellites per plane across."""
    return rows.groupBy("planes").pivot("sats_per_plane", per_plane).agg(F.max(value))


def run_sweep(spark: SparkSession, cells: DataFrame, sizes=None, planes=(40,), per_plane=None, inclination_deg=(48.0,), **options) -> tuple[str, DataFrame]:
    """The sweep that the given ranges ask for, with its name: several planes or
    satellites per plane are shapes, several inclinations are inclinations, else
    the sizes are swept."""
    if per_plane is not None:
        return "multi_shape", shape_sweep(cells, shapes(spark, list(planes), list(per_plane), list(inclination_deg)), **options)
    table = sizes_of(spark, list(sizes), planes[0], list(inclination_deg))
    return ("min_n_vs_inclination" if len(inclination_deg) > 1 else "coverage_vs_n"), shape_sweep(cells, table, **options)


def candidates(spark: SparkSession, sizes: list[int], planes: int, altitude_km: float, inclination_deg: float, phasing: int = 1) -> DataFrame:
    """All candidates' satellites in one table with the key ``n_sats``."""
    for n in sizes:
        if n % planes:
            raise ValueError(f"{n} satellites do not divide into {planes} planes")
    table = spark.range(1).select(F.explode(F.array(*[F.lit(n).cast("long") for n in sizes])).alias("n_sats"))
    sats = table.withColumn("sat_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_sats") - 1)))
    return sats.withColumns({
        **walker_angles(F.col("sat_idx"), F.col("n_sats"), F.lit(planes), F.lit(min(phasing, planes - 1))),
        "a_km": F.lit(RE + altitude_km), "ecc": F.lit(0.0), "inc_rad": F.lit(math.radians(inclination_deg)), "argp_rad": F.lit(0.0),
    })


def sweep(
    cells: DataFrame, sats: DataFrame, n_steps: int, step_s: float, target: float, mask_deg: float = 25.0
) -> DataFrame:
    """One job over all candidates: summary rows by ``n_sats``."""
    spark = cells.sparkSession
    places = places_of(cells)
    access = in_view(places, satellite_states(sats, time_steps(spark, n_steps, step_s)), mask_deg)
    every = places.crossJoin(F.broadcast(sats.select("n_sats").distinct()))  # as many rows as candidates
    return summary(coverage(every, access, n_steps, keys=("cell_idx", "n_sats")), "n_sats", target)


def smallest(rows: DataFrame, grade: float, ks: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Least size per k that meets the grade; null if none does."""
    return rows.agg(*[F.min(F.when(F.col(f"pct_k{k}") >= grade, F.col("n_sats"))).alias(f"min_n_k{k}") for k in ks])


def winner(rows: DataFrame, passed: str, *order: str) -> DataFrame:
    """Flags the single first passing row in lexicographic order."""
    place = F.row_number().over(Window.partitionBy(passed).orderBy(*order))
    return rows.withColumn("is_winner", F.col(passed) & (place == 1))
