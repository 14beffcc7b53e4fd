"""Constellations as DataFrames of orbital elements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from satspan.functions.orbit import RE, two_pi
from satspan.operators.ranking import numbered_rows

ELEMENTS = "sat_idx sat_id shell_id plane_uid slot_id a_km ecc inc_rad raan_rad argp_rad m_rad".split()

#: Named shells: satellites, planes, phasing, altitude km, inclination degrees.
PRESETS = {
    "dual-1600": [(1200, 40, 1, 650.0, 48.0), (400, 20, 7, 650.0, 70.0)],
    "1200": [(1200, 40, 1, 650.0, 48.0)],
    "400-polar": [(400, 20, 7, 650.0, 70.0)],
    "800": [(800, 40, 1, 650.0, 48.0)],
    "400": [(400, 40, 1, 650.0, 48.0)],
    "200": [(200, 20, 1, 650.0, 48.0)],
}


def walker_angles(
    index: Column, total: Column, planes: Column, phasing: Column, raan0_deg: Column | None = None, phase0_deg: Column | None = None
) -> dict[str, Column]:
    """Plane, slot, node and mean anomaly of a Walker pattern's satellites."""
    slots = F.floor(total / planes)
    plane, slot = F.floor(index / slots), index % slots
    return {
        "plane_uid": plane.cast("long"),
        "slot_id": slot.cast("long"),
        "raan_rad": two_pi(F.radians((F.lit(0.0) if raan0_deg is None else raan0_deg) + plane * 360.0 / planes)),
        "m_rad": two_pi(F.radians((F.lit(0.0) if phase0_deg is None else phase0_deg) + slot * 360.0 / slots + plane * phasing * 360.0 / total)),
    }


def walker(
    spark: SparkSession, total: int, planes: int, phasing: int, altitude_km: float, inclination_deg: float, name: str = "shell",
    raan0_deg: float = 0.0, phase0_deg: float = 0.0,
) -> DataFrame:
    if total % planes:
        raise ValueError(f"{total} satellites do not divide into {planes} planes")
    angles = walker_angles(F.col("id"), F.lit(total), F.lit(planes), F.lit(phasing), F.lit(raan0_deg), F.lit(phase0_deg))
    return spark.range(total).withColumns(angles).select(
        F.col("id").alias("sat_idx"),
        F.concat(F.lit(f"{name}-P"), F.lpad("plane_uid", 2, "0"), F.lit("-S"), F.lpad("slot_id", 2, "0")).alias("sat_id"),
        F.lit(0).cast("long").alias("shell_id"), "plane_uid", "slot_id",
        F.lit(RE + altitude_km).alias("a_km"), F.lit(0.0).alias("ecc"),
        F.lit(math.radians(inclination_deg)).alias("inc_rad"), "raan_rad", F.lit(0.0).alias("argp_rad"), "m_rad",
    )


def _elements(rows: DataFrame, altitude: Column, inclination: Column, name: str) -> DataFrame:
    """Element columns of numbered circular satellites."""
    return rows.select(
        "sat_idx", F.format_string(f"{name}-%03d", "sat_idx").alias("sat_id"), F.lit(0).cast("long").alias("shell_id"),
        "plane_uid", "slot_id", (altitude + RE).alias("a_km"), F.lit(0.0).alias("ecc"),
        F.radians(inclination).alias("inc_rad"), "raan_rad", F.lit(0.0).alias("argp_rad"), "m_rad",
    )


def explicit_planes(planes: DataFrame, altitude_km: float, inclination_deg: float, name: str = "shell") -> DataFrame:
    """``planes(raan_rad, phase_rad ARRAY[, altitude_km, inclination_deg])``:
    one satellite per plane and phase, overrides coalesced with the template.

    Planes are the description of one shell, some tens of rows, so the windows
    that number them run over these only.
    """
    over = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in planes.columns else F.lit(d)
    order = Window.orderBy("raan_rad")
    numbered = planes.withColumns({
        "plane_uid": F.row_number().over(order).cast("long") - 1,
        "_before": F.coalesce(F.sum(F.size("phase_rad")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_alt": over("altitude_km", altitude_km), "_inc": over("inclination_deg", inclination_deg),
    })
    rows = numbered.select("*", F.posexplode("phase_rad").alias("_slot", "m_rad")).withColumns({
        "slot_id": F.col("_slot").cast("long"), "sat_idx": (F.col("_before") + F.col("_slot")).cast("long")
    })
    return _elements(rows, F.col("_alt"), F.col("_inc"), name)


def phase_slots(slots: DataFrame, altitude_km: float, inclination_deg: float, name: str = "shell") -> DataFrame:
    """``slots(slot, raan_rad, m_rad)``: one satellite per explicit slot; those of one
    (quantised) node share a plane."""
    rows = plane_groups(slots.withColumn("sat_idx", F.col("slot").cast("long")), "raan_rad")
    return _elements(slot_numbers(rows), F.lit(altitude_km), F.lit(inclination_deg), name)


def plane_groups(df: DataFrame, *cols: str) -> DataFrame:
    """Dense plane number of the quantised (3 decimals, half-even) columns.

    The distinct planes are ranked, not the rows: a plane is a row of the ranked
    table, which joins back.
    """
    keys = {f"_k{i}": F.rint(F.col(c) * 1000) for i, c in enumerate(cols)}
    keyed = df.withColumns(keys)
    planes = keyed.select(*keys).distinct()
    ranked = numbered_rows(planes, "plane_uid", *keys).select(*[F.col(k).alias(f"{k}r") for k in keys], F.col("plane_uid").cast("long"))
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"{k}r"))
        same = one if same is None else same & one
    return keyed.drop("plane_uid").join(ranked, same).drop(*keys, *[f"{k}r" for k in keys])


def slot_numbers(sats: DataFrame) -> DataFrame:
    """``slot_id``: a satellite's place in its plane, in the order of ``sat_idx``."""
    place = F.row_number().over(Window.partitionBy("plane_uid").orderBy("sat_idx"))
    return sats.withColumn("slot_id", (place - 1).cast("long"))


def bounds(sats: DataFrame, masks: Column | None = None) -> DataFrame:
    """One row: the highest apoapsis above the Earth's radius, and the smallest mask."""
    return sats.agg((F.max(F.col("a_km") * (1 + F.col("ecc"))) - RE).alias("max_altitude_km"), F.min(F.lit(None) if masks is None else masks).alias("min_mask_deg"))


def facts(sats: DataFrame) -> DataFrame:
    """One row: satellites, planes, mean altitude and inclination."""
    return sats.agg(
        F.count("*").alias("n_sats"), F.countDistinct("plane_uid").alias("n_planes"),
        (F.avg("a_km") - RE).alias("mean_altitude_km"), F.avg(F.degrees("inc_rad")).alias("mean_inclination_deg"),
    )


def lattice(sats: DataFrame, bin_km: float = 10.0) -> DataFrame:
    """Node, anomaly, plane and bin of the apoapsis altitude of every satellite."""
    top = F.col("a_km") * (1 + F.col("ecc")) - RE
    return sats.select("sat_idx", F.degrees("raan_rad").alias("raan_deg"), F.degrees("m_rad").alias("m_deg"), "plane_uid", (F.floor(top / bin_km) * bin_km).alias("altitude_bin_km"))


def seam_wrap(plane_from: Column, plane_to: Column, slot_from: Column, slot_to: Column, planes: int, slots: int) -> tuple[Column, Column]:
    """Plane and slot of a link's end, moved by one turn where the link crosses the
    seam of the lattice, so that the difference is at most half a turn."""

    def moved(a: Column, b: Column, n: int) -> Column:
        return F.when(b - a > n / 2, b - n).when(a - b > n / 2, b + n).otherwise(b)

    return moved(plane_from, plane_to, planes), moved(slot_from, slot_to, slots)


def concat_shells(shells: DataFrame) -> DataFrame:
    """Shift plane numbers so that shells do not share any; -1 stays unknown.

    ``shells(shell_id, plane_uid, ...)``; the window runs over the shells only.
    """
    per = shells.groupBy("shell_id").agg((F.greatest(F.max("plane_uid"), F.lit(-1)) + 1).alias("n_planes"))
    offsets = per.select(
        "shell_id", (F.sum("n_planes").over(Window.orderBy("shell_id")) - F.col("n_planes")).alias("offset")
    )
    return shells.join(offsets, "shell_id").withColumn(
        "plane_uid", F.when(F.col("plane_uid") < 0, F.lit(-1)).otherwise(F.col("plane_uid") + F.col("offset")).cast("long")
    ).drop("offset")


def preset(spark: SparkSession, name: str) -> DataFrame:
    shells = None
    for k, (t, p, f, alt, inc) in enumerate(PRESETS[name]):
        one = walker(spark, t, p, f, alt, inc, f"{name}-{k}").withColumn("shell_id", F.lit(k).cast("long"))
        shells = one if shells is None else shells.unionByName(one)
    return concat_shells(shells)
