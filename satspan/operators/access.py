"""Satellite states, and the pairs of cell and satellite in view."""

from __future__ import annotations

import math
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satspan.functions import orbit
from satspan.sources.grid import tile, tiles_near

#: Covers the ellipsoid: geodetic against geocentric latitude (0.19 degrees)
#: and the shorter polar radius (0.2 degrees of cap), with a margin.
SAFETY_DEG = 0.60
#: Keys that the states of one tile are dealt to.
SPLIT = 8
#: Cells that are few enough to go to every task (some 100 bytes each).
FEW_CELLS = 50_000


class Propagator(Protocol):
    """Anything that gives satellites their Earth-fixed states (``sat_idx, t_idx,
    x, y, z, sub_lat_deg, sub_lon_deg`` and the satellites' other columns)."""

    def __call__(self, satellites: DataFrame, times: DataFrame) -> DataFrame: ...


def two_body(satellites: DataFrame, times: DataFrame) -> DataFrame:
    return satellite_states(satellites, times, 0.0)


def satellite_states(satellites: DataFrame, times: DataFrame, j2: float = orbit.J2) -> DataFrame:
    """Earth-fixed position and sub-point of every satellite at every step.

    The time table has a row per step and is broadcast: its size is a parameter
    of the run, not of the data. Other key columns of ``satellites`` stay.
    """
    a, e, i = F.col("a_km"), F.col("ecc"), F.col("inc_rad")
    node_rate, perigee_rate, mean_rate = orbit.secular_rates(a, e, i, j2)
    rated = satellites.withColumns({"_dn": node_rate, "_dp": perigee_rate, "_dm": mean_rate})
    moved = rated.crossJoin(F.broadcast(times)).withColumns({
        "_node": F.col("raan_rad") + F.col("_dn") * F.col("t_s"),
        "_perigee": F.col("argp_rad") + F.col("_dp") * F.col("t_s"),
        "_mean": F.col("m_rad") + F.col("_dm") * F.col("t_s"),
    })
    x, y, z = orbit.eci_position(a, e, i, F.col("_node"), F.col("_perigee"), F.col("_mean"))
    inertial = moved.withColumns({"_x": x, "_y": y, "z": z})
    fx, fy = orbit.to_earth_fixed(F.col("_x"), F.col("_y"), F.col("gmst_rad"))
    fixed = inertial.withColumns({"x": fx, "y": fy})
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return fixed.withColumns({
        "sub_lat_deg": orbit.clipped_asin_deg(F.col("z") / r),
        "sub_lon_deg": F.degrees(F.atan2("y", "x")),
    }).drop("_dn", "_dp", "_dm", "_node", "_perigee", "_mean", "_x", "_y", "gmst_rad")


def ground_vectors(cells: DataFrame) -> DataFrame:
    """Cells with Earth-fixed position, up vector and tile."""
    lat, lon = F.col("lat_deg"), F.col("lon_deg")
    (cx, cy, cz), up = orbit.ground_position(lat, lon), orbit.local_axes(lat, lon)["up"]
    band, place = tile(lat, lon)
    return cells.withColumns({
        "cx": cx, "cy": cy, "cz": cz, "ux": up[0], "uy": up[1], "uz": up[2], "band": band, "place": place
    })


def look() -> tuple[Column, Column]:
    """Dot product of the line of sight with up, and its length."""
    dx, dy, dz = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("z") - F.col("cz")
    return dx * F.col("ux") + dy * F.col("uy") + dz * F.col("uz"), F.sqrt(dx * dx + dy * dy + dz * dz)


def azimuth_deg() -> Column:
    dx, dy, dz = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("z") - F.col("cz")
    axes = orbit.local_axes(F.col("lat_deg"), F.col("lon_deg"))
    e, n = (dx * axes[k][0] + dy * axes[k][1] + dz * axes[k][2] for k in ("east", "north"))
    return F.pmod(F.degrees(F.atan2(e, n)), F.lit(360.0))


def place() -> Column:
    """Where a cell lies: cells of one place see the same satellites."""
    return F.struct("lat_deg", "lon_deg")


def places_of(cells: DataFrame) -> DataFrame:
    """The distinct places of the cells, with the place itself as ``cell_idx``, and
    ``n_cells``, how many cells lie there."""
    return cells.groupBy("lat_deg", "lon_deg").agg(F.count("*").alias("n_cells")).withColumn("cell_idx", place())


def at_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows by place as rows of each cell there."""
    members = cells.select("cell_idx", place().alias("_place")).distinct()
    return members.join(rows.withColumnRenamed("cell_idx", "_place"), "_place").drop("_place")


#: Cells of a place that are given out together, about.
PART = 2_000


def pairs_at_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``at_cells`` for rows by place and satellite, with ``n_cells`` of ``places_of``:
    what comes out grows with cells times satellites and is far more than either.

    A place's cells come as lists of ``PART`` or so, and there is a task for as many
    cells, so neither a list nor the rows of a task grow with the cells of a place.  A
    task takes one list after the other and gives a row to a whole list at once: columns
    of rows hold one value for long, that of cells a short series again and again, and
    files of the rows take a few bits a row where cells in the outer place take bytes.
    """
    spark = cells.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, cells.count() // PART)
    # The place's hash is the key of the join: with the place itself, whose doubles Spark
    # normalises, both sides would be dealt again, to as many tasks as their bytes ask for.
    keys = ["_dealt", "_part"]
    n_parts, dealt = F.ceil(F.col("n_cells") / PART), F.xxhash64("_place")
    lists = (
        cells.select("cell_idx", place().alias("_place"))
        .withColumn("n_cells", F.count("*").over(Window.partitionBy("_place")))
        .withColumns({"_dealt": dealt, "_part": F.pmod(F.hash("cell_idx").cast("long"), n_parts)})
        .repartition(tasks, *keys).groupBy(*keys, F.col("_place").alias("_at")).agg(F.array_sort(F.collect_set("cell_idx")).alias("_cells"))
    )
    given = rows.withColumnRenamed("cell_idx", "_place").withColumns({
        "_dealt": dealt, "_part": F.explode(F.sequence(F.lit(0).cast("long"), n_parts - 1))
    }).drop("n_cells").repartition(tasks, *keys)
    here = F.when(F.col("_place") == F.col("_at"), F.col("_cells"))  # two places may share a hash
    found = given.join(lists.hint("merge"), keys)
    return found.select(F.explode(here).alias("cell_idx"), *[c for c in rows.columns if c not in ("cell_idx", "n_cells")])


#: Where a pair was worked out: all steps of a cell and a satellite share it.
DEALT = ["_band", "_tile_place", "_split"]


def in_view(
    cells: DataFrame, states: DataFrame, mask_deg: float, max_altitude_km: float | None = None, tiled: bool = True, split: int = SPLIT,
    dealt: bool = False,
) -> DataFrame:
    """Rows (cell, satellite, step) with elevation at or above the mask.

    ``tiled`` joins on 5-degree tiles: each state goes to the tiles that its
    ground cap touches, each cell to its own, so only near pairs are formed;
    without it all pairs are (the form that tests compare with).  The exact
    filter follows either way.  The cap is that of the state's own distance,
    which no orbit's a(1 + e) is below; ``max_altitude_km`` bounds nothing any
    more and stays for callers that give it.  A tile's states are dealt to
    ``split`` keys by their step and its cells go to each of them, so a region
    of a few tiles still spreads over ``split`` times as many tasks.  ``dealt``
    deals them by satellite instead and keeps the columns ``DEALT``: what groups
    by these, cell and satellite needs no shuffle of the pairs.

    Where cells are ``FEW_CELLS`` at most (they are counted), they go to every task
    instead, and a state's tiles are not shuffled: its pairs are formed where the
    satellite is, so what groups by cell and satellite needs no shuffle either and
    there is nothing to deal.
    """
    ground = ground_vectors(cells)
    if tiled:
        distance = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
        radius = orbit.cap_half_angle_of(distance, mask_deg) + SAFETY_DEG
        # The states come from few satellites, often of one file; their tiles are worked out by many tasks.
        parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        near = states.repartition(parts, "sat_idx").withColumn("_tile", F.explode(tiles_near(F.col("sub_lat_deg"), F.col("sub_lon_deg"), radius)))
        near = near.withColumns({"band": F.col("_tile.band"), "place": F.col("_tile.place")}).drop("_tile")
    if tiled and cells.limit(FEW_CELLS + 1).count() <= FEW_CELLS:
        pairs = F.broadcast(ground).join(near, ["band", "place"])
    elif tiled:
        key = F.pmod(F.hash("sat_idx") if dealt else F.col("t_idx"), F.lit(split)).cast("int")
        ground = ground.withColumn("_split", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))
        # A number of partitions that stays: few bytes of states make many pairs.
        near = near.withColumn("_split", key).repartition(parts, "band", "place", "_split")
        pairs = ground.join(near, ["band", "place", "_split"])
        kept = dict(zip(("band", "place"), DEALT))
        pairs = pairs.withColumnsRenamed(kept) if dealt else pairs.drop("_split")
    else:
        pairs = ground.crossJoin(states)
    dot, length = look()
    return (
        pairs.withColumns({"_dot": dot, "_rng": length})
        .where(F.col("_dot") >= math.sin(math.radians(mask_deg)) * F.col("_rng"))
        .withColumn("elev_deg", orbit.clipped_asin_deg(F.col("_dot") / F.col("_rng")))
        .drop("_dot", "_rng", "band", "place")
    )


def ground_speed_km_s(altitude_km: float) -> float:
    """Speed of the sub-point of a circular orbit over a resting Earth."""
    return orbit.RE * math.sqrt(orbit.MU / (orbit.RE + altitude_km) ** 3)


#: Km of a degree of arc, and the margin of the search circle.
KM_PER_DEG = 111.195
MARGIN_DEG = 0.30


def dilation_deg(altitude_km: float, mask_deg: float, cell_radius_deg: float, step_s: float) -> float:
    """Radius around a cell's centre that holds the sub-points of all satellites
    that any of the cell sees within half a step."""
    halo = ground_speed_km_s(altitude_km) * step_s / 2 / KM_PER_DEG
    return orbit.cap_half_angle_deg(altitude_km, mask_deg) + cell_radius_deg + halo + MARGIN_DEG


def dilation_of(altitude_km: Column, mask_deg: Column, cell_radius_deg: float, step_s: float) -> Column:
    """The same for columns."""
    r = F.lit(orbit.RE) + altitude_km
    cap = F.lit(90.0) - mask_deg - F.degrees(F.asin(F.lit(orbit.RE) / r * F.cos(F.radians(mask_deg))))
    halo = orbit.RE * F.sqrt(F.lit(orbit.MU) / (r * r * r)) * (step_s / 2 / KM_PER_DEG)
    return cap + cell_radius_deg + halo + MARGIN_DEG


def above_terrain(access: DataFrame, masks: DataFrame, mask_deg: float, n_bins: int) -> DataFrame:
    """The pairs whose elevation reaches the mask and the horizon of the azimuth
    bin; ``masks(cell_idx, az_bin, mask_deg)``, a bin without a row is open."""
    az_bin = F.least(F.floor(azimuth_deg() * n_bins / 360), F.lit(n_bins - 1))
    held = masks.select("cell_idx", "az_bin", F.col("mask_deg").alias("_mask"))
    return access.withColumn("az_bin", az_bin).join(held, ["cell_idx", "az_bin"], "left").where(
        F.col("elev_deg") >= F.greatest(F.lit(mask_deg), F.coalesce("_mask", F.lit(0.0)))
    ).drop("_mask")
