"""Areas, ground cells, time steps and tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satspan.functions.orbit import gmst
from satspan.operators.ranking import numbered_rows

#: Named areas: least and greatest latitude and longitude.
AREAS = {
    "India": (6.0, 38.0, 68.0, 98.0),
    "CONUS": (24.0, 50.0, -125.0, -66.0),
    "Europe": (35.0, 60.0, -11.0, 30.0),
    "Global": (-85.0, 85.0, -180.0, 180.0),
}
TILE_DEG = 5.0
EPOCH_JD = 2461041.5  # 2026-01-01T00:00Z


def latlon_grid(spark: SparkSession, lat_min: float, lat_max: float, lon_min: float, lon_max: float, step: float) -> DataFrame:
    """Regular grid with inclusive upper bounds, latitude-major."""
    n_lat, n_lon = (int((b - a) / step + 1e-9) + 1 for a, b in ((lat_min, lat_max), (lon_min, lon_max)))
    row = F.floor(F.col("id") / n_lon)
    return spark.range(n_lat * n_lon).select(
        F.col("id").alias("cell_idx"),
        (F.lit(lat_min) + row * step).alias("lat_deg"),
        (F.lit(lon_min) + F.col("id") % n_lon * step).alias("lon_deg"),
    )


def box_of(area: str | tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """Least and greatest latitude and longitude of a named area or raw box."""
    if isinstance(area, str):
        if area not in AREAS:
            raise KeyError(f"no area {area}; known are {', '.join(sorted(AREAS))}")
        return AREAS[area]
    if len(area) != 4:
        raise ValueError("a box has four numbers")
    return tuple(float(x) for x in area)


def clip(cells: DataFrame, area: str | tuple[float, float, float, float]) -> DataFrame:
    """Cells whose centre lies in the box, edges included."""
    south, north, west, east = box_of(area)
    inside = F.col("lon_deg").between(west, east) if west <= east else (F.col("lon_deg") >= west) | (F.col("lon_deg") <= east)
    return cells.where(F.col("lat_deg").between(south, north) & inside)


def cell_columns(row: Column, place: Column, size_deg: float) -> dict[str, Column]:
    """Id and centre of a cell of the global grid of square cells; the id sorts
    by band, then place."""
    return {
        "cell_id": F.format_string("c%05d-%05d", row.cast("int"), place.cast("int")),
        "lat_deg": F.lit(-90.0) + (row + 0.5) * size_deg,
        "lon_deg": F.lit(-180.0) + (place + 0.5) * size_deg,
    }


def box_cells(spark: SparkSession, area: str | tuple[float, float, float, float], size_deg: float) -> DataFrame:
    """Cells of the global grid that meet a box, as ``cell_id, lat_deg, lon_deg``.

    A box across the date line (west above east) is two segments, whose cells
    are united without repeats.
    """
    south, north, west, east = box_of(area)
    around = round(360 / size_deg)
    low, high = int((south + 90) // size_deg), min(int((north + 90) // size_deg), round(180 / size_deg) - 1)
    spans = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
    out = None
    for a, b in spans:
        first, last = int((a + 180) // size_deg), min(int((b + 180) // size_deg), around - 1)
        wide = last - first + 1
        part = spark.range((high - low + 1) * wide).select(
            (F.floor(F.col("id") / wide) + low).alias("_row"), (F.col("id") % wide + first).alias("_place")
        )
        out = part if out is None else out.unionByName(part)
    cells = out.distinct() if len(spans) > 1 else out
    return cells.withColumns(cell_columns(F.col("_row"), F.col("_place"), size_deg)).drop("_row", "_place")


def cell_radius_deg(size_deg: float) -> float:
    """Angle from a cell's centre to its farthest corner (at the equator)."""
    return size_deg / 2 * 2**0.5


def numbered(cells: DataFrame) -> DataFrame:
    """Cells with ``cell_idx``, their place in the order of ids."""
    return numbered_rows(cells, "cell_idx", "cell_id")


def shards(cells: DataFrame, shard_deg: float, size_deg: float) -> DataFrame:
    """Cells with ``shard_id``, the coarser square cell that holds them."""
    if shard_deg < size_deg:
        raise ValueError("a shard may not be finer than a cell")
    row, place = F.floor((F.col("lat_deg") + 90) / shard_deg), F.floor((F.col("lon_deg") + 180) / shard_deg)
    return cells.withColumn("shard_id", cell_columns(row, place, shard_deg)["cell_id"])


POLYGONS = "name STRING, polys ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """``name`` and ``polys``: polygons of rings (the first one outside, then
    holes) of (longitude, latitude) points, one JSON object per line."""
    return spark.read.schema(POLYGONS).json(path)


def polygons_of(polygons: DataFrame, name: str) -> DataFrame:
    found = polygons.where(F.col("name") == name)
    if found.isEmpty():
        raise KeyError(f"no polygons of {name}")
    return found


def rings(polygons: DataFrame) -> DataFrame:
    """One row per ring: name, polygon and ring number, points."""
    polys = polygons.select("name", F.posexplode("polys").alias("poly", "rings"))
    return polys.select("name", "poly", F.posexplode("rings").alias("ring", "points"))


def edges(polygons: DataFrame) -> DataFrame:
    """One row per edge of every ring (closed implicitly)."""
    points = F.col("points")
    pairs = F.arrays_zip(points.alias("a"), F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1)).alias("b"))
    rows = rings(polygons).select("name", "poly", "ring", F.posexplode(pairs).alias("edge", "p"))
    corner = lambda c, i: F.get(F.col(f"p.{c}"), F.lit(i))
    return rows.select(
        "name", "poly", "ring", "edge", corner("a", 0).alias("x1"), corner("a", 1).alias("y1"), corner("b", 0).alias("x2"), corner("b", 1).alias("y2")
    )


def cells_in_polygons(cells: DataFrame, polygons: DataFrame) -> DataFrame:
    """(cell_idx, name) of the cells inside, by the even-odd rule over all rings of
    a polygon, so holes are left out.

    Cells and edges meet on bands of one degree of latitude; a cell's crossings
    are counted in each task first.
    """
    low, high = F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2"))
    sides = edges(polygons).where("y1 <> y2").withColumn("_band", F.explode(F.sequence(low, high)))
    held = cells.select("cell_idx", "lat_deg", "lon_deg", F.floor("lat_deg").alias("_band"))
    at = (F.col("x2") - F.col("x1")) * (F.col("lat_deg") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    spans = (F.col("y1") > F.col("lat_deg")) != (F.col("y2") > F.col("lat_deg"))
    return (
        held.join(sides, "_band").where(spans & (F.col("lon_deg") < at))
        .groupBy("cell_idx", "name", "poly").agg((F.count("*") % 2 == 1).alias("odd")).where("odd")
        .select("cell_idx", "name").distinct()
    )


def area_cells(spark: SparkSession, area, size_deg: float, polygons: DataFrame | None = None) -> DataFrame:
    """Numbered cells of a country (its polygons, clipped to its box if it has a
    name of ``AREAS``), of a named box or of a raw box."""
    if polygons is None:
        return numbered(box_cells(spark, area, size_deg))
    mine = polygons_of(polygons, area)
    cells = numbered(box_cells(spark, AREAS.get(area, (-90.0, 90.0, -180.0, 180.0)), size_deg))
    inside = cells.join(cells_in_polygons(cells, mine), "cell_idx", "left_semi").drop("cell_idx")
    return numbered(clip(inside, area) if area in AREAS else inside)


def in_polygon(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd rule for ``ring`` ARRAY<STRUCT<lon, lat>> (closed implicitly)."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]
        return F.when(spans & (lon < at), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + crosses(i)) % 2 == 1


def time_steps(spark: SparkSession, n_steps: int, step_s: float, epoch_jd: float = EPOCH_JD, gmst_offset_rad: float = 0.0) -> DataFrame:
    """Steps from the epoch; the offset corrects sidereal time (UT1 - UTC)."""
    t = F.col("id") * float(step_s)
    return spark.range(n_steps).select(
        F.col("id").alias("t_idx"), t.alias("t_s"), (gmst(F.lit(epoch_jd) + t / 86400.0) + gmst_offset_rad).alias("gmst_rad")
    )


def steps_of(duration_s: float | Column, step_s: float | Column) -> int | Column:
    """Steps of a half-open grid, of numbers or of columns."""
    n = duration_s / step_s - 1e-9
    return F.ceil(n) if isinstance(n, Column) else math.ceil(n)


def julian_day(unix_s: float) -> float:
    return 2440587.5 + unix_s / 86400.0


def tile(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Band and place of the tile that holds a point."""
    bands, around = int(180 / TILE_DEG), int(360 / TILE_DEG)
    band = F.least(F.floor((lat + 90) / TILE_DEG), F.lit(bands - 1))
    return band.cast("int"), F.pmod(F.floor((lon + 180) / TILE_DEG), F.lit(around)).cast("int")


def tiles_near(lat: Column, lon: Column, radius_deg: Column) -> Column:
    """ARRAY<STRUCT<band, place>> of all tiles that a cap's box touches."""
    bands, around = int(180 / TILE_DEG), int(360 / TILE_DEG)
    low = F.greatest(F.floor((lat - radius_deg + 90) / TILE_DEG), F.lit(0)).cast("int")
    high = F.least(F.floor((lat + radius_deg + 90) / TILE_DEG), F.lit(bands - 1)).cast("int")
    ratio = F.sin(F.radians(radius_deg)) / F.cos(F.radians(lat))
    half = F.when((F.abs(lat) + radius_deg >= 90) | (ratio >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(ratio)))
    first = F.floor((lon - half + 180) / TILE_DEG).cast("int")
    last = F.floor((lon + half + 180) / TILE_DEG).cast("int")
    places = F.when(half >= 180 - TILE_DEG, F.sequence(F.lit(0), F.lit(around - 1))).otherwise(
        F.transform(F.sequence(first, last), lambda v: F.pmod(v, F.lit(around)))
    )
    return F.flatten(
        F.transform(
            F.sequence(low, high),
            lambda b: F.transform(places, lambda v: F.struct(b.alias("band"), v.alias("place"))),
        )
    )
