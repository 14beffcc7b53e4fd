"""Horizon masks from elevation points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satspan.operators.network import forward_value

EARTH_M = 6_371_000.0
TILE = 1.0


def ridge(grid: DataFrame, ridge_lat: float, height_m: float, width_deg: float) -> DataFrame:
    """A Gaussian east-west ridge as height points on a grid."""
    d = (F.col("lat_deg") - ridge_lat) / width_deg
    return grid.withColumn("height_m", height_m * F.exp(-d * d))


def reference_heights(cells: DataFrame, points: DataFrame) -> DataFrame:
    """``cell_idx, base_m``: the height of the grid point at the least latitude and
    the least longitude of the grid that are not below the cell's; beyond the
    grid, at its last ones."""
    out = cells.select("cell_idx", "lat_deg", "lon_deg")
    for c in ("lat_deg", "lon_deg"):
        axis = points.select(F.col(c).alias("_axis")).distinct()
        last = axis.agg(F.max("_axis").alias("_last"))  # one row
        out = forward_value(out, axis, c, "_axis", TILE, f"_{c}").crossJoin(F.broadcast(last))
        out = out.withColumn(f"_{c}", F.coalesce(f"_{c}", "_last")).drop("_last")
    at = points.select(F.col("lat_deg").alias("_lat_deg"), F.col("lon_deg").alias("_lon_deg"), F.col("height_m").alias("base_m"))
    return out.join(at, ["_lat_deg", "_lon_deg"], "left").select("cell_idx", F.coalesce("base_m", F.lit(0.0)).alias("base_m"))


def horizon(cells: DataFrame, points: DataFrame, radius_km: float, n_bins: int) -> DataFrame:
    """Highest positive angle per cell and azimuth bin, with Earth curvature; heights
    count from the cell's own reference height.

    Cells meet points by 1-degree tiles within the radius, then by distance.
    """
    cells = cells.join(reference_heights(cells, points), "cell_idx")
    reach = int(radius_km / 111.0) + 1
    near = cells.withColumn(
        "_w", F.ceil(F.lit(float(reach)) / F.greatest(F.cos(F.radians("lat_deg")), F.lit(0.02))).cast("int")
    ).withColumn(
        "_tile",
        F.explode(F.flatten(F.transform(
            F.sequence(F.lit(-reach), F.lit(reach)),
            lambda a: F.transform(
                F.sequence(-F.col("_w"), F.col("_w")),
                lambda b: F.struct((F.floor("lat_deg") + a).alias("a"), F.pmod(F.floor("lon_deg") + b, F.lit(360)).alias("b")),
            ),
        ))),
    ).select("*", F.col("_tile.a").alias("_a"), F.col("_tile.b").alias("_b")).drop("_tile", "_w")
    held = points.select(
        F.col("lat_deg").alias("p_lat"), F.col("lon_deg").alias("p_lon"), "height_m",
        F.floor("lat_deg").alias("_a"), F.pmod(F.floor("lon_deg"), F.lit(360)).alias("_b"),
    )
    la, lb = F.radians("lat_deg"), F.radians("p_lat")
    dlon = F.radians(F.col("p_lon") - F.col("lon_deg"))
    h = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin(dlon / 2), 2)
    distance = 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
    bearing = F.pmod(F.degrees(F.atan2(F.sin(dlon) * F.cos(lb), F.cos(la) * F.sin(lb) - F.sin(la) * F.cos(lb) * F.cos(dlon))), F.lit(360.0))
    rise = F.col("height_m") - F.col("base_m") - F.col("_d") * F.col("_d") / (2 * EARTH_M)
    return (
        near.join(held, ["_a", "_b"])
        .withColumns({"_d": distance, "_az": bearing})
        .where((F.col("_d") > 1.0) & (F.col("_d") <= radius_km * 1000))
        .withColumn("angle_deg", F.degrees(F.atan2(rise, F.col("_d"))))
        .where("angle_deg > 0")
        .groupBy("cell_idx", F.least(F.floor(F.col("_az") * n_bins / 360), F.lit(n_bins - 1)).alias("az_bin"))
        .agg(F.max("angle_deg").alias("mask_deg"))
    )


def masks_of(cells: DataFrame, terrain, n_bins: int) -> DataFrame:
    """``cell_idx, az_bin, mask_deg`` of a terrain given as a function of two columns
    (latitude, longitude) that makes an array of ``n_bins`` masks."""
    rows = cells.select("cell_idx", F.posexplode(terrain(F.col("lat_deg"), F.col("lon_deg"))).alias("_bin", "mask_deg"))
    return rows.where((F.col("_bin") < n_bins) & (F.col("mask_deg") > 0)).select("cell_idx", F.col("_bin").cast("long").alias("az_bin"), "mask_deg")
