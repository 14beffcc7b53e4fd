"""Counts in view, availability and the tables behind the charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_in_view(access: DataFrame, *keys: str) -> DataFrame:
    """Satellites in view per key and step."""
    return access.groupBy(*keys, "t_idx").agg(F.count("*").alias("n_in_view"), F.max("elev_deg").alias("max_elev_deg"))


def coverage(cells: DataFrame, access: DataFrame, n_time: int, ks: tuple[int, ...] = (1, 2), keys: tuple[str, ...] = ("cell_idx",)) -> DataFrame:
    """Per cell the steps with k or more satellites, availability and mean.

    ``access`` by pair, or the counts ``n_in_view`` by key and step.  Counts stay
    whole numbers until one final division; cells without a satellite stay with
    zeros.
    """
    per_step = access if "n_in_view" in access.columns else counts_in_view(access, *keys)
    per_cell = per_step.groupBy(*keys).agg(
        F.sum("n_in_view").alias("sat_sum"), *[F.count_if(F.col("n_in_view") >= k).alias(f"steps_k{k}") for k in ks]
    )
    out = cells.join(per_cell, list(keys), "left").fillna(0, ["sat_sum", *[f"steps_k{k}" for k in ks]])
    return out.withColumns({
        **{f"availability_k{k}": F.col(f"steps_k{k}") / F.lit(float(n_time)) for k in ks},
        "sats_in_view_mean": F.col("sat_sum") / F.lit(float(n_time)),
    })


def over_cells(value: Column) -> Column:
    """The mean over all cells of rows by place."""
    return F.sum(value * F.col("n_cells")) / F.sum("n_cells")


def summary(rows: DataFrame, group: str, target: float, ks: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Per candidate the share of cells at the target and mean availability.

    ``rows`` by cell, or by place with ``n_cells``."""
    mean = over_cells if "n_cells" in rows.columns else F.avg
    aggs = [mean(F.col("sats_in_view_mean")).alias("mean_sats_in_view")]
    for k in ks:
        a = F.col(f"availability_k{k}")
        aggs += [mean(F.when(a >= target, 1.0).otherwise(0.0)).alias(f"pct_k{k}"), mean(a).alias(f"mean_avail_k{k}")]
    return rows.groupBy(group).agg(*aggs)


def k_values(ks: list[int] | None = None, default_k: int | None = None) -> tuple[int, ...]:
    """The k values of a run: those given, sorted and without repeats; else the
    default one; else 1 and 2."""
    if ks is not None:
        return tuple(sorted(set(ks)))
    return (1, 2) if default_k is None else (default_k,)


def availability_summary(rows: DataFrame, k: int = 1) -> DataFrame:
    """One row: mean, least and largest availability, satellites in view and the
    share of cells with a handover chain, if known."""
    a = F.col(f"availability_k{k}")
    feasible = F.avg(F.col("mbb_feasible").cast("double")) if "mbb_feasible" in rows.columns else F.lit(None).cast("double")
    return rows.agg(
        F.count("*").alias("n_cells"), F.avg(a).alias("mean_availability"), F.min(a).alias("min_availability"), F.max(a).alias("max_availability"),
        F.avg("sats_in_view_mean").alias("mean_sats_in_view"), F.max("sats_in_view_mean").alias("max_sats_in_view"), feasible.alias("feasible_share"),
    )


def latitude_bin(lat: Column, width: float = 2.0) -> Column:
    """Lower edge of the right-open latitude bin."""
    return F.floor(lat / width) * width


def unit_bin(x: Column, bins: int = 20) -> Column:
    """Bin of a share in [0, 1]; the last bin is closed."""
    return F.least(F.floor(x * bins), F.lit(bins - 1)).cast("long")
