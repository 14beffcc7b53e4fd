"""Rows by place and satellite given to the cells there: whole, spread, in small files."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from satspan import feature_queries, queries
from satspan.operators import access


def test_cells_get_the_rows_of_their_place(spark, monkeypatch):
    monkeypatch.setattr(access, "PART", 7)
    spots = spark.range(60).select(F.col("id").alias("cell_idx"), F.when(F.col("id") < 50, 10.0).otherwise(F.col("id") % 5 * 1.0).alias("lat_deg"), F.lit(0.0).alias("lon_deg"))
    cells = spots.unionByName(spots.where("cell_idx % 9 = 0"))  # some are listed twice
    rows = access.places_of(cells).where("lat_deg <> 2").crossJoin(spark.range(4).withColumnRenamed("id", "sat_idx")).select("cell_idx", "n_cells", "sat_idx")
    got, want = access.pairs_at_cells(rows, cells), access.at_cells(rows.drop("n_cells"), cells)
    assert got.columns == want.columns == ["cell_idx", "sat_idx"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == (50 + 8) * 4
    # one place with many cells is no task of its own, and rows are dealt once
    assert got.where("cell_idx < 50").select(F.spark_partition_id()).distinct().count() > 1
    plan = access.pairs_at_cells(rows, cells)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning(_dealt") == 2, plan
    # two places of one hash
    monkeypatch.setattr(access.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    assert sorted(map(tuple, access.pairs_at_cells(rows, cells).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name, most", [("contact_times", 1.0), ("access_intervals", 0.4)])
def test_files_of_all_pairs_stay_small(spark, tmp_path, monkeypatch, name, most):
    """Pairs grow with cells times satellites: a row may take some bits, not bytes."""
    k = (F.col("id") % 4 + F.floor(F.col("id") / 4) * 3600).cast("long")  # 50 cells at each of four places
    spark.range(200).select(k.alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(20).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))

    def many(keys):
        """4,000 contacts at each place, in place of those of 20 satellites."""
        rows = access.places_of(queries.cells(spark, str(tmp_path))).crossJoin(spark.range(4_000))
        rows = rows.withColumns({"sat_idx": F.pmod(F.xxhash64("id", "lat_deg"), F.lit(360_000)), "start_idx": F.col("id") % 8, "end_idx": F.col("id") % 8 + 2})
        return rows.select(*keys, "start_idx", "end_idx")

    both = {"start_s": F.rand(1) * 540, "end_s": F.rand(2) * 540}
    monkeypatch.setattr(feature_queries, "_contacts", lambda *_: many(["cell_idx", "n_cells", "sat_idx"]).withColumns(both))
    monkeypatch.setattr(queries.continuity, "intervals", lambda _, keys: many(keys))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables of size
    try:
        (queries.QUERIES | feature_queries.QUERIES)[name](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200 * 4_000
    size = sum(os.path.getsize(f) for f in glob.glob(str(tmp_path / "out/*.parquet"))) / 800_000
    assert size < most, size
