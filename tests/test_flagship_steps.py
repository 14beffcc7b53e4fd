"""The flagship query covers an hour of steps, not the ten of the shorter queries."""

from pyspark.sql import functions as F

from satspan import queries


def test_coverage_by_cell_goes_through_an_hour(spark, tmp_path):
    spark.range(40).select((F.col("id") * 90).alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(20).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    rows = queries.coverage_by_cell(spark, str(tmp_path)).collect()
    assert len(rows) == 40
    assert max(r.steps_k1 for r in rows) > 10  # more than ten steps were looked at
    assert all(r.availability_k1 == round(r.steps_k1 / 60, 9) and r.steps_k2 <= r.steps_k1 <= min(r.sat_sum, 60) for r in rows)
    assert "range(60)" in queries.SQL["coverage_by_cell"] and "steps_k1 / 60.0" in queries.SQL["coverage_by_cell"]
