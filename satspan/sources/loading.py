"""Loads that may stop anywhere and be run again.

A target is a folder of Parquet partitions by key bucket.  A load looks at what is
there, bucket by bucket: complete ones are left alone, partial, wrong and
repeated ones are written anew (dynamic partition overwrite, so a bucket is
replaced as a whole when its task's files are moved in), and buckets that nothing
is required of go.  However often and wherever a load stops, the next one gives
the table once, and writes only what is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKETS = 32
#: Files of a bucket at most.
FILES = 4


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _there(spark: SparkSession, path: str, schema) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.exists(folder) and any(s.getPath().getName().startswith("bucket=") for s in fs.listStatus(folder))
    return spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(path) if held else None


def _prints(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Per bucket the rows and two sums over their contents, whatever their order."""
    h = F.xxhash64(*columns)
    return rows.groupBy("bucket").agg(
        F.count("*").alias(f"n_{name}"), F.bit_xor(h).alias(f"x_{name}"), F.sum(F.pmod(h, F.lit(1 << 40))).alias(f"s_{name}")
    )


def load_report(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Per bucket ``n_required``, ``n_there`` and ``state``: complete, partial (some
    rows, or others), empty, or stale (rows that nothing requires)."""
    spark, columns = rows.sparkSession, rows.columns
    want = _prints(rows.withColumn("bucket", bucket_of(key, buckets)), columns, "required")
    have = _there(spark, path, rows.schema)
    if have is None:
        return want.select("bucket", "n_required", F.lit(0).cast("long").alias("n_there"), F.lit("empty").alias("state"))
    both = want.join(_prints(have, columns, "there"), "bucket", "full")
    same = (F.col("n_required") == F.col("n_there")) & (F.col("x_required") == F.col("x_there")) & (F.col("s_required") == F.col("s_there"))
    state = F.when(same, "complete").when(F.col("n_there").isNull(), "empty").when(F.col("n_required").isNull(), "stale").otherwise("partial")
    return both.select("bucket", F.coalesce("n_required", F.lit(0)).alias("n_required"), F.coalesce("n_there", F.lit(0)).alias("n_there"), state.alias("state"))


def load(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> dict[str, int]:
    """Bring the target to hold ``rows`` once; returns the buckets by what they
    were before.  The number of buckets is the target's and does not change."""
    spark = rows.sparkSession
    found = {r["bucket"]: r["state"] for r in load_report(rows, path, key, buckets).collect()}  # a row for each bucket
    for b in (b for b, state in found.items() if state == "stale"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    todo = sorted(b for b, state in found.items() if state in ("empty", "partial"))
    if todo:
        need = rows.withColumn("bucket", bucket_of(key, buckets)).where(F.col("bucket").isin(todo))
        # A bucket is in few files, and one key of many rows is not in one task.
        need.repartition("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(FILES))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return {state: sum(s == state for s in found.values()) for state in ("complete", "partial", "empty", "stale")}


def loaded(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a target."""
    have = _there(spark, path, schema)
    return spark.createDataFrame([], schema) if have is None else have.drop("bucket")
