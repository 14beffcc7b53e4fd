"""Streams of a table's rows by parts, and the names of the queries."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from satspan import feature_queries, more_queries, queries
from satspan.operators import bitemporal
from satspan.operators.continuity import timeline
from satspan.streaming import stateful
from satspan.sources.shared import new_folder


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_parts_arrive_in_order_whatever_tasks_end_first(spark):
    # Parts of 8,000 s each: a later one first would make the earlier ones late.
    table = spark.range(0, 400, 1, 4).select(
        (F.col("id") % 7).cast("string").alias("entity"), (F.col("id") % 20).alias("valid_us"), (F.col("id") * 100_000_000 + 1_000_000).alias("commit_us"), (F.col("id") * 1.0).alias("value")
    )
    table = table.withColumn("commit_ts", F.timestamp_micros("commit_us"))
    at, out = 30_000_000_000, new_folder(spark, "state")
    stateful.run_in_parts(table, "commit_ts", 5, "10 minutes", "versions", lambda s: bitemporal.stream_as_of(s, at), out)
    columns = ("entity", "valid_us", "commit_us", "value")
    assert rows_of(spark.read.parquet(out), *columns) == rows_of(bitemporal.as_of(table, at), *columns)


def test_segments_of_many_parts(spark):
    links = spark.range(600).select((F.col("id") % 11).alias("unit"), F.timestamp_seconds(1_000_000 + F.col("id") * 97 % 50_000).alias("ts"))
    out = new_folder(spark, "segments")
    stateful.run_in_parts(links, "ts", 3, "10 minutes", "links", lambda s: stateful.contact_segments(s, "unit", "ts"), out)
    want = timeline(links.select("unit", F.unix_timestamp("ts").alias("t")).distinct(), "unit", "t")
    assert rows_of(stateful.timeline_of(spark.read.parquet(out), "unit"), "unit", "t", "end_s") == rows_of(want, "unit", "t", "end_s")


def test_no_query_takes_another_ones_name():
    names = [*queries.QUERIES, *more_queries.QUERIES, *feature_queries.QUERIES]
    assert len(names) == len(set(names))
    assert "raan_rad" in entry.oracle_sql()["pulled_elements"] and "cos_m" in entry.oracle_sql()["pulled_elements"]
    assert entry.queries()["pulled_elements"] is more_queries.pulled_elements
