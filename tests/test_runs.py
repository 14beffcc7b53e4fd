"""Runs in view by their ends, and few cells that go to the states."""

import random

from pyspark.sql import functions as F

from satspan.operators import access, continuity
from satspan.plans import coverage_plan
from satspan.sources.constellation import walker
from satspan.sources.grid import time_steps


def cells_of(spark, n):
    return spark.range(n).select(F.col("id").alias("cell_idx"), (-60 + F.col("id") * 7.0 % 120).alias("lat_deg"), (-180 + F.col("id") * 13.0 % 360).alias("lon_deg"))


def pairs_of(spark, n_time, seed):
    """Random pairs; a number of a satellite may stand in two planes."""
    draw = random.Random(seed)
    rows = []
    for cell in range(12):
        for sat in range(draw.randint(0, 9)):
            for plane in draw.sample(range(-1, 3), 1 + (sat == 3)):
                t = 0
                while t < n_time:
                    first = t + draw.randint(0, n_time // 2)
                    end = min(n_time - 1, first + draw.randint(0, n_time // 2))
                    rows += [(cell, sat, plane, i, 20.0) for i in range(first, end + 1)]
                    t = end + 2
    return spark.createDataFrame(rows, "cell_idx long, sat_idx long, plane_uid long, t_idx long, elev_deg double")


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_runs_in_view_are_the_intervals_counted(spark):
    for n_time, seed in ((6, 1), (62, 2), (63, 3), (130, 4)):
        pairs = pairs_of(spark, n_time, seed)
        runs = continuity.runs_in_view(pairs, ["cell_idx"], n_time)
        spans = continuity.intervals(pairs, ["cell_idx", "sat_idx", "plane_uid"])
        want = spans.groupBy("cell_idx", "start_idx", "end_idx").agg(F.count("*").alias("n_runs"))
        assert rows_of(runs, *want.columns) == rows_of(want, *want.columns)
        counts = pairs.groupBy("cell_idx", "t_idx").agg(F.count("*").alias("n_in_view"))
        assert rows_of(continuity.counts_of(runs, "cell_idx"), *counts.columns) == rows_of(counts, *counts.columns)
        for least in (1, 2):
            for plane in (False, True):
                # Satellites of two planes are two satellites.
                apart = spans.withColumn("sat_idx", F.col("sat_idx") * 10 + F.col("plane_uid"))
                want = continuity.handover(apart, n_time, least, plane)
                got = continuity.chains_of(continuity.runs_in_view(pairs, ["cell_idx"], n_time, plane), n_time, least, plane)
                assert rows_of(got, *want.columns) == rows_of(want, *want.columns)


def test_a_satellite_that_is_listed_twice_counts_twice(spark):
    pairs = pairs_of(spark, 6, 5)
    twice = continuity.runs_in_view(pairs.unionByName(pairs), ["cell_idx"], 6)
    once = {r[:3]: r[3] for r in rows_of(continuity.runs_in_view(pairs, ["cell_idx"], 6), *twice.columns)}
    assert {r[:3]: r[3] for r in rows_of(twice, *twice.columns)} == {k: 2 * n for k, n in once.items()}


def test_few_cells_go_to_the_states(spark, monkeypatch):
    cells, states = cells_of(spark, 30), access.satellite_states(walker(spark, 60, 6, 1, 650.0, 53.0), time_steps(spark, 6, 60.0))
    keys = ["cell_idx", "sat_idx", "t_idx"]
    few = access.in_view(cells, states, 10.0)
    exchanges = [x for x in few._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert not any("band" in x for x in exchanges)
    monkeypatch.setattr(access, "FEW_CELLS", 29)
    many = access.in_view(cells, states, 10.0, dealt=True)
    assert rows_of(few, *keys) == rows_of(many, *keys)
    a, b = (continuity.runs_in_view(x, ["cell_idx"], 6) for x in (few, many))
    assert rows_of(a, *a.columns) == rows_of(b, *a.columns)


def test_what_handover_folds_does_not_grow_with_the_satellites(spark):
    for n in (60, 1200):
        states = access.satellite_states(walker(spark, n, 6, 1, 650.0, 53.0), time_steps(spark, 6, 60.0))
        runs = continuity.runs_in_view(access.in_view(cells_of(spark, 30), states, 10.0, dealt=True), ["cell_idx"], 6)
        assert runs.groupBy("cell_idx").count().agg(F.max("count")).first()[0] <= 6 * 7 // 2


def test_coverage_with_an_overlap_in_steps(spark):
    cells, sats = cells_of(spark, 30), walker(spark, 240, 6, 1, 650.0, 53.0)
    with_chains = coverage_plan.run_coverage(cells, sats, 6, 60.0, 10.0, least_overlap=2)
    plain = coverage_plan.run_coverage(cells, sats, 6, 60.0, 10.0)
    assert rows_of(with_chains, *plain.columns) == rows_of(plain, *plain.columns)
    spans = continuity.intervals(access.in_view(cells, access.satellite_states(sats, time_steps(spark, 6, 60.0)), 10.0), ["cell_idx", "sat_idx"])
    want = continuity.handover(spans, 6, 2, cells=cells)
    assert rows_of(with_chains, "cell_idx", "mbb_feasible", "mbb_n_handovers") == rows_of(want, "cell_idx", "feasible", "n_handovers")
