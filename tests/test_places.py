"""Cells of one place, pairs that are not shuffled, folds that stay small, crossings by batches."""

import random
import time

from pyspark.sql import functions as F

from satspan.operators import continuity
from satspan.operators.access import at_cells, in_view, places_of, satellite_states
from satspan.plans import coverage_plan
from satspan.sources.constellation import walker
from satspan.sources.grid import time_steps


def cells_of(spark, n, places):
    return spark.range(n).select(
        F.col("id").alias("cell_idx"), (-60 + (F.col("id") % places) * 7.0 % 120).alias("lat_deg"), (-180 + (F.col("id") % places) * 13.0 % 360).alias("lon_deg")
    )


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_one_place_are_worked_out_once(spark):
    cells, sats = cells_of(spark, 90, 30), walker(spark, 60, 6, 1, 650.0, 53.0)
    states = satellite_states(sats, time_steps(spark, 6, 60.0))
    by_cell = in_view(cells, states, 10.0, tiled=False)
    by_place = in_view(places_of(cells), states, 10.0, dealt=True)
    assert by_place.count() * 3 == by_cell.count()
    keys = ["cell_idx", "sat_idx"]
    want = continuity.intervals(by_cell, keys)
    assert rows_of(at_cells(continuity.intervals(by_place, keys), cells), *want.columns) == rows_of(want, *want.columns)
    rows = coverage_plan.run_coverage(cells, sats, 6, 60.0, 10.0)
    assert rows.columns[:3] == cells.columns and "n_cells" not in rows.columns
    counts = {r.cell_idx: r.n for r in by_cell.groupBy("cell_idx").agg(F.count("*").alias("n")).collect()}
    assert rows_of(rows, "cell_idx", "sat_sum") == [(i, counts.get(i, 0)) for i in range(90)]


def test_intervals_do_not_shuffle_the_pairs(spark):
    states = satellite_states(walker(spark, 60, 6, 1, 650.0, 53.0), time_steps(spark, 6, 60.0))
    pairs = in_view(places_of(cells_of(spark, 90, 30)), states, 10.0, dealt=True)
    keys = ["cell_idx", "sat_idx"]
    assert plan_of(continuity.intervals(pairs, keys)).count("Exchange hashpartitioning") == plan_of(pairs).count("Exchange hashpartitioning")


def test_sweep_weighs_places_by_their_cells(spark):
    cells = cells_of(spark, 40, 30)  # ten places twice
    sats = coverage_plan.candidates(spark, [40, 80], 10, 650.0, 53.0)
    got = {r.n_sats: r for r in coverage_plan.sweep(cells, sats, 5, 60.0, 0.5, 10.0).collect()}
    for n in (40, 80):
        rows = coverage_plan.run_coverage(cells, sats.where(F.col("n_sats") == n), 5, 60.0, 10.0, tiled=False).collect()
        assert abs(got[n].mean_sats_in_view - sum(r.sats_in_view_mean for r in rows) / 40) < 1e-12
        assert abs(got[n].pct_k1 - sum(r.availability_k1 >= 0.5 for r in rows) / 40) < 1e-12


def widest(spans, n_time, least, different_plane):
    """The widest chain of one cell, every earlier interval kept: width and handovers."""
    done = []
    for s, e, sat, p in sorted(spans, key=lambda x: (x[1], x[0], x[2], x[3])):
        width, hops = (n_time, 0) if s <= 0 else (-1, 0)
        for ue, usat, up, uw, uh in done:
            overlap = ue - s + 1
            if ue < e and overlap >= least and uw > 0 and usat != sat and (not different_plane or up != p) and min(uw, overlap) > width:
                width, hops = min(uw, overlap), uh + 1
        done.append((e, sat, p, width, hops))
    best = (-1, -1)
    for e, _, _, width, hops in done:
        if e >= n_time - 1 and width > max(best[0], 0):
            best = (width, hops)
    return best


def test_folds_that_let_go_find_the_same_chains(spark):
    r, n_time = random.Random(5), 9
    cells = {c: [] for c in range(60)}
    for c, spans in cells.items():
        for sat in range(r.choice([3, 8, 40])):
            s = r.choice([0, 0, r.randrange(n_time)])
            spans.append((s, min(n_time - 1, s + r.randrange(5)), sat, sat % r.choice([2, 3, 5])))
    table = spark.createDataFrame([(c, *x) for c, xs in cells.items() for x in xs], "cell_idx long, start_idx long, end_idx long, sat_idx long, plane_uid long")
    for least, plane in ((1, False), (2, False), (1, True), (2, True)):
        got = {x.cell_idx: x for x in continuity.handover(table, n_time, least, plane).collect()}
        for c, xs in cells.items():
            width, hops = widest(xs, n_time, least, plane)
            assert (got[c].feasible, got[c].n_handovers) == (width > 0, hops), (c, least, plane)
            assert got[c].worst_overlap == (width if hops > 0 else -1)


def test_a_fold_grows_with_the_satellites_in_view(spark):
    def took(n):
        table = spark.range(n).select(F.lit(1).alias("cell_idx"), (F.col("id") % 5).alias("start_idx"), (F.col("id") % 5 + 4).alias("end_idx"), F.col("id").alias("sat_idx"))
        start = time.time()
        assert continuity.handover(table, 9).first().feasible
        return time.time() - start

    took(500)
    assert took(6000) < 10 * took(1500)  # as many as are in view for each one: 16 times
