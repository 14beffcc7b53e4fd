import json
import math
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from satspan.functions import orbit
from satspan.operators import access, continuity, coverage, network, terrain
from satspan.plans import coverage_plan, model_plan
from satspan.sources import constellation, entities, files, grid
from satspan.streaming import rates

SPANS = "cell_idx long, sat_idx long, start_idx long, end_idx long, plane_uid long"


def widest(spans, n, least, planes):
    """Feasible, smallest overlap and worst gap of a cell, by trying all chains."""
    best = 0
    todo = [(s, n) for s in spans if s[1] <= 0]
    seen = set()
    while todo:
        (sat, _, end, plane), width = todo.pop()
        if (sat, end, width) in seen:
            continue
        seen.add((sat, end, width))
        if end >= n - 1:
            best = max(best, width)
        for other in spans:
            overlap = end - other[1] + 1
            if other[2] > end and overlap >= least and other[0] != sat and (not planes or (other[3] != plane and min(plane, other[3]) >= 0)):
                todo.append((other, min(width, overlap)))
    covered = {t for _, a, b, _ in spans for t in range(a, b + 1)}
    gap = run = 0
    for t in range(n):
        run = 0 if t in covered else run + 1
        gap = max(gap, run)
    return best > 0, best if 0 < best < n else -1, 0 if best else gap


@pytest.mark.parametrize("planes", [False, True])
def test_handover_matches_all_chains(spark, planes):
    r = random.Random(3)
    n, cells = 12, {}
    for c in range(60):
        spans = []
        for sat in range(r.randrange(0, 9)):
            a = r.randrange(0, n)
            spans.append((sat % 6, a, min(n - 1, a + r.randrange(0, 7)), r.choice((-1, 0, 1, 2))))
        cells[c] = list({(s[0], s[1], s[2]): s for s in spans}.values())
    rows = spark.createDataFrame([(c, *s) for c, spans in cells.items() for s in spans], SPANS)
    every = spark.createDataFrame([(c,) for c in cells], "cell_idx long")
    for least in (1, 2):
        got = {x.cell_idx: x for x in continuity.handover(rows, n, least, planes, cells=every).collect()}
        assert len(got) == 60
        for c, spans in cells.items():
            feasible, overlap, gap = widest(spans, n, least, planes)
            assert (got[c].feasible, got[c].worst_gap_steps) == (feasible, gap)
            assert got[c].worst_overlap == (overlap if got[c].n_handovers != 0 else -1)
            if not spans:
                assert (got[c].n_handovers, got[c].worst_gap_steps) == (-1, n)


def test_continuity_in_seconds_and_guards(spark):
    cells = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 2.0)], "cell_idx long, lat_deg double, lon_deg double")
    rows = [(0, s, t, 40.0) for s, (a, b) in enumerate(((0, 3), (2, 5))) for t in range(a, b + 1)]
    seen = spark.createDataFrame(rows, "cell_idx long, sat_idx long, t_idx long, elev_deg double")
    got = {r.cell_idx: r for r in continuity.continuity_map(cells, seen, 6, 10.0).collect()}
    assert (got[0].mbb_feasible, got[0].mbb_overlap_worst_s, got[0].mbb_n_handovers, got[0].mbb_worst_gap_s) == (True, 10.0, 1, 0.0)
    assert (got[1].mbb_feasible, got[1].mbb_overlap_worst_s, got[1].mbb_n_handovers, got[1].mbb_worst_gap_s) == (False, -1.0, -1, 60.0)
    assert [continuity.needed_steps(x, 10.0) for x in (0, 5, 10, 11)] == [1, 2, 2, 3]
    with pytest.raises(ValueError):
        continuity.check_sampling(10.0, 6.0)
    sats = constellation.walker(spark, 24, 6, 1, 650.0, 53.0)
    with pytest.raises(ValueError):
        coverage_plan.run_coverage(cells.limit(0), sats, 3, 60.0)
    with pytest.raises(ValueError):
        coverage_plan.shapes(spark, list(range(1, 20)), list(range(1, 20)), [53.0])
    assert coverage.k_values() == (1, 2) and coverage.k_values([3, 1, 3]) == (1, 3) and coverage.k_values(None, 4) == (4,)


def test_sweeps_agree_with_single_runs(spark):
    cells = grid.latlon_grid(spark, 10, 30, 70, 90, 10)
    options = dict(altitude_km=650.0, n_steps=6, step_s=60.0, target=0.9, grade=0.5)
    name, rows = coverage_plan.run_sweep(spark, cells, sizes=[200, 400], inclination_deg=(48.0, 60.0), overlap_s=0.0, **options)
    assert name == "min_n_vs_inclination"
    rows = {(r.n_sats, r.inclination_deg): r for r in rows.collect()}
    assert len(rows) == 4
    for (n, inc), r in rows.items():
        one = coverage_plan.run_coverage(cells, constellation.walker(spark, n, 40, 1, 650.0, inc), 6, 60.0, overlap_s=0.0)
        x = one.agg(F.avg("sats_in_view_mean").alias("siv"), F.avg(F.col("mbb_feasible").cast("double")).alias("mbb"), F.avg((F.col("availability_k1") >= 0.9).cast("double")).alias("k1")).first()
        assert (r.mean_sats_in_view, r.pct_mbb, r.pct_k1) == pytest.approx((x.siv, x.mbb, x.k1)) and r.pct_mbb <= r.pct_k1
    assert coverage_plan.run_sweep(spark, cells, planes=[4], per_plane=[2], **options)[0] == "multi_shape"
    assert coverage_plan.inclinations(50, 50.5, 0.1) == [50.0, 50.1, 50.2, 50.3, 50.4, 50.5] and coverage_plan.inclinations(48, 48, 5) == [48.0]


def test_horizon_counts_from_the_cell(spark):
    cells = spark.createDataFrame([(0, 28.5, 80.0), (1, 27.02, 79.03)], "cell_idx long, lat_deg double, lon_deg double")
    axis = lambda n, low, c: spark.range(n).select((low + F.col("id") * 0.1).alias(c))
    points = axis(31, 27.0, "lat_deg").crossJoin(axis(41, 78.0, "lon_deg"))
    low = terrain.horizon(cells, terrain.ridge(points, 29.0, 5000.0, 0.2), 200.0, 8).collect()
    high = terrain.horizon(cells, terrain.ridge(points, 29.0, 5000.0, 0.2).withColumn("height_m", F.col("height_m") + 3000), 200.0, 8).collect()
    key = lambda rows: sorted((r.cell_idx, r.az_bin, round(r.mask_deg, 9)) for r in rows)
    assert key(low) == key(high)  # a plateau walls nobody in
    mask = {r.az_bin: r.mask_deg for r in low if r.cell_idx == 0}
    assert max(mask.get(0, 0), mask.get(7, 0)) > 3 and max(mask.get(0, 0), mask.get(7, 0)) > max(mask.get(3, 0), mask.get(4, 0)) + 2
    flat = terrain.horizon(cells, points.withColumn("height_m", F.lit(4000.0)), 200.0, 8)
    assert flat.count() == 0
    made = terrain.masks_of(cells, lambda lat, lon: F.array_repeat(lat, 4), 4)
    assert made.count() == 8
    sats = constellation.walker(spark, 200, 10, 1, 650.0, 53.0)
    open_, walled = (coverage_plan.run_coverage(cells, sats, 6, 60.0, 10.0, terrain=t, n_bins=4).agg(F.sum("sat_sum")).first()[0] for t in (None, made))
    assert walled < open_


def test_as_of_join_is_linear_in_a_hot_day(spark):
    def run(n):
        left = spark.range(n).select((F.col("id") * 7 % n).alias("x"))
        refs = spark.range(n).where("id % 3 = 0").select(F.col("id").alias("r"))
        start = time.time()
        found = network.forward_value(left, refs, "x", "r", 1e12)
        wrong = found.where(~F.col("reference").eqNullSafe(F.when(F.ceil(F.col("x") / 3) * 3 < n, F.ceil(F.col("x") / 3) * 3))).count()
        assert wrong == 0
        return time.time() - start

    run(1000)
    assert run(400_000) < 8 * max(run(100_000), 0.5)
    left = spark.createDataFrame([(5.0,), (17.5,), (99.0,), (-3.0,)], "x double")
    got = {r.x: r.reference for r in network.forward_value(left, spark.createDataFrame([(5.0,), (40.0,), (17.0,)], "r double"), "x", "r", 10.0).collect()}
    assert got == {5.0: 5.0, 17.5: 40.0, 99.0: None, -3.0: 5.0}


def test_polygons_and_areas(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"name": "A", "polys": [[[[0, 0], [10, 0], [10, 10], [0, 10]], [[4, 4], [6, 4], [6, 6], [4, 6]]], [[[20, 0], [22, 0], [22, 2]]]]}))
    polygons = grid.read_polygons(spark, str(tmp_path / "p.json"))
    with pytest.raises(KeyError):
        grid.polygons_of(polygons, "B")
    with pytest.raises(KeyError):
        grid.box_of("nowhere")
    assert grid.rings(polygons).count() == 3 and grid.edges(polygons).count() == 11
    cells = grid.area_cells(spark, "A", 1.0, polygons)
    got = {(r.lat_deg, r.lon_deg) for r in cells.collect()}
    want = {(y + 0.5, x + 0.5) for x in range(10) for y in range(10) if not (4 <= x < 6 and 4 <= y < 6)}
    assert want <= got and all(20 < x < 22 and y <= x - 20 for y, x in got - want)
    assert [r.cell_idx for r in cells.orderBy("cell_id").collect()] == list(range(len(got)))
    line = grid.box_cells(spark, (0.0, 4.0, 178.0, -178.0), 1.0)
    assert line.count() == line.distinct().count() == 5 * 5
    with pytest.raises(ValueError):
        grid.shards(cells, 0.5, 1.0)
    assert grid.steps_of(30, 10) == 3 and grid.julian_day(1767225600) == grid.EPOCH_JD


def test_sinks_and_readers(spark, tmp_path):
    sats = constellation.walker(spark, 12, 3, 1, 650.0, 53.0)
    files.write_table(files.element_rows(sats), str(tmp_path / "e"), {"shell": "x", "n": 12})
    text = [r.value for r in spark.read.text(str(tmp_path / "e")).collect()]
    assert text[:2] == ["# shell: x", "# n: 12"] and text[2].startswith("sat_id,a_km") and len(text) == 15
    back = files.read_elements(spark, str(tmp_path / "e"))
    assert back.count() == 12 and back.agg(F.max("a_km")).first()[0] == pytest.approx(orbit.RE + 650)
    cells = grid.latlon_grid(spark, 10, 20, 70, 80, 5)
    rows = files.coverage_rows(coverage_plan.run_coverage(cells, sats, 3, 60.0, overlap_s=0.0))
    assert rows.columns == ["cell_id", "lat", "lon", "availability", "mbb_feasible", "mbb_overlap_worst_s", "mbb_n_handovers"]
    files.write_table(rows, str(tmp_path / "c"), {"k": 1})
    assert files.read_cells(spark, str(tmp_path / "c")).count() == 9
    sweep = coverage_plan.run_sweep(spark, cells, sizes=[40], altitude_km=650.0, n_steps=3, step_s=60.0, target=0.9)[1]
    assert files.sweep_rows(sweep, "coverage_vs_n").columns[:4] == ["N", "planes", "sats_per_plane", "mean_sats_in_view"]
    assert files.sweep_rows(coverage_plan.smallest_by(sweep, 0.9), "min_n_vs_inclination").columns == ["inclination_deg", "min_n_k1", "min_n_k2", "min_n_mbb"]
    with pytest.raises(ValueError):
        files.sweep_rows(sweep, "other")
    assert files.run_path("out/a.csv", 3) == "out/a_run3.csv" and files.run_path("out", 1) == "out_run1"


def test_text_blocks(spark, tmp_path):
    block = 'entity {\n  id: "satellite-%d-platform"\n  nested {\n    a: "x%d"\n    z: "y%d"\n  }\n}\n'
    (tmp_path / "m.txt").write_text("".join(block % (i, i, i) for i in range(50)))
    rows = {r.id: r for r in files.text_blocks(spark, str(tmp_path / "m.txt")).collect()}
    assert len(rows) == 50 and (rows["satellite-7-platform"].a, rows["satellite-7-platform"].z) == ("x7", "y7")
    assert rows["satellite-49-platform"].body.startswith("  id:") and "entity" not in rows["satellite-0-platform"].body


def test_record_dump_and_pull(spark, tmp_path):
    from satspan.more_queries import store as made

    store = made(spark, "/root/testdata/sf0.001")
    entities.record(store, str(tmp_path / "r"), ["INSTALLED"])
    again = entities.EntityStore.recorded(spark, str(tmp_path / "r"))
    for kind in (None, 11, 40):
        assert again.list_entities(kind).count() == store.list_entities(kind).count()
    assert entities.inventory(again).collect() == entities.inventory(store).collect()
    assert again.list_intents().count() == store.list_intents(["INSTALLED"]).count() and again.list_intents(["WITHDRAWN"]).count() == 0
    cells = grid.latlon_grid(spark, 10, 20, 70, 80, 5)
    a, b = (coverage_plan.pull_and_cover(s, cells, 3, 60.0, 5.0).select("cell_idx", "sat_sum") for s in (store, again))
    assert a.count() == 9 and a.exceptAll(b).isEmpty()
    manifest = {r.kind: r.n for r in entities.dump(store, str(tmp_path / "d")).collect()}
    assert manifest[None] == manifest[11] + manifest[40] and spark.read.parquet(str(tmp_path / "d")).where("kind = 40").count() == manifest[40]
    none = entities.EntityStore.of(store.list_entities(40), store.list_relationships(), store.list_intents())
    with pytest.raises(ValueError):
        coverage_plan.pull_and_cover(none, cells, 3, 60.0)

    def fails():
        raise LookupError("not there")

    assert entities.first_source(fails, lambda: cells).count() == 9
    with pytest.raises(LookupError):
        entities.first_source(fails, fails)


def test_name_based_ids_and_patches(spark):
    import uuid

    names = ["gw--1--ut-1", "", "é 漢"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", model_plan.uuid5(F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in rows} == {n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}
    df = spark.createDataFrame([(1, ("a", 2))], "id int, s struct<x:string,y:int>")
    r = model_plan.patched(df, {"s.y": F.lit(9), "id": F.col("id") + 1}).first()
    assert (r.id, r.s.x, r.s.y) == (2, "a", 9)
    t = model_plan.terminal_model(spark.createDataFrame([('"UT 1" user-terminal-1-x', "user-terminal-1-platform")], "body string, id string"), spark.createDataFrame([(3, 1.0, 2.0)], "n int, lat_deg double, lon_deg double")).first()
    assert (t.id, t.body, t.name, t.place.lat_deg) == ("user-terminal-3-platform", '"UT 3" user-terminal-3-x', "UT-3", 1.0)


def test_region_spreads_over_tasks(spark):
    cells = grid.latlon_grid(spark, 10, 12, 70, 72, 0.5)
    states = access.satellite_states(constellation.walker(spark, 400, 40, 1, 650.0, 48.0), grid.time_steps(spark, 16, 60))
    keys = ["cell_idx", "sat_idx", "t_idx"]
    one, many = (access.in_view(cells, states, 25.0, split=k).select(keys) for k in (1, 8))
    assert one.count() == many.count() > 0 and one.exceptAll(many).isEmpty()


def test_accumulated_stream_equals_batch(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 5).alias("k"), F.col("id").alias("v"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rates.accumulate(stream, lambda df: df.groupBy("k").agg(F.sum("v").alias("s"), F.count("*").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"))
    parts = spark.read.parquet(str(tmp_path / "out"))
    assert parts.select("batch").distinct().count() > 1
    got = {r.k: (r.s, r.n) for r in parts.groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    assert got == {k: (sum(range(k, 300, 5)), 60) for k in range(5)}


def test_search_radius_and_speed():
    assert access.ground_speed_km_s(650.0) == pytest.approx(6.83, abs=0.02)
    assert access.dilation_deg(650.0, 25.0, 0.5, 60.0) > orbit.cap_half_angle_deg(650.0, 25.0) + 0.8
    assert orbit.bisection_steps(60.0, 0.01) == math.ceil(math.log2(6000))
