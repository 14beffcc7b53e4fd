"""Hexagonal cells, contact times, loads, block scans, model cloning, dumps, windows and progress."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from satspan.functions import orbit
from satspan.operators import access, bitemporal, contacts, continuity
from satspan.plans import coverage_plan, model_plan, progress
from satspan.sources import blocks, constellation, entities, grid, hexgrid, loading

# --- hexagonal cells ------------------------------------------------------------


def globe(spark, n, seed=1):
    return spark.range(n).select("id", F.degrees(F.asin(2 * F.rand(seed) - 1)).alias("lat_deg"), (360 * F.rand(seed + 1) - 180).alias("lon_deg"))


@pytest.fixture(scope="module")
def level_two(spark):
    return hexgrid.hex_cells(globe(spark, 40_000), 2).collect()


def test_icosahedron_by_rule():
    assert len(hexgrid.faces()) == 20 and len(hexgrid.base_cells()) == 122
    for i, face in enumerate(hexgrid.faces()):
        assert math.dist(face["f"], (0, 0, 0)) == pytest.approx(1)
        for k in range(3):
            j, turn, shift = hexgrid.edges()[3 * i + k]
            back = next(e for e in hexgrid.edges()[3 * j : 3 * j + 3] if e[0] == i)
            assert abs(turn) == pytest.approx(1) and abs(back[1] * (turn * 0.3 + shift) + back[2] - 0.3) < 1e-9
    assert len({c[0] for c in hexgrid.corners()}) <= 12


def test_cells_have_one_name_and_one_centre(spark, level_two):
    centres = {}
    for r in level_two:
        centres.setdefault(r["hex_id"], set()).add((round(r["hex_lat_deg"], 8), round(r["hex_lon_deg"] % 360, 6) % 360))
    assert all(len(c) == 1 for c in centres.values()) and 5500 < len(centres) <= 2 + 120 * 49
    # the centre's own cell is the cell, and no other centre of the same face side is much nearer
    again = spark.createDataFrame([(k, *min(c)) for k, c in centres.items()], "want string, lat_deg double, lon_deg double")
    assert hexgrid.hex_cells(again, 2).where("want <> hex_id").isEmpty()


def test_parents_are_cut_names_and_hold_their_children(spark, level_two):
    children = {}
    for r in level_two:
        children.setdefault(r["hex_id"][:-1], set()).add(r["hex_id"])
    assert max(len(c) for c in children.values()) == 7 and len(children) == 842
    assert sum(len(c) == 6 for c in children.values()) >= 12  # the corners' cells have six
    # the parent of a cell is the cell of its centre one level up
    one = spark.createDataFrame([(r["hex_id"], r["hex_lat_deg"], r["hex_lon_deg"]) for r in {r["hex_id"]: r for r in level_two}.values()], "fine string, lat_deg double, lon_deg double")
    up = hexgrid.hex_cells(one, 1).select("hex_id", hexgrid.hex_parent(F.col("fine"), 1).alias("parent"))
    same = up.agg(F.avg((F.col("hex_id") == F.col("parent")).cast("int"))).first()[0]
    assert same == 1.0
    shards = hexgrid.hex_shards(one.withColumnRenamed("fine", "hex_id"), 0)
    assert shards.select("shard_id").distinct().count() == 122
    with pytest.raises(Exception, match="finer"):
        hexgrid.hex_shards(one.withColumnRenamed("fine", "hex_id"), 3).collect()


def test_areas_are_even(spark):
    counts = [r["count"] for r in hexgrid.hex_cells(globe(spark, 60_000, 5), 0).groupBy("hex_id").count().collect()]
    mean = 60_000 / 122
    assert len(counts) == 122 and min(counts) > 0.45 * mean and max(counts) < 1.4 * mean
    assert hexgrid.average_edge_km(3) == pytest.approx(69.0, abs=1.0)


def test_box_of_cells_and_edges_of_input(spark):
    box = hexgrid.hex_fill(spark, (20.0, 24.0, 76.0, 82.0), 3)
    rows = box.collect()
    area = math.radians(6) * (math.sin(math.radians(24)) - math.sin(math.radians(20))) * 6371.007**2
    assert len(rows) == pytest.approx(area / (4 * math.pi * 6371.007**2 / (2 + 120 * 343)), rel=0.35) and all(20 <= r["lat_deg"] <= 24 and 76 <= r["lon_deg"] <= 82 for r in rows)
    line = hexgrid.hex_fill(spark, (-10.0, 10.0, 175.0, -175.0), 1).collect()
    assert any(r["lon_deg"] > 175 for r in line) and any(r["lon_deg"] < -175 for r in line)
    points = spark.createDataFrame([(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0), (None, 1.0)], "lat_deg double, lon_deg double")
    named = [r["hex_id"] for r in hexgrid.hex_cells(points, 2).collect()]
    assert named[2] == named[3] and named[4] is None and None not in named[:4]
    assert hexgrid.hex_cells(points.where("false"), 2).count() == 0


#: The cells of the published sweep's country, whole cells of level 2
#: (five digits) and single ones of level 3.
COUNTRY = """
001022 001023 00103 001040 001041 001042 001043 001044 001101 001102 001113 001114 001120 001121 001123 001124 001125 001126 00113 001142
00120 00121 00122 00123 00124 00125 001260 001261 001262 001263 001264 001266 00130 00131 001320 001321 001322 001324 001325 001326 001336
001341 001345 001346 00135 00136 001400 001405 001411 001412 001416 001450 001451 001452 001455 001456 001460 001463 001464 001466 001522
001523 001524 001530 001531 001532 001533 001536 002400 002401 002403 002404 002405 002406 002413 002414 002441 002444 002445 002446 00245
002460 002461 002463 002464 002465 002466 002534 002535 002540 002542 002543 002544 002545 002546 002550 002553 002554 002555 042004 042034
042035 04204 04205 042410 042411 042412 042413 042415 042416 042426 042461 042465 042466 04250 042510 042512 042513 042514 042515 04252
04253 04254 04255 04256
""".split()


def test_published_sweep(spark):
    """The published sweep over 251 cells: 40 planes, 650 km, 48 degrees, 30 minutes
    at 60 s, mask 25, on our own hexagonal cells."""
    inside = F.col("hex_id").isin(COUNTRY) | hexgrid.hex_parent(F.col("hex_id"), 2).isin(COUNTRY)
    cells = hexgrid.hex_fill(spark, grid.AREAS["India"], 3).where(inside)
    cells = spark.createDataFrame([(i, r["lat_deg"], r["lon_deg"]) for i, r in enumerate(cells.collect())], "cell_idx long, lat_deg double, lon_deg double")
    assert cells.count() == 251
    table = coverage_plan.sizes_of(spark, [200, 400, 600], 40, [48.0])
    rows = {r.n_sats: r for r in coverage_plan.shape_sweep(cells, table, 650.0, 30, 60.0, 0.99).collect()}
    # Share of cells at the target, mean availability, mean in view.
    want = {
        200: (0.015936, 0.0, 0.641301, 0.489641, 1.484993), 400: (0.764940, 0.398406, 0.977689, 0.915272, 2.968393), 600: (1.0, 1.0, 1.0, 1.0, 4.452324),
    }
    for n, (k1, k2, a1, a2, siv) in want.items():
        r = rows[n]
        assert (round(r.pct_k1, 6), round(r.pct_k2, 6), round(r.mean_avail_k1, 6), round(r.mean_avail_k2, 6)) == (k1, k2, a1, a2)
        assert r.mean_sats_in_view == pytest.approx(siv, abs=5e-4)
    told = spark.createDataFrame([(r.n_sats, r.pct_k1, r.pct_k2) for r in rows.values()], "n_sats long, pct_k1 double, pct_k2 double")
    least = coverage_plan.smallest(told, 0.95).first()
    assert (least.min_n_k1, least.min_n_k2) == (600, 600)


# --- contact times --------------------------------------------------------------


def test_contact_times_match_a_fine_grid(spark):
    sats = constellation.walker(spark, 12, 3, 1, 650.0, 53.0, "w").withColumn("ecc", F.when(F.col("sat_idx") % 2 == 0, 0.0).otherwise(0.02))
    cells = spark.createDataFrame([(0, 10.0, 20.0), (1, -48.0, 100.0), (2, 60.0, -30.0)], "cell_idx long, lat_deg double, lon_deg double")
    n, step = 100, 60.0
    seen = access.in_view(cells, access.satellite_states(sats, grid.time_steps(spark, n, step)), 10.0)
    spans = continuity.intervals(seen, ["cell_idx", "sat_idx"])
    got = contacts.contact_times(spans, cells, sats, n, step, 10.0, 1e-4).collect()
    assert len(got) == spans.count() > 10
    # the margin on a grid of 1/200 s around each end, by the same states
    fine, checks = 200, 0
    for r in got:
        for t, edge in ((r["start_s"], r["start_idx"] == 0), (r["end_s"], r["end_idx"] == n - 1)):
            if edge:
                assert t in (0.0, (n - 1) * step)
                continue
            if checks >= 6:
                continue
            checks += 1
            base = math.floor(t) - 1
            times = spark.range(3 * fine).select(F.col("id").alias("t_idx"), (F.lit(float(base)) + F.col("id") / fine).alias("t_s"))
            times = times.withColumn("gmst_rad", orbit.gmst(F.lit(grid.EPOCH_JD) + F.col("t_s") / 86400.0))
            states = access.satellite_states(sats.where(F.col("sat_idx") == r["sat_idx"]), times)
            view = access.in_view(cells.where(F.col("cell_idx") == r["cell_idx"]), states, 10.0, tiled=False)
            edge_t = view.agg(F.min("t_s"), F.max("t_s")).first()
            near = edge_t[0] if t == r["start_s"] else edge_t[1]
            assert abs(near - t) <= 1 / fine + 1e-3
    assert checks == 6
    total = contacts.contact_seconds(spark.createDataFrame(got), "cell_idx").collect()
    assert sum(x["n_contacts"] for x in total) == len(got) and all(x["shortest_s"] <= x["longest_s"] <= x["contact_s"] for x in total)


# --- loads ----------------------------------------------------------------------


def test_load_stopped_half_way_and_run_again(spark, tmp_path):
    path = str(tmp_path / "target")
    rows = spark.range(500).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    assert {r["state"] for r in loading.load_report(rows, path, "k", 8).collect()} == {"empty"}

    stop = F.when(F.col("k") == 333, F.raise_error(F.lit("power cut")).cast("string")).otherwise(F.col("v"))
    with pytest.raises(Exception, match="power cut"):
        loading.load(rows.withColumn("v", stop), path, "k", 8)
    # a load of an older writer that stopped: whole buckets, part of one, a repeated one, a wrong one and a strange one
    placed = rows.withColumn("bucket", loading.bucket_of("k", 8))
    odd = placed.where("bucket <= 2").unionByName(placed.where("bucket = 3 AND k % 2 = 0")).unionByName(placed.where("bucket = 1"))
    odd = odd.unionByName(placed.where("bucket = 4").withColumn("v", F.lit("wrong"))).unionByName(placed.where("k = 0").withColumn("bucket", F.lit(77)))
    odd.write.mode("append").partitionBy("bucket").parquet(path)
    states = {r["bucket"]: r["state"] for r in loading.load_report(rows, path, "k", 8).collect()}
    assert states == {0: "complete", 1: "partial", 2: "complete", 3: "partial", 4: "partial", 5: "empty", 6: "empty", 7: "empty", 77: "stale"}
    kept = {f for f in os.listdir(f"{path}/bucket=0")}
    assert loading.load(rows, path, "k", 8) == {"complete": 2, "partial": 3, "empty": 3, "stale": 1}
    assert sorted(map(tuple, loading.loaded(spark, path, rows.schema).collect())) == [(i, f"v{i}") for i in range(500)]
    assert {f for f in os.listdir(f"{path}/bucket=0")} == kept  # complete buckets are not written again
    assert loading.load(rows, path, "k", 8) == {"complete": 8, "partial": 0, "empty": 0, "stale": 0}
    assert loading.loaded(spark, str(tmp_path / "none"), rows.schema).count() == 0
    assert loading.load(rows.where("false"), path, "k", 8)["stale"] == 8 and loading.loaded(spark, path, rows.schema).count() == 0


# --- block scan -----------------------------------------------------------------


def by_hand(text):
    out, depth, start, i, quiet = [], 0, 0, 0, None
    while i < len(text):
        c = text[i]
        if quiet == '"':
            if c == "\\":
                i += 1
            elif c == '"':
                quiet = None
        elif quiet == "#":
            quiet = None if c == "\n" else quiet
        elif c in '"#':
            quiet = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1].strip())
                start = i + 1
        i += 1
    return out


def test_blocks_over_many_ranges(spark, tmp_path):
    r = random.Random(6)
    parts = []
    for i in range(400):
        inner = "".join(f'  part {{ name: "q{{{r.randrange(9)}\\" }}" # note }}}}\n    deep {{ x: {j} }} }}\n' for j in range(r.randrange(4)))
        parts.append(f'entity {{\n  id: "e{i}"\n  a: "a{i}" z: "z{i}"\n{inner}}}\n' + r.choice(["", "\n", "# a comment {{{\n"]))
    parts.append("entity {\n" + "".join(f"  long {{ k: {k} }}\n" for k in range(4000)) + "}\n")  # longer than several ranges
    parts.append('entity { id: "x" } entity { id: "y" }\ntail without a block')
    text = "".join(parts)
    (tmp_path / "dump.txtpb").write_text(text)
    (tmp_path / "small.txtpb").write_text('other { }\nentity {\n  id: "only"\n}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = blocks.blocks(spark, str(tmp_path))
        got = rows.collect()
        n_ranges = spark.read.text(str(tmp_path / "dump.txtpb")).select("_metadata.file_block_start").distinct().count()
        assert n_ranges > 10
        mine = [x["text"] for x in sorted((x for x in got if "dump" in x["path"]), key=lambda x: x["block"])]
        assert mine == by_hand(text) and len(mine) == 403
        found = blocks.entity_blocks(spark, str(tmp_path)).collect()
        assert len(found) == 404 and {x["id"] for x in found} >= {"e7", "only"} and ("e9", "a9", "z9") in {(x["id"], x["a"], x["z"]) for x in found}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "bad.txtpb").write_text("a { } }\n")
    with pytest.raises(Exception, match="closes nothing"):
        blocks.blocks(spark, str(tmp_path / "bad.txtpb")).collect()


# --- model cloning --------------------------------------------------------------

TEMPLATE = [
    ("satellite-1-platform", 'id: "satellite-1-platform" grid: 1200.1.1 not 1200.1.15'), ("satellite-1-antenna", 'on "satellite-1-platform" uses "radio"'),
    ("radio", 'id: "radio"'), ("satellite-1-oisl-north", "link"), ("satellite-2-platform", "other"), ("user-terminal-1-platform", '"UT 1" user-terminal-1-platform'),
    ("pop-1", "global"), ("pop-2", "global too"),
]
LINKS = [
    (4, "satellite-1-platform", "satellite-1-antenna", "b"), (4, "satellite-1-antenna", "radio", 'z: "radio"'), (4, "radio", "satellite-1-antenna", "cycle"),
    (5, "satellite-1-antenna", "pop-1", "leaves"), (5, "pop-1", "pop-2", "stays"), (5, "satellite-1-platform", "satellite-2-platform", "other"),
    (5, "user-terminal-1-platform", "user-terminal-1-platform", "self"),
]


def test_network_model_clones_subtrees(spark):
    ents = spark.createDataFrame(TEMPLATE, "id string, body string")
    rels = spark.createDataFrame(LINKS, "kind int, a string, z string, body string")
    sats = spark.createDataFrame([(i, i // 2, 7000.0, 0.0, 0.9, 0.1 * (i // 2), 0.0, 0.5) for i in range(4)], "sat_idx long, plane_uid long, a_km double, ecc double, inc_rad double, raan_rad double, argp_rad double, m_rad double")
    users = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "n long, lat_deg double, lon_deg double")
    assert {tuple(r) for r in model_plan.subtree(rels.where("kind = 4"), ents.where("id = 'satellite-1-platform'")).collect()} == {("satellite-1-platform", x) for x in ("satellite-1-platform", "satellite-1-antenna", "radio")}
    out, links = model_plan.network_model(ents, rels, sats, 1_700_000_000, users)
    rows = {r["id"]: r for r in out.collect()}
    want = {f"satellite-{i}-{x}" for i in range(1, 5) for x in ("platform", "antenna", "radio")} | {"pop-1", "pop-2", "user-terminal-1-platform", "user-terminal-2-platform"}
    assert set(rows) == want and out.count() == len(want)
    third = rows["satellite-3-platform"]
    assert third["name"] == "SAT-3 (2.1)" and third["body"] == 'id: "satellite-3-platform" grid: 1200.2.1 not 1200.1.15'
    assert third["keplerian_elements"]["epoch"]["seconds"] == 1_700_000_000 and third["keplerian_elements"]["semimajor_axis_m"] == 7_000_000.0
    assert rows["satellite-2-antenna"]["body"] == 'on "satellite-2-platform" uses "satellite-2-radio"' and rows["satellite-2-radio"]["body"] == 'id: "satellite-2-radio"'
    assert rows["user-terminal-2-platform"]["name"] == "UT-2" and rows["user-terminal-2-platform"]["place"]["lon_deg"] == 4.0 and rows["user-terminal-2-platform"]["body"].startswith('"UT 2"')
    got = sorted((r["a"], r["z"]) for r in links.collect())
    each = [(f"satellite-{i}-{a}", f"satellite-{i}-{z}") for i in range(1, 5) for a, z in (("platform", "antenna"), ("antenna", "radio"), ("radio", "antenna"))]
    assert got == sorted([*each, ("pop-1", "pop-2"), *[(f"user-terminal-{j}-platform",) * 2 for j in (1, 2)]])


# --- dumps, windows and progress --------------------------------------------------


def test_dump_manifest_is_what_was_written(spark, tmp_path):
    schema = spark.createDataFrame([], entities.SCHEMA).schema
    kind = lambda name: schema[name].dataType.elementType
    ents = spark.createDataFrame([(f"p{i}", 11, {"name": f"é{i}"}, None) for i in range(9)] + [(f"a{i}", 40, None, {"type": "x"}) for i in range(5)] + [("n", 7, None, None)], kind("entities"))
    rels = spark.createDataFrame([(4, "p0", "a0"), (4, "p1", "a1"), (9, "p0", "p1")], kind("relationships"))
    store = entities.EntityStore.of(ents, rels, spark.createDataFrame([("i", "INSTALLED", None)], kind("intents")))
    path = str(tmp_path / "dump")
    manifest = {r["group"]: (r["n"], r["n_bytes"]) for r in entities.grouped_dump(store, path).collect()}
    files = {}
    for folder in os.listdir(path):
        if folder.startswith("group="):
            texts = [open(f"{path}/{folder}/{f}", "rb").read() for f in os.listdir(f"{path}/{folder}") if f.startswith("part-")]
            files[folder[6:]] = (sum(t.count(b"\n") for t in texts), sum(map(len, texts)))
            assert all(json.loads(line) for t in texts for line in t.splitlines())
    assert manifest.pop(None) == (sum(n for n, _ in files.values()), sum(b for _, b in files.values()))
    assert manifest == files and files["entities_antenna"][0] == 5 and files["relationships_other"][0] == 1 and set(files) <= set(entities.groups())


def test_smallest_window_with_a_commit(spark):
    now = 10_000_000_000
    rows = [("a", now - 5_000_000, 3), ("a", now - 50_000_000, 1), ("b", now - 90_000_000, 7), ("b", now - 91_000_000, 2), ("c", now + 1, 9), ("d", now - 10**10, 1)]
    table = spark.createDataFrame(rows, "kind string, at long, id long")
    chosen = bitemporal.smallest_window(table, "kind", "at", [100, 10, 60], now)
    assert {tuple(r) for r in chosen.collect()} == {("a", 10, 1, 3), ("b", 100, 2, 2), ("c", None, 0, None), ("d", None, 0, None)}
    assert sorted(r["id"] for r in bitemporal.read_windows(table, chosen, "kind", "at", now).collect()) == [2, 3, 7]


def test_progress_of_a_sweep(spark):
    calls = []
    cells = spark.range(300).select(F.col("id").alias("cell_idx"), (F.col("id") % 60).cast("double").alias("lat_deg"), (F.col("id") % 170).cast("double").alias("lon_deg"))
    table = coverage_plan.sizes_of(spark, [40, 80], 4, [53.0])
    rows = progress.with_progress(spark, lambda: coverage_plan.shape_sweep(cells, table, 650.0, 20, 60.0, 0.5, 10.0).collect(), 50, lambda a, b: calls.append((a, b)), 0.02)
    assert len(rows) == 2 and calls[0] == (0, 50) and calls[-1] == (50, 50)
    done = [a for a, _ in calls]
    assert done == sorted(done) and len(set(done)) >= 3 and {b for _, b in calls} == {50}
    with pytest.raises(ZeroDivisionError):
        progress.with_progress(spark, lambda: 1 / 0, 3, lambda a, b: None)
    told = []
    progress.with_progress(spark, lambda: spark.range(10).count(), 2, progress.timed(lambda a, b, s: told.append(s)))
    assert told == sorted(told) and told[0] >= 0


# --- places in an order -------------------------------------------------------------


def test_numbers_and_later_values_without_one_task(spark):
    from satspan.operators import ranking

    r = random.Random(8)
    rows = [(i, r.choice([None, 7.0, 7.0, float(r.randrange(50))])) for i in r.sample(range(1000), 400)]
    table = spark.createDataFrame(rows, "k long, v double").repartition(5)
    numbered = {x["k"]: x["n"] for x in ranking.numbered_rows(table, "n", "k").collect()}
    assert numbered == {k: n for n, (k, _) in enumerate(sorted(rows, key=lambda x: x[0]))}
    later = {x["k"]: x["least"] for x in ranking.least_of_later(table, "k", "v", "least").collect()}
    for k, _ in rows:
        assert later[k] == min((v for j, v in rows if j > k and v is not None), default=None)
    same = ranking.numbered_rows(table.withColumn("k", F.lit(1)), "n", "k").agg(F.countDistinct("n"), F.max("n")).first()
    assert tuple(same) == (400, 399)
    assert ranking.numbered_rows(table.where("false"), "n", "k").count() == ranking.least_of_later(table.where("false"), "k", "v", "x").count() == 0
