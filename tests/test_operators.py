import importlib.util
import json
import math

import pytest
from pyspark.sql import functions as F

from satspan.functions import orbit
from satspan.operators import continuity, coverage, network
from satspan.operators.access import in_view, satellite_states
from satspan.plans import coverage_plan
from satspan.sources import constellation, entities, files
from satspan.sources.grid import latlon_grid, time_steps
from satspan.streaming import rates

SPANS = "cell_idx string, sat_idx long, start_idx long, end_idx long, plane_uid long"


def test_walker_and_cap(spark):
    rows = constellation.walker(spark, 24, 6, 1, 650.0, 53.0).orderBy("sat_idx").collect()
    assert rows[5].plane_uid == 1 and rows[5].slot_id == 1 and rows[23].sat_id == "shell-P05-S03"
    assert rows[4].raan_rad == pytest.approx(math.radians(60))
    with pytest.raises(ValueError):
        constellation.walker(spark, 25, 6, 1, 650.0, 53.0)
    assert orbit.cap_half_angle_deg(650.0, 25.0) == pytest.approx(9.674, abs=0.02)
    assert constellation.preset(spark, "dual-1600").agg(F.countDistinct("plane_uid")).first()[0] == 60


def test_explicit_planes(spark):
    planes = spark.createDataFrame([(0.0, [0.0, 1.0, 2.0]), (0.8, [0.0, 1.0])], "raan_rad double, phase_rad array<double>")
    rows = constellation.explicit_planes(planes, 600.0, 50.0).orderBy("sat_idx").collect()
    assert [(r.plane_uid, r.slot_id) for r in rows] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)] and rows[4].sat_id == "shell-004"


def test_elevation_and_sun_synchronous_drift(spark):
    h = math.sqrt((orbit.RE + 650) ** 2 - orbit.RE**2)
    sats = spark.createDataFrame(
        [(0, 0, orbit.RE + 650, 0.0, 0.0, 0.0, 0.0), (1, 0, orbit.RE, h, 0.0, 0.0, 0.0), (2, 0, 0.0, orbit.RE + 650, 0.0, 0.0, 90.0)],
        "sat_idx long, t_idx long, x double, y double, z double, sub_lat_deg double, sub_lon_deg double",
    )
    cell = spark.createDataFrame([(0, 0.0, 0.0)], "cell_idx long, lat_deg double, lon_deg double")
    got = {r.sat_idx: r.elev_deg for r in in_view(cell, sats, -0.01, 650.0, tiled=False).collect()}
    assert got[0] == pytest.approx(90) and got[1] == pytest.approx(0, abs=1e-6) and 2 not in got
    drift = spark.range(1).select(orbit.secular_rates(F.lit(orbit.RE + 700), F.lit(0.0), F.radians(F.lit(98.19)))[0]).first()[0]
    assert 0.95 < math.degrees(drift) * 86400 < 1.02


def test_tiles_give_the_same_access(spark):
    cells = latlon_grid(spark, -85, 85, -180, 175, 17)
    states = satellite_states(constellation.walker(spark, 60, 6, 1, 650.0, 97.0), time_steps(spark, 6, 300))
    keys = ["cell_idx", "sat_idx", "t_idx"]
    for mask in (5.0, 25.0):
        a, b = (in_view(cells, states, mask, 650.0, tiled=t).select(keys) for t in (True, False))
        assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()


def test_coverage_of_high_and_eccentric_satellites(spark):
    cells = latlon_grid(spark, -85, 85, -180, 175, 17)
    high = constellation.walker(spark, 40, 5, 1, 1200.0, 97.0)
    eccentric = constellation.walker(spark, 40, 5, 1, 1500.0, 63.0).withColumn("ecc", F.lit(0.1))
    for sats in (high, eccentric):
        a, b = (coverage_plan.run_coverage(cells, sats, 4, 300, 10.0, tiled=t).select("cell_idx", "sat_sum") for t in (True, False))
        assert b.agg(F.sum("sat_sum")).first()[0] > 0 and a.exceptAll(b).isEmpty()


def test_sweep_equals_single_runs(spark):
    cells = latlon_grid(spark, 10, 30, 70, 90, 5)
    rows = coverage_plan.sweep(cells, coverage_plan.candidates(spark, [200, 400], 40, 650.0, 48.0), 10, 60, 0.99)
    rows = {r.n_sats: r for r in rows.collect()}
    for n, r in rows.items():
        one = coverage_plan.run_coverage(cells, constellation.walker(spark, n, 40, 1, 650.0, 48.0), 10, 60)
        assert one.agg(F.avg("sats_in_view_mean")).first()[0] == pytest.approx(r.mean_sats_in_view)
        assert r.pct_k2 <= r.pct_k1


def test_coverage_keeps_empty_cells(spark):
    cells = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 2.0)], "cell_idx long, lat_deg double, lon_deg double")
    access = spark.createDataFrame([(0, 0, 30.0), (0, 0, 40.0), (0, 2, 25.0), (0, 3, 26.0)], "cell_idx long, t_idx long, elev_deg double")
    rows = {r.cell_idx: r for r in coverage.coverage(cells, access, 4).collect()}
    assert (rows[0].availability_k1, rows[0].availability_k2, rows[0].sats_in_view_mean) == (0.75, 0.25, 1.0)
    assert (rows[1].availability_k1, rows[1].sat_sum) == (0.0, 0)


def test_intervals_and_gaps(spark):
    access = spark.createDataFrame([(0, 0, t) for t in (0, 1, 2)] + [(0, 1, t) for t in (1, 4, 5)], "cell_idx long, sat_idx long, t_idx long")
    got = sorted(tuple(r) for r in continuity.intervals(access, ["cell_idx", "sat_idx"]).select("sat_idx", "start_idx", "end_idx").collect())
    assert got == [(0, 0, 2), (1, 1, 1), (1, 4, 5)]
    cells = spark.createDataFrame([(0,), (7,)], "cell_idx long")
    gaps = {r.cell_idx: r.worst_gap_steps for r in continuity.worst_gap(cells, access, 6).collect()}
    assert gaps == {0: 1, 7: 6}


@pytest.mark.parametrize(
    ("n", "spans", "least", "planes", "want"),
    [
        (5, [(0, 0, 4, 0)], 2, False, (True, -1, 0)),
        (5, [(0, 0, 2, 0), (1, 1, 4, 1)], 2, False, (True, 2, 1)),
        (5, [(0, 0, 2, 0), (1, 1, 4, 1)], 3, False, (False, -1, -1)),
        (5, [(0, 0, 1, 0), (1, 3, 4, 1)], 1, False, (False, -1, -1)),
        (5, [(0, 1, 4, 0)], 1, False, (False, -1, -1)),
        (9, [(0, 0, 2, 0), (1, 2, 5, 1), (2, 5, 8, 2)], 1, False, (True, 1, 2)),
        (6, [(0, 0, 2, 0), (1, 3, 5, 1)], 1, False, (False, -1, -1)),
        (5, [(0, 0, 2, 7), (1, 1, 4, 7)], 1, True, (False, -1, -1)),
        (5, [(0, 0, 2, 7), (1, 1, 4, 8)], 1, True, (True, 2, 1)),
        (5, [(0, 0, 2, -1), (1, 1, 4, 5)], 1, True, (False, -1, -1)),
    ],
)
def test_handover_cases(spark, n, spans, least, planes, want):
    rows = spark.createDataFrame([("c", *s) for s in spans], SPANS)
    r = continuity.handover(rows, n, least, planes).first()
    assert (r.feasible, r.worst_overlap, r.n_handovers) == want


def test_observed_coverage(spark):
    rows = [
        ("T:b#sat-1-platform-a0@10/70", 1000, 10.0, [True, True, False]), ("T:b#sat-2-platform-a0@10/70", 1000, 10.0, [True, False, False]),
        ("T:b#sat-1-platform-a1@10/70", 1000, 10.0, [True, True, False]), ("T:b#sat-1-platform-a0@20/75", 1000, 10.0, [False] * 3), ("other", 0, 1.0, [True]),
    ]
    df = spark.createDataFrame(rows, "id string, interval_start_s long, sampling_resolution_s double, accessibilities array<boolean>")
    got = {r.lat_deg: r for r in network.observed_coverage(df).collect()}
    assert got[10.0].availability_k1 == pytest.approx(2 / 3) and got[10.0].availability_k2 == pytest.approx(1 / 3)
    assert got[10.0].sats_in_view_mean == pytest.approx(1.0) and got[20.0].availability_k1 == 0 and got[20.0].n_time == 3


def test_entities(spark, tmp_path):
    k = {"semimajor_axis_m": 7028137.0, "eccentricity": 0.0, "inclination_deg": 53.0, "raan_deg": 0.0, "argument_of_periapsis_deg": 0.0, "true_anomaly_deg": 0.0}
    plat = lambda i, e, **m: {"id": i, "kind": 11, "platform": {"name": i, "is_external_system": e, "motion": {"entry": [m]}}}
    doc = {
        "entities": [
            plat("p0", False, keplerian_elements=k | {"epoch": {"seconds": 1000}}), plat("p1", False, keplerian_elements=k | {"epoch": {"seconds": 1060}}),
            plat("x", True, keplerian_elements=k), plat("t", True, tle={"line1": "1", "line2": "2"}), {"id": "a0", "kind": 40, "antenna": {"type": "d"}},
        ],
        "relationships": [{"kind": 4, "a": "p0", "z": "a0"}],
        "intents": [{"id": "i", "state": "INSTALLED", "route": {"path_segments": [{"src_network_node_id": "p0", "dst_network_node_id": "p1"}]}}],
    }
    (tmp_path / "d.json").write_text(json.dumps(doc))
    store = entities.EntityStore(spark, str(tmp_path / "d.json"))
    assert {r.id: r.skip_reason for r in entities.verdicts(store).collect()} == {"p0": None, "p1": None, "x": "external system", "t": "non-keplerian motion"}
    rows = {r.sat_id: r for r in entities.elements(store, 1000).collect()}
    n0 = math.sqrt(orbit.MU / 7028.137**3)
    assert rows["p0"].m_rad == pytest.approx(0) and rows["p1"].m_rad == pytest.approx(-n0 * 60 % (2 * math.pi))
    assert {r.id: list(r.antenna_ids) for r in entities.antennas(store).collect()}["p0"] == ["a0"]
    hop = entities.hops(store.list_intents(["INSTALLED"])).first()
    assert (hop.src_network_node_id, hop.dst_network_node_id) == ("p0", "p1")
    with pytest.raises(LookupError):
        store.get_entity("none")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(500).select(F.timestamp_seconds(F.col("id") * 7).alias("ts"), (F.col("id") % 3).cast("string").alias("kind"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = rates.change_rate(rates.read_stream(spark, str(tmp_path / "in"), rows.schema), "ts", "kind", "5 minutes")
    got = rates.run_to_end(stream, "rates_test", str(tmp_path / "cp"))
    want = rates.change_rate(rows, "ts", "kind", "5 minutes")
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("# a: b\nsat_id,a_km,e,i_rad,raan_rad,argp_rad,M_rad\ns1,7000,0,1,2,0,3\n")
    assert files.read_elements(spark, str(tmp_path / "e.csv")).first().M_rad == 3.0
    (tmp_path / "d.csv").write_text("lat,lon,h\ndeg,deg,m\n28.5,80.5,400\n28.5,440.5,200\n")
    r = files.read_elevation(spark, str(tmp_path / "d.csv")).collect()
    assert len(r) == 1 and (r[0].lon_deg, r[0].height_m) == (80.5, 300.0)
    files.write_csv(spark.range(3), str(tmp_path / "out"), {"k": 1})
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_bisection_and_kepler(spark):
    r = spark.range(1).select(
        orbit.bisect(F.lit(0.0), F.lit(60.0), lambda t: -5 + 0.5 * (t - 27), F.lit(10.0), 30).alias("x"),
        orbit.bisect(F.lit(0.0), F.lit(20.0), lambda t: -5 + 0.5 * (t - 27), F.lit(10.0), 30).alias("none"),
        orbit.eccentric_anomaly(F.lit(1.0), F.lit(0.3)).alias("e"),
    ).first()
    assert r.x == pytest.approx(57.0, abs=0.01) and r.none is None and r.e - 0.3 * math.sin(r.e) == pytest.approx(1.0)


@pytest.mark.parametrize("name", ["coverage_by_cell", "mbb_continuity", "asof_reference", "dump_manifest"])
def test_queries_match_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for t in ("supplier", "customer", "events", "orders", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, folder)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    key = lambda rows: sorted([tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows], key=str)
    assert key(got.select(cols).collect()) == key(want)


def test_entry_without_the_training_operators(monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "_LLM", False)
    monkeypatch.setattr(__spark_entry__, "_PIPELINE", False)
    assert set(__spark_entry__.queries()) == set(__spark_entry__.oracle_sql())
    assert importlib.util.find_spec("satspan.queries")
