"""Further registered queries: areas, constellations, sweeps, snapshots, observed
coverage and model logs over the driver's tables, each with a DuckDB twin."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satspan import queries as base
from satspan.functions import orbit
from satspan.operators import access, continuity, coverage, network
from satspan.plans import coverage_plan, model_plan
from satspan.sources import constellation, entities, files, grid
from satspan.streaming import rates

QUERIES = {}
SQL: dict[str, str] = {}
N_TIME, STEP_S, MASK, PLANES = base.N_TIME, base.STEP_S, base.MASK, base.PLANES


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Areas and cells -----------------------------------------------------------------

_BOXES = "VALUES " + ", ".join(f"('{k}', {', '.join(f'{x}::DOUBLE' for x in v)})" for k, v in grid.AREAS.items())


@_query(f"WITH {base._CELLS}, box(area, s, n, w, e) AS ({_BOXES}) SELECT area, count(*) AS n_cells FROM cell, box WHERE lat BETWEEN s AND n AND lon BETWEEN w AND e GROUP BY area")
def cells_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in grid.AREAS:
        one = grid.clip(base.cells(spark, sf_dir), name).groupBy(F.lit(name).alias("area")).agg(F.count("*").alias("n_cells"))
        out = one if out is None else out.unionByName(one)
    return out


@_query(
    f"""WITH {base._CELLS}, b AS (SELECT floor(min(lat)) AS s, floor(min(lon)) AS w, CAST(floor((ceil(max(lat)) - floor(min(lat))) / 2.5 + 1e-9) AS BIGINT) + 1 AS rows, CAST(floor((ceil(max(lon)) - floor(min(lon))) / 2.5 + 1e-9) AS BIGINT) + 1 AS wide FROM cell),
    g AS (SELECT r.range * wide + p.range AS cell_idx, s + r.range * 2.5 AS lat_deg, w + p.range * 2.5 AS lon_deg FROM b, range(200) r, range(200) p WHERE r.range < rows AND p.range < wide),
    n AS (SELECT CAST(floor((lat - s) / 2.5) AS BIGINT) * wide + CAST(floor((lon - w) / 2.5) AS BIGINT) AS cell_idx, count(*) AS n FROM cell, b GROUP BY 1)
    SELECT cell_idx, round(lat_deg, 6) AS lat_deg, round(lon_deg, 6) AS lon_deg, coalesce(n, 0) AS n_points FROM g LEFT JOIN n USING (cell_idx)"""
)
def regular_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid over the box of all places, and the places in each cell."""
    places, step = base.cells(spark, sf_dir), 2.5
    low = lambda c: F.floor(F.min(c)).cast("double").alias(f"low_{c}")
    high = lambda c: F.ceil(F.max(c)).cast("double").alias(f"high_{c}")
    box = places.agg(low("lat_deg"), high("lat_deg"), low("lon_deg"), high("lon_deg")).first()
    made = grid.latlon_grid(spark, *box, step)
    wide = int((box[3] - box[2]) / step + 1e-9) + 1
    at = F.floor((F.col("lat_deg") - box[0]) / step) * wide + F.floor((F.col("lon_deg") - box[2]) / step)
    held = places.groupBy(at.alias("cell_idx")).agg(F.count("*").alias("n"))
    return made.join(held, "cell_idx", "left").select("cell_idx", F.round("lat_deg", 6).alias("lat_deg"), F.round("lon_deg", 6).alias("lon_deg"), F.coalesce("n", F.lit(0)).alias("n_points"))


@_query(
    f"""WITH {base._CELLS}, c AS (SELECT a.range AS r, b.range AS p FROM range(50, 61) a, range(0, 144) b WHERE b.range >= 140 OR b.range <= 4),
    g AS (SELECT row_number() OVER (ORDER BY r, p) - 1 AS cell_idx, r, p FROM c),
    n AS (SELECT CAST(floor((lat + 90) / 2.5) AS BIGINT) AS r, CAST(floor((lon + 180) / 2.5) AS BIGINT) AS p, count(*) AS n FROM cell GROUP BY 1, 2)
    SELECT cell_idx, format('c{{:05d}}-{{:05d}}', r, p) AS cell_id, -90 + (r + 0.5) * 2.5::DOUBLE AS lat_deg, -180 + (p + 0.5) * 2.5::DOUBLE AS lon_deg,
      format('c{{:05d}}-{{:05d}}', r // 4, p // 4) AS shard_id, coalesce(n, 0) AS n_points FROM g LEFT JOIN n USING (r, p)"""
)
def date_line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a box across the date line, and the places in each."""
    size = 2.5
    cells = grid.shards(grid.area_cells(spark, (35.0, 60.0, 170.0, -168.0), size), 10.0, size)
    row, place = F.floor((F.col("lat_deg") + 90) / size), F.floor((F.col("lon_deg") + 180) / size)
    held = base.cells(spark, sf_dir).groupBy(grid.cell_columns(row, place, size)["cell_id"].alias("cell_id")).agg(F.count("*").alias("n"))
    return cells.join(held, "cell_id", "left").select("cell_idx", "cell_id", "lat_deg", "lon_deg", "shard_id", F.coalesce("n", F.lit(0)).alias("n_points"))


#: A country of two polygons, one with a hole: rings of longitude and latitude.
COUNTRY = [
    [[(-60.0, -40.0), (80.0, -50.0), (120.0, 10.0), (20.0, 45.0), (-90.0, 20.0)], [(0.0, -20.0), (30.0, -20.0), (30.0, 10.0), (0.0, 10.0)]],
    [[(130.0, -30.0), (150.0, -30.0), (150.0, 30.0)]],
]


def _country(spark: SparkSession) -> DataFrame:
    rings = [[[[float(x) for x in p] for p in ring] for ring in poly] for poly in COUNTRY]
    return spark.createDataFrame([("here", rings), ("elsewhere", rings[:1])], grid.POLYGONS)


def _edges_sql() -> str:
    rows = []
    for k, poly in enumerate(COUNTRY):
        for ring in poly:
            rows += [f"({k}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(ring, ring[1:] + ring[:1])]
    return "VALUES " + ", ".join(rows)


@_query(
    f"""WITH {base._CELLS}, edge(poly, x1, y1, x2, y2) AS ({_edges_sql()})
    SELECT DISTINCT cell_idx FROM (SELECT cell_idx, poly FROM cell, edge WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
    GROUP BY cell_idx, poly HAVING count(*) % 2 = 1)"""
)
def country_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = grid.polygons_of(_country(spark), "here")
    return grid.cells_in_polygons(base.cells(spark, sf_dir), mine).select("cell_idx")


@_query(f"WITH {base._CELLS} SELECT format('c{{:05d}}-{{:05d}}', CAST(floor((lat + 90) / 15) AS BIGINT), CAST(floor((lon + 180) / 15) AS BIGINT)) AS shard_id, count(*) AS n_cells FROM cell GROUP BY 1")
def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.shards(base.cells(spark, sf_dir), 15.0, 1.0).groupBy("shard_id").agg(F.count("*").alias("n_cells"))


@_query("SELECT p_partkey, round((p_size % 7 + 1) / 2.0::DOUBLE * sqrt(2), 9) AS radius_deg, CAST(ceil(p_retailprice / (p_size % 3 + 1) - 1e-9) AS BIGINT) AS n_steps FROM part")
def cell_radii_and_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a part's size and steps of its price."""
    size = F.col("p_size")
    return _t(spark, sf_dir, "part").select(
        "p_partkey", F.round(grid.cell_radius_deg(size % 7 + 1), 9).alias("radius_deg"), grid.steps_of(F.col("p_retailprice"), size % 3 + 1).alias("n_steps")
    )


# Constellations ------------------------------------------------------------------

_SHELLS = "VALUES " + ", ".join(f"('{name}', {k}, {t}, {p}, {f}, {alt}::DOUBLE, {inc}::DOUBLE)" for name, shells in constellation.PRESETS.items() for k, (t, p, f, alt, inc) in enumerate(shells))


@_query(
    f"""WITH shell(preset, k, t, p, f, alt, inc) AS ({_SHELLS})
    SELECT n_nationkey, preset, n_sats, n_planes, mean_altitude_km, mean_inclination_deg, max_altitude_km, min_mask_deg FROM (
      SELECT preset, CAST(sum(t) AS BIGINT) AS n_sats, CAST(sum(p) AS BIGINT) AS n_planes, round(sum(t * alt) / sum(t), 6) AS mean_altitude_km, round(sum(t * inc) / sum(t), 6) AS mean_inclination_deg,
      round(max(alt), 6) AS max_altitude_km FROM shell GROUP BY preset) JOIN (SELECT n_nationkey, list_extract({[*constellation.PRESETS]!r}, n_nationkey % {len(constellation.PRESETS)} + 1) AS preset,
      (SELECT min(s_suppkey % 20 + 5) FROM supplier WHERE s_nationkey = n_nationkey)::DOUBLE AS min_mask_deg FROM nation) USING (preset)"""
)
def preset_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preset that each nation flies, and the smallest mask of its stations."""
    out = None
    for name in constellation.PRESETS:
        sats = constellation.preset(spark, name)
        one = constellation.facts(sats).crossJoin(constellation.bounds(sats).drop("min_mask_deg")).select(
            F.lit(name).alias("preset"), "n_sats", "n_planes", *[F.round(c, 6).alias(c) for c in ("mean_altitude_km", "mean_inclination_deg", "max_altitude_km")]
        )
        out = one if out is None else out.unionByName(one)
    names = F.array(*[F.lit(x) for x in constellation.PRESETS])
    flown = _t(spark, sf_dir, "nation").select("n_nationkey", F.element_at(names, F.col("n_nationkey") % len(constellation.PRESETS) + 1).alias("preset"))
    masks = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min(F.col("s_suppkey") % 20 + 5).cast("double").alias("min_mask_deg"))
    return flown.join(F.broadcast(out), "preset").join(masks, "n_nationkey", "left")  # a row for each preset


@_query(
    f"""WITH n AS (SELECT count(*) AS t FROM supplier), s AS (SELECT s_suppkey AS i, t, s_suppkey // (t // {PLANES}) AS p, s_suppkey % (t // {PLANES}) AS s FROM supplier, n),
    a AS (SELECT i, p, s, radians(10 + p * 360.0 / {PLANES}) AS r, radians(5 + s * 360.0 / (t // {PLANES}) + p * 360.0 / t) AS m FROM s)
    SELECT i AS sat_idx, p AS plane_uid, s AS slot_id, round(r - 2 * pi() * floor(r / (2 * pi())), 9) AS raan_rad, round(m - 2 * pi() * floor(m / (2 * pi())), 9) AS m_rad FROM a"""
)
def offset_walker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as one shell whose first plane and slot lie 10 and 5 degrees on."""
    suppliers = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sat_idx"))
    rows = suppliers.crossJoin(F.broadcast(suppliers.agg(F.count("*").alias("n"))))  # one row
    angles = constellation.walker_angles(F.col("sat_idx"), F.col("n"), F.lit(PLANES), F.lit(1), F.lit(10.0), F.lit(5.0))
    return rows.withColumns(angles).select("sat_idx", "plane_uid", "slot_id", F.round("raan_rad", 9).alias("raan_rad"), F.round("m_rad", 9).alias("m_rad"))


@_query(
    """WITH p AS (SELECT n_regionkey AS k, list(n_nationkey / 7.0::DOUBLE ORDER BY n_nationkey) AS ph FROM nation WHERE n_nationkey % 4 > 0 GROUP BY 1),
    q AS (SELECT k, ph, row_number() OVER (ORDER BY k) - 1 AS plane_uid, coalesce(sum(len(ph)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p),
    r AS (SELECT *, unnest(ph) AS m, generate_subscripts(ph, 1) - 1 AS slot FROM q)
    SELECT CAST(b + slot AS BIGINT) AS sat_idx, format('shell-{:03d}', CAST(b + slot AS BIGINT)) AS sat_id, plane_uid, slot AS slot_id, round(6378.137::DOUBLE + CASE WHEN k = 2 THEN 700 ELSE 600 END, 6) AS a_km, round(m, 9) AS m_rad FROM r"""
)
def explicit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "nation").where("n_nationkey % 4 > 0").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list(F.col("n_nationkey") / 7.0)).alias("phase_rad"))
    planes = rows.select(F.col("k").cast("double").alias("raan_rad"), "phase_rad", F.when(F.col("k") == 2, 700.0).alias("altitude_km"))
    return constellation.explicit_planes(planes, 600.0, 50.0).select("sat_idx", "sat_id", "plane_uid", "slot_id", F.round("a_km", 6).alias("a_km"), F.round("m_rad", 9).alias("m_rad"))


@_query(
    """SELECT CAST(n_nationkey AS BIGINT) AS sat_idx, format('shell-{:03d}', n_nationkey) AS sat_id, dense_rank() OVER (ORDER BY n_regionkey) - 1 AS plane_uid,
    row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS slot_id FROM nation"""
)
def phase_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("slot"), (F.col("n_regionkey") * 0.5).alias("raan_rad"), (F.col("n_nationkey") / 3.0).alias("m_rad"))
    return constellation.phase_slots(slots, 700.0, 45.0).select("sat_idx", "sat_id", "plane_uid", "slot_id")


@_query(
    f"""WITH {base._SATS.strip()} SELECT floor(650.0 / 10) * 10 + 0e0 AS altitude_bin_km, plane_uid, count(*) AS n, round(sum(degrees(m)), 4) AS m_sum FROM sat GROUP BY plane_uid"""
)
def lattice_by_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    sats = base.satellites(spark, sf_dir).withColumn("a_km", F.col("a_km") + 0.001)
    return constellation.lattice(sats).groupBy(F.col("altitude_bin_km").cast("double").alias("altitude_bin_km"), "plane_uid").agg(F.count("*").alias("n"), F.round(F.sum("m_deg"), 4).alias("m_sum"))


@_query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN b - a > 10 THEN b - 20 WHEN a - b > 10 THEN b + 20 ELSE b END AS plane_to, CASE WHEN d - c > 15 THEN d - 30 WHEN c - d > 15 THEN d + 30 ELSE d END AS slot_to
    FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 20 AS a, l_partkey % 20 AS b, l_suppkey % 30 AS c, l_partkey % 30 AS d FROM lineitem)"""
)
def seam_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("l_suppkey"), F.col("l_partkey")
    plane, slot = constellation.seam_wrap(k % 20, p % 20, k % 30, p % 30, 20, 30)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", plane.alias("plane_to"), slot.alias("slot_to"))


@_query(
    f"""WITH x AS (SELECT s_suppkey, ((s_suppkey % 628) / 100.0)::DOUBLE AS nu, ((s_suppkey % 9) / 10.0)::DOUBLE AS e FROM supplier),
    y AS (SELECT *, 2 * atan2(sqrt(1 - e) * sin(nu / 2), sqrt(1 + e) * cos(nu / 2)) AS ea FROM x), z AS (SELECT s_suppkey, ea - e * sin(ea) AS m FROM y)
    SELECT s_suppkey, round(cos(m), 9) AS cos_m, round(sin(m), 9) AS sin_m FROM z"""
)
def mean_from_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    m = orbit.mean_from_true((k % 628) / 100.0, (k % 9) / 10.0)
    return _t(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.cos(m), 9).alias("cos_m"), F.round(F.sin(m), 9).alias("sin_m"))


@_query(
    f"""WITH h AS (SELECT p_partkey, 400 + p_retailprice AS alt, 5 + p_size % 30 AS mask FROM part)
    SELECT p_partkey, round(90 - mask - degrees(asin({orbit.RE!r} / ({orbit.RE!r} + alt) * cos(radians(mask)))) + 0.6 + {orbit.RE!r} * sqrt({orbit.MU!r} / pow({orbit.RE!r} + alt, 3)) * 30 / 111.195::DOUBLE + 0.3, 9) AS radius_deg FROM h"""
)
def search_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search circle at an altitude of a part's price and a mask of its size."""
    radius = access.dilation_of(F.col("p_retailprice") + 400, (F.col("p_size") % 30 + 5).cast("double"), 0.6, 60.0)
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(radius, 9).alias("radius_deg"))


@_query("SELECT c_custkey, round((10 + 5 - (c_custkey % 7) * 0.5::DOUBLE) / 0.5, 1) AS crossing_s, CAST(11 AS BIGINT) AS n_halvings FROM customer")
def refined_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = -5 + (F.col("c_custkey") % 7) * 0.5
    found = orbit.refine(F.lit(0.0), F.lit(61.0), lambda t: start + 0.5 * t, F.lit(10.0), 61.0, 0.0005)
    steps = F.lit(orbit.bisection_steps(61.0, 0.03)).cast("long")
    return _t(spark, sf_dir, "customer").select("c_custkey", F.round(found, 1).alias("crossing_s"), steps.alias("n_halvings"))


_ECC = 0.1


def _eccentric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.satellites(spark, sf_dir).withColumn("ecc", F.lit(_ECC)).withColumn("a_km", F.lit(8000.0))


def _eccentric_sql() -> str:
    a, e = 8000.0, _ECC
    n = math.sqrt(orbit.MU / a**3)
    f = (orbit.RE / (a * (1 - e * e))) ** 2 * orbit.J2
    c, s = math.cos(math.radians(base.INCLINATION)), math.sin(math.radians(base.INCLINATION))
    dn, dp, dm = -1.5 * n * f * c, 0.75 * n * f * (5 * c * c - 1), n * (1 + 1.5 * f * math.sqrt(1 - e * e) * (1 - 1.5 * s * s))
    steps, previous = [], "k0"
    for i in range(1, 9):
        steps.append(f"k{i} AS (SELECT * REPLACE (ea - (ea - {e} * sin(ea) - m) / (1 - {e} * cos(ea)) AS ea) FROM {previous})")
        previous = f"k{i}"
    return f"""WITH {base._SATS.strip()},
    k0 AS (SELECT sat_idx, range AS t_idx, raan + ({dn!r}) * range * {STEP_S} AS o, ({dp!r}) * range * {STEP_S} AS w, m + ({dm!r}) * range * {STEP_S} AS m, m + ({dm!r}) * range * {STEP_S} AS ea FROM sat, range({N_TIME})),
    {", ".join(steps)},
    tr AS (SELECT *, 2 * atan2(sqrt({1 + e}) * sin(ea / 2), sqrt({1 - e}) * cos(ea / 2)) AS nu FROM {previous}),
    ec AS (SELECT sat_idx, t_idx, {a * (1 - e * e)!r} / (1 + {e} * cos(nu)) AS r, w + nu AS u FROM tr)
    SELECT sat_idx, t_idx, round(r, 4) AS radius_km, round(degrees(asin(sin(u) * {s!r})), 6) AS sub_lat_deg FROM ec"""


@_query(_eccentric_sql())
def eccentric_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = access.satellite_states(_eccentric(spark, sf_dir), grid.time_steps(spark, N_TIME, STEP_S))
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return states.select("sat_idx", "t_idx", F.round(r, 4).alias("radius_km"), F.round("sub_lat_deg", 6).alias("sub_lat_deg"))


# Continuity and summaries -----------------------------------------------------------


@_query(
    base._handover_sql("")
    + f""" SELECT cell_idx, feasible AS mbb_feasible, CAST(feasible AS INT) AS hex_value, CASE WHEN worst_overlap < 0 THEN -1.0 ELSE (worst_overlap - 1) * {STEP_S} END::DOUBLE AS mbb_overlap_worst_s,
    (worst_gap_steps * {STEP_S})::DOUBLE AS mbb_worst_gap_s FROM mbb"""
)
def continuity_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = base.cells(spark, sf_dir)
    rows = access.at_cells(continuity.continuity_map(access.places_of(every), base._access(spark, sf_dir, True), N_TIME, STEP_S), every)
    return rows.select("cell_idx", "mbb_feasible", F.col("mbb_feasible").cast("int").alias("hex_value"), "mbb_overlap_worst_s", "mbb_worst_gap_s")


@_query(
    base._handover_sql("", 2)
    + f""", cnt AS (SELECT cell_idx, t_idx, count(*) AS n FROM acc GROUP BY ALL), per AS (SELECT cell.cell_idx, count(n) / {N_TIME}.0 AS a, coalesce(sum(n), 0) / {N_TIME}.0 AS siv FROM cell LEFT JOIN cnt USING (cell_idx) GROUP BY 1)
    SELECT count(*) AS n_cells, round(avg(a), 9) AS mean_availability, min(a)::DOUBLE AS min_availability, max(a)::DOUBLE AS max_availability, round(avg(siv), 9) AS mean_sats_in_view, max(siv)::DOUBLE AS max_sats_in_view,
    round(avg(CAST(feasible AS INT)), 9) AS feasible_share FROM per JOIN mbb USING (cell_idx)"""
)
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = base.cells(spark, sf_dir)
    rows = coverage_plan.run_coverage(
        places, base.satellites(spark, sf_dir), N_TIME, STEP_S, [MASK + 5, MASK], coverage.k_values([2, 1, 1]), least_overlap=2
    )
    out = coverage.availability_summary(rows)
    return out.select("n_cells", *[F.round(c, 9).alias(c) for c in out.columns if c != "n_cells"])


# Sweeps --------------------------------------------------------------------------

INCLINATIONS, SIZES, TARGET, GRADE = (45.0, 60.0), (40, 80), base.TARGET, base.GRADE


def _candidate_sql(rows: list[tuple[int, int, float]], overlap: int | None) -> str:
    cand = "VALUES " + ", ".join(f"({n}, {p}, {i}::DOUBLE)" for n, p, i in rows)
    a = orbit.RE + base.ALTITUDE
    n0 = math.sqrt(orbit.MU / a**3)
    f = (orbit.RE / a) ** 2 * orbit.J2
    key = "n_sats, planes, inc"
    gate = f""",
isl AS (SELECT {key}, cell_idx, sat_idx, t_idx, t_idx - row_number() OVER (PARTITION BY {key}, cell_idx, sat_idx ORDER BY t_idx) AS k FROM acc),
iv AS (SELECT {key}, cell_idx, sat_idx, min(t_idx) AS s, max(t_idx) AS e FROM isl GROUP BY {key}, cell_idx, sat_idx, k),
ch AS (SELECT {key}, cell_idx, sat_idx, e, {N_TIME} AS w FROM iv WHERE s <= 0 UNION SELECT {", ".join("iv." + c for c in key.split(", "))}, iv.cell_idx, iv.sat_idx, iv.e, least(ch.w, ch.e - iv.s + 1)
  FROM ch JOIN iv USING ({key}, cell_idx) WHERE iv.e > ch.e AND ch.e - iv.s + 1 >= {overlap} AND iv.sat_idx <> ch.sat_idx),
ok AS (SELECT DISTINCT {key}, cell_idx, true AS feasible FROM ch WHERE e >= {N_TIME - 1})""" if overlap else ""
    join, pct = (f"LEFT JOIN ok USING ({key}, cell_idx)", "round(avg(CASE WHEN feasible THEN 1.0 ELSE 0.0 END), 6)") if overlap else ("", "NULL::DOUBLE")
    return f"""WITH RECURSIVE cand(n_sats, planes, inc) AS ({cand}), {base._CELLS.strip()},
smp AS (SELECT * FROM cell),
sat0 AS (SELECT {key}, range AS sat_idx, range // (n_sats // planes) AS p, range % (n_sats // planes) AS s FROM cand, range({max(r[0] for r in rows)}) WHERE range < n_sats),
sat1 AS (SELECT {key}, sat_idx, cos(radians(inc)) AS c, sin(radians(inc)) AS si, radians(p * 360.0 / planes) AS raan, radians(s * 360.0 / (n_sats // planes) + p * least(1, planes - 1) * 360.0 / n_sats) AS m FROM sat0),
step AS (SELECT range AS t_idx, range * {STEP_S} AS t_s, ((2461041.5 + range * {STEP_S} / 86400.0) - 2451545.0) / 36525.0 AS jc FROM range({N_TIME})),
ang AS (SELECT t_idx, t_s, 67310.54841 + (876600.0 * 3600 + 8640184.812866) * jc + 0.093104 * jc * jc - 6.2e-6 * jc * jc * jc AS sec FROM step),
tim AS (SELECT t_idx, t_s, radians((sec - 86400.0 * floor(sec / 86400.0)) / 240.0) AS g FROM ang),
mov AS (SELECT {key}, sat_idx, t_idx, g, c, si, raan + {-1.5 * n0 * f!r} * c * t_s AS o, m + ({0.75 * n0 * f!r} * (5 * c * c - 1) + {n0!r} * (1 + {1.5 * f!r} * (1 - 1.5 * si * si))) * t_s AS u FROM sat1, tim),
eci AS (SELECT {key}, sat_idx, t_idx, g, {a!r} * (cos(o) * cos(u) - sin(o) * sin(u) * c) AS xi, {a!r} * (sin(o) * cos(u) + cos(o) * sin(u) * c) AS yi, {a!r} * sin(u) * si AS z FROM mov),
st AS (SELECT {key}, sat_idx, 0 AS plane_uid, t_idx, cos(g) * xi + sin(g) * yi AS x, cos(g) * yi - sin(g) * xi AS y, z FROM eci),
{base._ground_sql("smp").strip()},{base._view_sql(key + ",")},
cnt AS (SELECT {key}, cell_idx, t_idx, count(*) AS n FROM acc GROUP BY ALL){gate},
per AS (SELECT {key}, smp.cell_idx, count(*) FILTER (n >= 1) / {N_TIME}.0 AS a1, count(*) FILTER (n >= 2) / {N_TIME}.0 AS a2, coalesce(sum(n), 0) / {N_TIME}.0 AS siv FROM (smp CROSS JOIN cand) smp LEFT JOIN cnt USING ({key}, cell_idx) GROUP BY ALL),
row_ AS (SELECT n_sats::BIGINT AS n_sats, planes::BIGINT AS planes, inc AS inclination_deg, CAST(n_sats // planes AS BIGINT) AS sats_per_plane, round(avg(siv), 6) AS mean_sats_in_view,
  round(avg(CASE WHEN a1 >= {TARGET} THEN 1.0 ELSE 0.0 END), 6) AS pct_k1, round(avg(a1), 6) AS mean_avail_k1, round(avg(CASE WHEN a2 >= {TARGET} THEN 1.0 ELSE 0.0 END), 6) AS pct_k2, round(avg(a2), 6) AS mean_avail_k2,
  {pct} AS pct_mbb, {pct} >= {GRADE} AS mbb_pass FROM per {join} GROUP BY {key})"""


_BY_INCLINATION = _candidate_sql([(n, PLANES, i) for n in SIZES for i in INCLINATIONS], 1)
_BY_SHAPE = _candidate_sql([(p * s, p, 53.0) for p in (5, 10) for s in (6, 10)], None)


def _inclination_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_plan.run_sweep(
        spark, base.cells(spark, sf_dir), sizes=SIZES, planes=(PLANES,), inclination_deg=INCLINATIONS, altitude_km=base.ALTITUDE, n_steps=N_TIME, step_s=STEP_S,
        target=TARGET, mask_deg=MASK, overlap_s=0.0, grade=GRADE,
    )[1]


def _shape_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_plan.run_sweep(
        spark, base.cells(spark, sf_dir), planes=(5, 10), per_plane=(6, 10), inclination_deg=(53.0,), altitude_km=base.ALTITUDE, n_steps=N_TIME, step_s=STEP_S,
        target=TARGET, mask_deg=MASK,
    )[1]


_ROUNDED = ("mean_sats_in_view", "pct_k1", "mean_avail_k1", "pct_k2", "mean_avail_k2", "pct_mbb")


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("n_sats", "planes", "inclination_deg", F.col("sats_per_plane").cast("long").alias("sats_per_plane"), *[F.round(c, 6).alias(c) for c in _ROUNDED], "mbb_pass")


@_query(f"{_BY_INCLINATION} SELECT * FROM row_")
def gated_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_inclination_rows(spark, sf_dir))


@_query(
    f"""{_BY_INCLINATION}, p AS (SELECT *, coalesce(pct_k1 >= {GRADE} AND pct_k2 >= {GRADE} AND mbb_pass, false) AS passed FROM row_)
    SELECT n_sats, planes, inclination_deg, passed, passed AND row_number() OVER (PARTITION BY passed ORDER BY n_sats, inclination_deg) = 1 AS is_winner FROM p"""
)
def gated_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least candidate that meets the grade and whose cells have handover chains."""
    rows = coverage_plan.passing(_rounded(_inclination_rows(spark, sf_dir)), GRADE, gate=True)
    return coverage_plan.winner(rows, "passed", "n_sats", "inclination_deg").select("n_sats", "planes", "inclination_deg", "passed", "is_winner")


@_query(
    f"""{_BY_INCLINATION} SELECT inclination_deg, min(n_sats) FILTER (pct_k1 >= {GRADE}) AS min_n_k1, min(n_sats) FILTER (pct_k2 >= {GRADE}) AS min_n_k2, min(n_sats) FILTER (mbb_pass) AS min_n_mbb
    FROM row_ GROUP BY inclination_deg"""
)
def inclination_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_plan.smallest_by(_inclination_rows(spark, sf_dir), GRADE)


@_query(
    f"""{_BY_INCLINATION}, b AS (SELECT inclination_deg, min(n_sats) FILTER (pct_k1 >= {GRADE}) AS n1, min(n_sats) FILTER (pct_k2 >= {GRADE}) AS n2 FROM row_ GROUP BY 1),
    l AS (SELECT 1::BIGINT AS k, inclination_deg AS i, n1 AS n FROM b UNION ALL SELECT 2, inclination_deg, n2 FROM b)
    SELECT k, min(n) AS min_n, arg_min(i, (n, i)) FILTER (n IS NOT NULL) AS inclination_deg FROM l GROUP BY k"""
)
def best_inclination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_plan.best_inclination(coverage_plan.smallest_by(_inclination_rows(spark, sf_dir), GRADE))


@_query(
    f"""{_BY_INCLINATION} SELECT n_sats, planes, inclination_deg, 1::BIGINT AS k, pct_k1 AS pct, mean_avail_k1 AS mean_avail, NOT mbb_pass AS gate_failed FROM row_
    UNION ALL SELECT n_sats, planes, inclination_deg, 2, pct_k2, mean_avail_k2, NOT mbb_pass FROM row_"""
)
def sweep_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_plan.long_rows(_inclination_rows(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("pct", "mean_avail")})


@_query(
    f"""{_BY_SHAPE}, p AS (SELECT *, pct_k1 >= {GRADE} AND pct_k2 >= 0.1 AS passed FROM row_)
    SELECT n_sats, planes, sats_per_plane, pct_k1, pct_k2, passed, passed AND row_number() OVER (PARTITION BY passed ORDER BY n_sats, planes) = 1 AS is_winner FROM p"""
)
def multi_shape_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rounded(_shape_rows(spark, sf_dir)).withColumn("passed", (F.col("pct_k1") >= GRADE) & (F.col("pct_k2") >= 0.1))
    return coverage_plan.winner(rows, "passed", "n_sats", "planes").select("n_sats", "planes", "sats_per_plane", "pct_k1", "pct_k2", "passed", "is_winner")


@_query(f"""{_BY_SHAPE} SELECT planes, max(pct_k1) FILTER (sats_per_plane = 6) AS "6", max(pct_k1) FILTER (sats_per_plane = 10) AS "10" FROM row_ GROUP BY planes""")
def shape_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_plan.shape_heatmap(_rounded(_shape_rows(spark, sf_dir)), [6, 10])


@_query(
    f"""{_BY_SHAPE}, p AS (SELECT *, pct_k1 >= {GRADE} AS passed FROM row_)
    SELECT n_sats AS "N", planes, sats_per_plane, printf('%.6f', pct_k1) AS pct_k1, printf('%.6f', pct_k2) AS pct_k2, NULL::VARCHAR AS pct_mbb, NULL::INT AS mbb_pass,
    CAST(passed AND row_number() OVER (PARTITION BY passed ORDER BY n_sats, planes) = 1 AS INT) AS is_pareto FROM p"""
)
def sweep_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coverage_plan.passing(_rounded(_shape_rows(spark, sf_dir)), GRADE, ks=(1,))
    return files.sweep_rows(coverage_plan.winner(rows, "passed", "n_sats", "planes"), "multi_shape")


@_query(
    f"""WITH w AS (SELECT c_nationkey, count(*) AS n_cells FROM customer GROUP BY 1), i AS (SELECT unnest({coverage_plan.inclinations(48.0, 48.4, 0.01)!r}::DOUBLE[]) AS inclination_deg)
    SELECT c_nationkey, inclination_deg, n_cells * 60 * (SELECT count(*) FROM supplier) AS work, round(n_cells * 60 * (SELECT count(*) FROM supplier) / 1e7 * 2, 9) AS eta_s FROM w, i"""
)
def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work of each nation's places at every inclination of a sweep with the gate."""
    n_sats = _t(spark, sf_dir, "supplier").agg(F.count("*").alias("n_sats"))  # one row
    rows = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n_cells")).crossJoin(F.broadcast(n_sats))
    work, eta = coverage_plan.workload(F.col("n_cells"), 60, F.col("n_sats"), True)
    each = F.explode(F.array(*[F.lit(x) for x in coverage_plan.inclinations(48.0, 48.4, 0.01)]))
    return rows.select("c_nationkey", each.alias("inclination_deg"), work.alias("work"), F.round(eta, 9).alias("eta_s"))


# Snapshots -----------------------------------------------------------------------


def store(spark: SparkSession, sf_dir: str) -> entities.EntityStore:
    """Suppliers as platforms (every seventh external, every fifth without elements),
    nations as antennas of the supplier of their number, orders as intents."""
    k = F.col("s_suppkey")
    schema = spark.createDataFrame([], entities.SCHEMA).schema
    kind = lambda name: schema[name].dataType.elementType
    kepler = F.struct(
        F.lit((orbit.RE + base.ALTITUDE) * 1000).alias("semimajor_axis_m"), F.lit(0.0).alias("eccentricity"), F.lit(base.INCLINATION).alias("inclination_deg"),
        F.pmod(k * 7.0, F.lit(360.0)).alias("raan_deg"), F.lit(0.0).alias("argument_of_periapsis_deg"), F.pmod(k * 29.0, F.lit(360.0)).alias("true_anomaly_deg"),
        F.struct((F.lit(1000) + k % 3 * 60).cast("long").alias("seconds")).alias("epoch"),
    )
    entry = F.struct(F.when(k % 5 > 0, kepler).alias("keplerian_elements"), F.lit(None).cast("struct<line1:string,line2:string>").alias("tle"))
    platform = F.struct(F.col("s_name").alias("name"), (k % 7 == 0).alias("is_external_system"), F.struct(F.array(entry).alias("entry")).alias("motion"))
    platforms = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("p-"), k).alias("id"), F.lit(11).alias("kind"), platform.alias("platform"), F.lit(None).alias("antenna"))
    antenna = F.struct(F.col("n_name").alias("type"), F.lit(True).alias("is_steerable"), F.lit(1.0).alias("max_transmit_power_w"), F.lit(2.0).alias("g_over_t_db_per_k"))
    nation = _t(spark, sf_dir, "nation")
    antennas = nation.select(F.concat(F.lit("a-"), "n_nationkey").alias("id"), F.lit(40).alias("kind"), F.lit(None).alias("platform"), antenna.alias("antenna"))
    to = lambda df, t: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in t.fields])
    holds = nation.select(F.when(F.col("n_nationkey") % 6 == 5, 3).otherwise(4).alias("kind"), F.concat(F.lit("p-"), F.col("n_nationkey") % 8).alias("a"), F.concat(F.lit("a-"), "n_nationkey").alias("z"))
    hop = F.struct(
        F.concat(F.lit("n-"), "o_custkey").alias("src_network_node_id"), F.concat(F.lit("n-"), F.col("o_custkey") % 10).alias("dst_network_node_id"),
        F.lit("i").alias("src_interface_id"), F.lit("j").alias("dst_interface_id"),
    )
    state = F.when(F.col("o_orderstatus") == "O", "INSTALLED").otherwise("WITHDRAWN")
    route = F.when(F.col("o_orderkey") % 3 > 0, F.struct(F.array(hop).alias("path_segments")))
    intents = _t(spark, sf_dir, "orders").select(F.concat(F.lit("i-"), "o_orderkey").alias("id"), state.alias("state"), route.alias("route"))
    return entities.EntityStore.of(to(platforms, kind("entities")).unionByName(to(antennas, kind("entities"))), to(holds, kind("relationships")), to(intents, kind("intents")))


@_query(
    """SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS n_entities, (SELECT count(*) FROM supplier) AS n_platforms, (SELECT count(*) FROM nation) AS n_antennas,
    (SELECT count(*) FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 7 > 0) AS n_served, (SELECT count(*) FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 7 = 0) AS n_external,
    (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 0) AS n_other, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS n_intents, true AS passed"""
)
def entity_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.inventory(store(spark, sf_dir))


@_query(
    """SELECT 'p-' || s_suppkey AS id, coalesce(string_agg('a-' || n_nationkey, ',' ORDER BY 'a-' || n_nationkey), '') AS antennas FROM supplier
    LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 6 <> 5) ON n_nationkey % 8 = s_suppkey GROUP BY s_suppkey"""
)
def platform_antennas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.antennas(store(spark, sf_dir)).select("id", F.array_join("antenna_ids", ",").alias("antennas"))


@_query("SELECT 'a-' || n_nationkey AS id, n_name AS type, true AS is_steerable FROM nation")
def antenna_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.antenna_facts(store(spark, sf_dir)).select("id", "type", "is_steerable")


@_query("SELECT 'i-' || o_orderkey AS id, 'n-' || o_custkey AS src, 'n-' || (o_custkey % 10) AS dst FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 > 0")
def route_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.hops(store(spark, sf_dir).list_intents(["INSTALLED"])).select("id", F.col("src_network_node_id").alias("src"), F.col("dst_network_node_id").alias("dst"))


_N0 = math.sqrt(orbit.MU / (orbit.RE + base.ALTITUDE) ** 3)
_PULLED = f"""WITH RECURSIVE pl AS (SELECT row_number() OVER (ORDER BY 'p-' || s_suppkey) - 1 AS sat_idx, 0 AS plane_uid, radians((s_suppkey * 7) % 360) AS raan,
  radians((s_suppkey * 29) % 360) - {_N0!r} * (s_suppkey % 3 * 60) AS m, 'p-' || s_suppkey AS sat_id FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 7 > 0)"""


@_query(f"{_PULLED} SELECT sat_id, round(cos(m), 9) AS cos_m, round(sin(m), 9) AS sin_m, round(raan, 9) AS raan_rad FROM pl")
def pulled_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities.elements(store(spark, sf_dir), 1000)
    return rows.select("sat_id", F.round(F.cos("m_rad"), 9).alias("cos_m"), F.round(F.sin("m_rad"), 9).alias("sin_m"), F.round("raan_rad", 9).alias("raan_rad"))


@_query(
    f"""{_PULLED},{base._states_sql(sats='pl')},{base._CELLS},{base._ground_sql()},{base._view_sql()}, cnt AS (SELECT cell_idx, t_idx, count(*) AS n FROM acc GROUP BY ALL)
    SELECT cell.cell_idx, CAST(coalesce(sum(n), 0) AS BIGINT) AS sat_sum, count(*) FILTER (n >= 1) AS steps_k1, count(*) FILTER (n >= 2) AS steps_k2 FROM cell LEFT JOIN cnt USING (cell_idx) GROUP BY 1"""
)
def pulled_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coverage_plan.pull_and_cover(store(spark, sf_dir), base.cells(spark, sf_dir), N_TIME, STEP_S, MASK, 1000)
    return rows.select("cell_idx", "sat_sum", "steps_k1", "steps_k2")


# Observed coverage ------------------------------------------------------------------


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as segments: a sample is seen where the component is positive."""
    v = F.col("vec_id")
    name = F.concat(F.lit("T:b#sat-"), v % 20, F.lit("-platform-a"), v % 3, F.lit("@"), v % 10 * 5, F.lit("/"), v % 8 * 9)
    return _t(spark, sf_dir, "embeddings").select(
        F.when(v % 31 == 30, F.lit("other")).otherwise(name).alias("id"), (v % 4 * 40).alias("interval_start_s"), F.lit(10.0).alias("sampling_resolution_s"),
        F.transform("embedding", lambda x: x > 0).alias("accessibilities"),
    )


_OBSERVED = """WITH s AS (SELECT vec_id % 20 AS sat, (vec_id % 10 * 5)::DOUBLE AS lat, (vec_id % 8 * 9)::DOUBLE AS lon, vec_id % 4 * 40 + 10 * (generate_subscripts(embedding, 1) - 1) AS t, unnest(embedding) > 0 AS seen
  FROM embeddings WHERE vec_id % 31 <> 30), g AS (SELECT count(DISTINCT t) AS n_time FROM s),
  p AS (SELECT lat, lon, t, count(DISTINCT sat) FILTER (seen) AS n FROM s GROUP BY ALL),
  o AS (SELECT lat AS lat_deg, lon AS lon_deg, n_time, sum(n) / n_time AS siv, count(*) FILTER (n >= 1) / n_time AS a1, count(*) FILTER (n >= 2) / n_time AS a2 FROM p, g GROUP BY lat, lon, n_time)"""


@_query(f"{_OBSERVED} SELECT lat_deg, lon_deg, n_time, round(siv, 9) AS sats_in_view_mean, round(a1, 9) AS availability_k1, round(a2, 9) AS availability_k2 FROM o")
def observed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = network.observed_coverage(segments(spark, sf_dir))
    return rows.select("lat_deg", "lon_deg", "n_time", *[F.round(c, 9).alias(c) for c in ("sats_in_view_mean", "availability_k1", "availability_k2")])


@_query(
    """WITH s AS (SELECT vec_id, len(embedding) AS n, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding) > 0 AS seen, CASE WHEN vec_id % 3 = 0 THEN 7 ELSE 4 END AS k FROM embeddings)
    SELECT vec_id, CAST(CASE WHEN n % k = 0 THEN p % (n // k) ELSE p END AS BIGINT) AS pos, bool_or(seen) AS seen FROM s GROUP BY 1, 2"""
)
def platform_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.array_repeat(F.lit("p"), F.when(F.col("vec_id") % 3 == 0, 7).otherwise(4)).alias("platforms"),
        F.transform("embedding", lambda x: x > 0).alias("accessibilities"),
    )
    return network.platform_series(rows).withColumnRenamed("id", "vec_id")


@_query(
    """WITH b AS (SELECT (user_id % 10)::DOUBLE AS lat_deg, (event_id % 7) AS b, count(*) AS n, avg(value) AS a FROM events GROUP BY 1, 2)
    SELECT lat_deg, CAST(sum(n) AS BIGINT) AS n_time, round(sum(a * n) / sum(n), 6) AS availability_k1 FROM b GROUP BY 1"""
)
def merged_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = _t(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).cast("double").alias("lat_deg"), F.lit(0.0).alias("lon_deg"), (F.col("event_id") % 7).alias("bucket")).agg(
        F.count("*").alias("n_time"), F.avg("value").alias("availability_k1")
    )
    buckets = buckets.withColumns({"availability_k2": F.lit(0.0), "sats_in_view_mean": F.lit(0.0)})
    return network.merge_buckets(buckets).select("lat_deg", "n_time", F.round("availability_k1", 6).alias("availability_k1"))


_TWO_BODY = base._states_sql().replace("2461041.5", repr(grid.julian_day(1_767_225_600.0 + 3600)))


def _engine_sql() -> str:
    a = orbit.RE + base.ALTITUDE
    n = math.sqrt(orbit.MU / a**3)
    start = _TWO_BODY.index("mov AS")
    end = _TWO_BODY.index("eci AS")
    moved = f"mov AS (SELECT sat_idx, plane_uid, t_idx, g, raan AS o, m + {n!r} * t_s AS u FROM sat, tim),\n"
    return f"""{_OBSERVED.replace('WITH s AS', f'WITH RECURSIVE {base._SATS.strip()}, s AS')}, pt AS (SELECT lat_deg AS lat, lon_deg AS lon, lat_deg * 1000 + lon_deg AS cell_idx FROM o),
    {(_TWO_BODY[:start] + moved + _TWO_BODY[end:]).strip()},{base._ground_sql("pt")},{base._view_sql()},
    cnt AS (SELECT cell_idx, t_idx, count(*) AS n FROM acc GROUP BY ALL), eng AS (SELECT lat, lon, count(n) / {N_TIME}.0 AS a FROM pt LEFT JOIN cnt USING (cell_idx) GROUP BY ALL),
    cmp AS (SELECT lat_deg, lon_deg, a AS engine, a1 AS observed, a - a1 AS delta FROM o JOIN eng ON lat = lat_deg AND lon = lon_deg)"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = network.observed_coverage(segments(spark, sf_dir))
    engine = coverage_plan.at_points(observed, base.satellites(spark, sf_dir), N_TIME, STEP_S, 1_767_225_600.0 + 3600, MASK)
    return coverage_plan.compare(engine, observed)


@_query(f"{_engine_sql()} SELECT lat_deg, lon_deg, round(engine, 9) AS engine, round(observed, 9) AS observed, round(delta, 9) AS delta FROM cmp")
def engine_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("lat_deg", "lon_deg", *[F.round(c, 9).alias(c) for c in ("engine", "observed", "delta")])


@_query(f"{_engine_sql()} SELECT count(*) AS n_points, round(avg(delta), 9) AS mean_delta, round(max(abs(delta)), 9) AS max_abs_delta, round(avg(CASE WHEN abs(delta) <= 0.2 THEN 1.0 ELSE 0.0 END), 9) AS share_close FROM cmp")
def engine_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage_plan.delta_summary(_compared(spark, sf_dir), 0.2)
    return out.select("n_points", *[F.round(c, 9).alias(c) for c in out.columns if c != "n_points"])


# Model logs ------------------------------------------------------------------------


@_query(
    """WITH h AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CASE WHEN l_suppkey % 4 > 0 THEN 'c' || (l_suppkey % 3) ELSE 'PoP' END AS a, CASE WHEN l_partkey % 5 > 0 THEN 'd' || (l_partkey % 2) ELSE 'PoP' END AS b FROM lineitem)
    SELECT a AS src_category, b AS dst_category, count(*) AS n FROM h GROUP BY 1, 2"""
)
def hop_type_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    sides = _t(spark, sf_dir, "supplier").where(k % 4 > 0).select(F.concat(F.lit("s"), k).alias("id"), F.concat(F.lit("c"), k % 3).alias("category"))
    parts = _t(spark, sf_dir, "part").where(p % 5 > 0).select(F.concat(F.lit("p"), p).alias("id"), F.concat(F.lit("d"), p % 2).alias("category"))
    return network.hop_types(hops, sides.unionByName(parts))


@_query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, user_id LIMIT 30")
def busiest_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.busiest(_t(spark, sf_dir, "events"), "user_id")


@_query("SELECT event_id FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2)")
def first_bucket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.first_buckets(_t(spark, sf_dir, "events"), "event_type", 2).select("event_id")


@_query(
    """WITH e AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), r AS (SELECT min(t) AS a, max(t) AS b FROM e)
    SELECT event_type, CAST(least(floor((t - a) / greatest((b - a) / 60.0::DOUBLE, 1e-9)), 59) AS BIGINT) AS bin, count(*) AS n, round(min((t - a) / 3600.0::DOUBLE), 6) AS first_hour FROM e, r GROUP BY 1, 2"""
)
def wave_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("event_type", F.unix_timestamp("ts").alias("t"))
    return network.waves(rows, "t", "event_type").withColumn("first_hour", F.round("first_hour", 6))


_NAMED = """WITH n AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'satellite-' || s_suppkey || '-platform' WHEN 1 THEN 'user-terminal-' || s_suppkey || '-network-node' WHEN 2 THEN 'gateway-' || s_suppkey || '-to-satellite-9'
  WHEN 3 THEN 'satellite-' || s_suppkey || '-1200.' || (s_suppkey % 20) || '.' || (s_suppkey % 30) ELSE 'oisl-north-' || s_suppkey END AS id FROM supplier)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = (
        F.when(k % 5 == 0, F.concat(F.lit("satellite-"), k, F.lit("-platform"))).when(k % 5 == 1, F.concat(F.lit("user-terminal-"), k, F.lit("-network-node")))
        .when(k % 5 == 2, F.concat(F.lit("gateway-"), k, F.lit("-to-satellite-9"))).when(k % 5 == 3, F.concat(F.lit("satellite-"), k, F.lit("-1200."), k % 20, F.lit("."), k % 30))
        .otherwise(F.concat(F.lit("oisl-north-"), k))
    )
    return _t(spark, sf_dir, "supplier").select("s_suppkey", name.alias("id"))


@_query(
    f"""{_NAMED} SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'sat' WHEN 1 THEN 'ut' WHEN 3 THEN 'sat' ELSE 'drop' END AS family, CASE s_suppkey % 5 WHEN 4 THEN 'oisl-north' WHEN 1 THEN 'user' WHEN 2 THEN 'feeder' ELSE 'other' END AS kind,
    replace(replace(replace(replace(replace(id, '-platform', ''), 'satellite-', 'sat-'), 'gateway-', 'gw-'), 'user-terminal-', 'ut-'), '-network-node', '') AS short,
    CASE WHEN s_suppkey % 5 = 3 THEN s_suppkey % 20 END AS plane, CASE WHEN s_suppkey % 5 = 3 THEN s_suppkey % 30 END AS slot FROM n"""
)
def id_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane, slot = network.plane_and_slot(F.col("id"))
    return _named(spark, sf_dir).select(
        "s_suppkey", network.family(F.col("id")).alias("family"), network.link_kind(F.col("id")).alias("kind"), network.short_name(F.col("id")).alias("short"), plane.alias("plane"), slot.alias("slot")
    )


@_query("SELECT page_id FROM pages WHERE starts_with(url, 'https://')")
def prefix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.by_prefix(_t(spark, sf_dir, "pages"), "https://", "url").select("page_id")


@_query(
    """WITH c AS (SELECT event_type, ts, ts + to_seconds(CAST(event_id % 500 AS BIGINT)) AS commit_ts FROM events)
    SELECT CAST(floor(epoch(ts) / 43200) * 43200 AS BIGINT) AS start_s, count(*) AS n, round(max(epoch(commit_ts) - epoch(ts)), 3) AS max_lag_s FROM c
    WHERE commit_ts >= (TIMESTAMP '2024-01-05 00:00:00') AND commit_ts < (TIMESTAMP '2024-01-15 00:00:00') GROUP BY 1"""
)
def committed_and_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").withColumn("commit_ts", F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 500))
    found = rates.described_and_committed(network.committed(rows, "2024-01-05", "2024-01-15"), "ts", "commit_ts", "12 hours")
    return found.select(F.unix_timestamp("start").alias("start_s"), "n", F.round("max_lag_s", 3).alias("max_lag_s"))


@_query(
    """WITH e AS (SELECT event_type, event_id, ts <= TIMESTAMP '2024-01-10 00:00:00' AS d, ts > TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 86400 SECOND AS t FROM events)
    SELECT event_type, count(*) FILTER (d) AS n_dump, count(*) FILTER (t) AS n_tail, round(count(*) FILTER (t) / 86400.0::DOUBLE, 9) AS rate_per_s,
    coalesce(array_to_string((list(event_id ORDER BY event_id) FILTER (t))[1:3], ','), '') AS samples FROM e GROUP BY 1"""
)
def snapshot_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rates.snapshot_then_tail(_t(spark, sf_dir, "events").withColumnRenamed("event_id", "id"), "2024-01-10", "ts", "event_type", 86400)
    samples = F.coalesce(F.array_join(F.col("sample_ids").cast("array<string>"), ","), F.lit(""))
    return rows.select("event_type", "n_dump", "n_tail", F.round("rate_per_s", 9).alias("rate_per_s"), samples.alias("samples"))


@_query(
    """SELECT count(*) AS n_required, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS n_there, CASE WHEN bool_and(c_custkey IN (SELECT o_custkey FROM orders)) THEN 'complete' ELSE 'partial' END AS state,
    CAST(sum(c_custkey) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS BIGINT) AS missing_sum FROM customer"""
)
def load_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    have, want = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return network.load_state(have, want).crossJoin(network.load_missing(have, want).agg(F.sum("id").alias("missing_sum")))


@_query(
    """WITH s AS (SELECT s_suppkey AS i, s_suppkey // 10 AS p, s_suppkey % 10 AS sl FROM supplier)
    SELECT 'satellite-' || (i + 1) || '-platform' AS id, 'id: "satellite-' || (i + 1) || '-platform" grid: 1200.' || (p + 1) || '.' || (sl + 1) || ' not 1200.1.15' AS body, 'SAT-' || (i + 1) || ' (' || (p + 1) || '.' || (sl + 1) || ')' AS name FROM s
    UNION ALL SELECT 'satellite-' || (i + 1) || '-antenna', 'b ' || 'satellite-' || (i + 1) || '-antenna', NULL FROM s"""
)
def generated_satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = spark.createDataFrame(
        [('id: "satellite-1-platform" grid: 1200.1.1 not 1200.1.15', "satellite-1-platform"), ("b satellite-1-antenna", "satellite-1-antenna"), ("x", "oisl-1")], "body string, id string"
    )
    k = F.col("s_suppkey")
    sats = _t(spark, sf_dir, "supplier").select(
        k.alias("sat_idx"), F.floor(k / 10).alias("plane_uid"), F.lit(7000.0).alias("a_km"), F.lit(0.0).alias("ecc"), F.lit(0.9).alias("inc_rad"), F.lit(0.1).alias("raan_rad"), F.lit(0.0).alias("argp_rad"), F.lit(0.5).alias("m_rad")
    )
    return model_plan.satellite_model(template, sats).select("id", "body", "name")


@_query(
    f"""WITH d AS (SELECT 'gw' AS headend, 'user-terminal-' || n_nationkey || '-route-fn' AS endpoint FROM nation UNION ALL SELECT 'user-terminal-' || n_nationkey || '-route-fn', 'gw' FROM nation),
    h AS (SELECT *, sha1(unhex('{model_plan.URL_SPACE}') || encode(headend || '--1--' || endpoint)) AS s FROM d)
    SELECT headend, endpoint, 'p2pSrTePolicies/' || s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || substr('89ab', 1 + CAST('0x' || s[17:17] AS INT) % 4, 1) || s[18:20] || '-' || s[21:32] AS id FROM h"""
)
def demand_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    terminals = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.lit(0.0).alias("lat_deg"), F.lit(0.0).alias("lon_deg"))
    return model_plan.demands(terminals, "gw").select("headend", "endpoint", "id")
