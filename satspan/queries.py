"""The registered queries of the satellite-coverage operators.

They run over the driver's tables: suppliers stand for satellites of one Walker
shell, customers for ground cells, events and orders for links and requests.
Each query has a DuckDB twin in :data:`SQL`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from satspan.functions import orbit
from satspan.operators import continuity, coverage, network, terrain
from satspan.operators.access import at_cells, azimuth_deg, in_view, pairs_at_cells, places_of, satellite_states
from satspan.plans import coverage_plan
from satspan.sources import constellation
from satspan.sources.grid import in_polygon, time_steps

N_TIME, STEP_S, MASK, ALTITUDE, INCLINATION, PLANES = 10, 60.0, 10.0, 650.0, 53.0, 10
#: Steps of the flagship query: an hour, as usual runs of the method take.
COVERAGE_STEPS = 60
#: A five-cornered area for the containment query: longitude, latitude.
AREA = [(-60.0, -40.0), (80.0, -50.0), (120.0, 10.0), (20.0, 45.0), (-90.0, 20.0)]
SWEEP, TARGET, GRADE = (40, 80, 120), 0.5, 0.4


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sat_idx"))
    total = suppliers.agg(F.count("*").alias("_n"))  # one row
    rows = suppliers.crossJoin(F.broadcast(total))
    return rows.withColumns({
        **constellation.walker_angles(F.col("sat_idx"), F.col("_n"), F.lit(PLANES), F.lit(1)),
        "a_km": F.lit(orbit.RE + ALTITUDE), "ecc": F.lit(0.0), "inc_rad": F.lit(math.radians(INCLINATION)), "argp_rad": F.lit(0.0),
    }).drop("_n")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lat = F.when(k % 50 == 49, 89.0).otherwise(-60 + (k * 7 % 1200) / 10.0)  # some see no satellite
    return _t(spark, sf_dir, "customer").select(k.alias("cell_idx"), lat.alias("lat_deg"), (-180 + (k * 13 % 3600) / 10.0).alias("lon_deg"))


def _access(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The pairs in view by place of the cells."""
    states = satellite_states(satellites(spark, sf_dir), time_steps(spark, N_TIME, STEP_S))
    return in_view(places_of(cells(spark, sf_dir)), states, MASK, dealt=dealt)


_SATS = f"""
n AS (SELECT count(*) AS t FROM supplier),
sat0 AS (SELECT s_suppkey AS sat_idx, s_suppkey // (t // {PLANES}) AS plane_uid, s_suppkey % (t // {PLANES}) AS slot_id, t FROM supplier, n),
sat1 AS (SELECT *, radians(plane_uid * 360.0 / {PLANES}) AS r0, radians(slot_id * 360.0 / (t // {PLANES}) + plane_uid * 360.0 / t) AS m0 FROM sat0),
sat AS (SELECT sat_idx, plane_uid, slot_id, r0 - 2 * pi() * floor(r0 / (2 * pi())) AS raan, m0 - 2 * pi() * floor(m0 / (2 * pi())) AS m FROM sat1)"""


def _states_sql(inc: float = INCLINATION, sats: str = "sat", extra: str = "", n_time: int = N_TIME) -> str:
    a = orbit.RE + ALTITUDE
    n = math.sqrt(orbit.MU / a**3)
    f = (orbit.RE / a) ** 2 * orbit.J2
    c, s = math.cos(math.radians(inc)), math.sin(math.radians(inc))
    dn, dp, dm = -1.5 * n * f * c, 0.75 * n * f * (5 * c * c - 1), n * (1 + 1.5 * f * (1 - 1.5 * s * s))
    return f"""
step AS (SELECT range AS t_idx, range * {STEP_S} AS t_s, ((2461041.5 + range * {STEP_S} / 86400.0) - 2451545.0) / 36525.0 AS jc FROM range({n_time})),
ang AS (SELECT t_idx, t_s, 67310.54841 + (876600.0 * 3600 + 8640184.812866) * jc + 0.093104 * jc * jc - 6.2e-6 * jc * jc * jc AS sec FROM step),
tim AS (SELECT t_idx, t_s, radians((sec - 86400.0 * floor(sec / 86400.0)) / 240.0) AS g FROM ang),
mov AS (SELECT {extra} sat_idx, plane_uid, t_idx, g, raan + ({dn!r}) * t_s AS o, ({dp!r}) * t_s + m + ({dm!r}) * t_s AS u FROM {sats}, tim),
eci AS (SELECT {extra} sat_idx, plane_uid, t_idx, g, {a!r} * (cos(o) * cos(u) - sin(o) * sin(u) * {c!r}) AS xi, {a!r} * (sin(o) * cos(u) + cos(o) * sin(u) * {c!r}) AS yi,
  {a!r} * sin(u) * {s!r} AS z FROM mov),
st AS (SELECT {extra} sat_idx, plane_uid, t_idx, cos(g) * xi + sin(g) * yi AS x, cos(g) * yi - sin(g) * xi AS y, z FROM eci)"""


_CELLS = """
cell AS (SELECT c_custkey AS cell_idx, CASE WHEN c_custkey % 50 = 49 THEN 89.0 ELSE -60 + (c_custkey * 7 % 1200) / 10.0 END::DOUBLE AS lat, -180 + (c_custkey * 13 % 3600) / 10.0 AS lon FROM customer)"""


def _ground_sql(cell: str = "cell") -> str:
    return f"""
gnd0 AS (SELECT *, {orbit.RE!r} / sqrt(1 - {orbit.E2!r} * sin(radians(lat)) * sin(radians(lat))) AS nn FROM {cell}),
gnd AS (SELECT *, nn * cos(radians(lat)) * cos(radians(lon)) AS cx, nn * cos(radians(lat)) * sin(radians(lon)) AS cy, nn * (1 - {orbit.E2!r}) * sin(radians(lat)) AS cz,
  cos(radians(lat)) * cos(radians(lon)) AS ux, cos(radians(lat)) * sin(radians(lon)) AS uy, sin(radians(lat)) AS uz FROM gnd0)"""


def _view_sql(extra: str = "") -> str:
    return f"""
pair AS (SELECT {extra} cell_idx, lat, lon, sat_idx, plane_uid, t_idx, x - cx AS dx, y - cy AS dy, z - cz AS dz, (x - cx) * ux + (y - cy) * uy + (z - cz) * uz AS dot,
  sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS rng FROM gnd, st),
acc AS (SELECT *, degrees(asin(least(1.0, greatest(-1.0, dot / rng)))) AS elev FROM pair WHERE dot >= {math.sin(math.radians(MASK))!r} * rng)"""


def _access_sql(n_time: int = N_TIME) -> str:
    return f"WITH RECURSIVE {_SATS},{_states_sql(n_time=n_time)},{_CELLS},{_ground_sql()},{_view_sql()}"


def _coverage_sql(n_time: int = N_TIME) -> str:
    return f"""{_access_sql(n_time)},
cnt AS (SELECT cell_idx, t_idx, count(*) AS n FROM acc GROUP BY ALL),
cov AS (SELECT cell.cell_idx, lat, lon, CAST(coalesce(sum(n), 0) AS BIGINT) AS sat_sum, count(*) FILTER (n >= 1) AS steps_k1, count(*) FILTER (n >= 2) AS steps_k2
  FROM cell LEFT JOIN cnt USING (cell_idx) GROUP BY ALL)"""


_ACCESS, _COVERAGE = _access_sql(), _coverage_sql()
_INTERVALS = f"""{_ACCESS},
isl AS (SELECT cell_idx, sat_idx, plane_uid, t_idx, t_idx - row_number() OVER (PARTITION BY cell_idx, sat_idx ORDER BY t_idx) AS k FROM acc),
iv AS (SELECT cell_idx, sat_idx, plane_uid, min(t_idx) AS s, max(t_idx) AS e FROM isl GROUP BY cell_idx, sat_idx, plane_uid, k)"""

QUERIES = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


@_query(f"{_SATS.replace('n AS', 'WITH n AS', 1)} SELECT sat_idx, plane_uid, slot_id, round(raan, 9) AS raan_rad, round(m, 9) AS m_rad FROM sat")
def walker_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return satellites(spark, sf_dir).select(
        "sat_idx", "plane_uid", "slot_id", F.round("raan_rad", 9).alias("raan_rad"), F.round("m_rad", 9).alias("m_rad")
    )


@_query(
    f"{_coverage_sql(COVERAGE_STEPS)} SELECT cell_idx, sat_sum, steps_k1, steps_k2, round(steps_k1 / {COVERAGE_STEPS}.0, 9) AS availability_k1,"
    f" round(steps_k2 / {COVERAGE_STEPS}.0, 9) AS availability_k2 FROM cov"
)
def coverage_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage_plan.run_coverage(cells(spark, sf_dir), satellites(spark, sf_dir), COVERAGE_STEPS, STEP_S, MASK)
    return out.select(
        "cell_idx", "sat_sum", "steps_k1", "steps_k2",
        F.round("availability_k1", 9).alias("availability_k1"), F.round("availability_k2", 9).alias("availability_k2"),
    )


@_query(f"{_ACCESS} SELECT cell_idx, round(max(elev), 6) AS max_elev_deg FROM acc GROUP BY cell_idx")
def max_elevation_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _access(spark, sf_dir).groupBy("cell_idx").agg(F.round(F.max("elev_deg"), 6).alias("max_elev_deg"))
    return at_cells(found, cells(spark, sf_dir))


@_query(
    f"{_ACCESS} SELECT cell_idx, t_idx, sat_idx, round(elev, 6) AS elev_deg FROM acc"
    " QUALIFY row_number() OVER (PARTITION BY cell_idx, t_idx ORDER BY round(elev, 6) DESC, sat_idx) = 1"
)
def best_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    elev = F.round("elev_deg", 6)
    best = F.max(F.struct(elev.alias("elev_deg"), (-F.col("sat_idx")).alias("s")))
    found = _access(spark, sf_dir).groupBy("cell_idx", "t_idx").agg(best.alias("b")).select(
        "cell_idx", "t_idx", (-F.col("b.s")).alias("sat_idx"), "b.elev_deg"
    )
    return at_cells(found, cells(spark, sf_dir))


@_query(
    f"{_ACCESS} SELECT sat_idx, t_idx, round(degrees(asin(z / sqrt(x * x + y * y + z * z))), 6) AS sub_lat_deg, round(degrees(atan2(y, x)), 6) AS sub_lon_deg FROM st"
)
def subpoint_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = satellite_states(satellites(spark, sf_dir), time_steps(spark, N_TIME, STEP_S))
    return states.select(
        "sat_idx", "t_idx", F.round("sub_lat_deg", 6).alias("sub_lat_deg"), F.round("sub_lon_deg", 6).alias("sub_lon_deg")
    )


@_query(
    f"""{_ACCESS} SELECT cell_idx, count(*) AS n, round(avg(az), 5) AS mean_az_deg FROM (SELECT cell_idx, CASE WHEN a < 0 THEN a + 360 ELSE a END AS az FROM (
    SELECT cell_idx, degrees(atan2(-sin(radians(lon)) * dx + cos(radians(lon)) * dy,
    -sin(radians(lat)) * cos(radians(lon)) * dx - sin(radians(lat)) * sin(radians(lon)) * dy + cos(radians(lat)) * dz)) AS a FROM acc)) GROUP BY cell_idx"""
)
def mean_azimuth(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _access(spark, sf_dir).withColumn("az", azimuth_deg()).groupBy("cell_idx").agg(
        F.count("*").alias("n"), F.round(F.avg("az"), 5).alias("mean_az_deg")
    )
    return at_cells(found, cells(spark, sf_dir))


@_query(f"{_INTERVALS} SELECT cell_idx, sat_idx, s AS start_idx, e AS end_idx FROM iv")
def access_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = continuity.intervals(_access(spark, sf_dir, True), ["cell_idx", "n_cells", "sat_idx"])
    return pairs_at_cells(found, cells(spark, sf_dir))


@_query(
    f"""{_ACCESS}, pts AS (SELECT cell_idx, t_idx FROM acc UNION SELECT cell_idx, -1 FROM cell UNION SELECT cell_idx, {N_TIME} FROM cell)
    SELECT cell_idx, CAST(max(g) AS BIGINT) AS worst_gap_steps FROM (SELECT cell_idx, lead(t_idx) OVER (PARTITION BY cell_idx ORDER BY t_idx) - t_idx - 1 AS g FROM pts) GROUP BY cell_idx"""
)
def worst_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = cells(spark, sf_dir)
    return at_cells(continuity.worst_gap(places_of(every), _access(spark, sf_dir), N_TIME), every)


def _handover_sql(rule: str, least: int = 1) -> str:
    return f"""{_INTERVALS}, ch AS (SELECT cell_idx, sat_idx, plane_uid, e, {N_TIME} AS w FROM iv WHERE s <= 0
    UNION SELECT iv.cell_idx, iv.sat_idx, iv.plane_uid, iv.e, least(ch.w, ch.e - iv.s + 1) FROM ch JOIN iv USING (cell_idx)
      WHERE iv.e > ch.e AND ch.e - iv.s + 1 >= {least} AND iv.sat_idx <> ch.sat_idx {rule}),
    best AS (SELECT cell_idx, max(w) FILTER (e >= {N_TIME - 1}) AS w FROM ch GROUP BY cell_idx),
    pts AS (SELECT cell_idx, t_idx FROM acc UNION SELECT cell_idx, -1 FROM cell UNION SELECT cell_idx, {N_TIME} FROM cell),
    gap AS (SELECT cell_idx, max(g) AS g FROM (SELECT cell_idx, lead(t_idx) OVER (PARTITION BY cell_idx ORDER BY t_idx) - t_idx - 1 AS g FROM pts) GROUP BY cell_idx),
    mbb AS (SELECT cell_idx, coalesce(w > 0, false) AS feasible, CAST(CASE WHEN w < {N_TIME} THEN w ELSE -1 END AS BIGINT) AS worst_overlap,
      CAST(CASE WHEN w > 0 THEN 0 ELSE g END AS BIGINT) AS worst_gap_steps FROM cell LEFT JOIN best USING (cell_idx) JOIN gap USING (cell_idx))"""


def _handover(spark: SparkSession, sf_dir: str, different_plane: bool) -> DataFrame:
    every = cells(spark, sf_dir)
    runs = continuity.runs_in_view(_access(spark, sf_dir, True), ["cell_idx"], N_TIME, different_plane)
    found = continuity.chains_of(runs, N_TIME, 1, different_plane, cells=places_of(every))
    return at_cells(found, every).select("cell_idx", "feasible", "worst_overlap", "worst_gap_steps")


@_query(_handover_sql("") + " SELECT * FROM mbb")
def mbb_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _handover(spark, sf_dir, False)


@_query(_handover_sql("AND iv.plane_uid <> ch.plane_uid") + " SELECT * FROM mbb")
def mbb_different_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _handover(spark, sf_dir, True)


_CAND = f"""
size AS (SELECT CAST(unnest({list(SWEEP)}) AS BIGINT) AS n_sats),
cand0 AS (SELECT n_sats, range AS sat_idx, range // (n_sats // {PLANES}) AS plane_uid, range % (n_sats // {PLANES}) AS slot_id FROM size, range({max(SWEEP)}) WHERE range < n_sats),
cand AS (SELECT n_sats, sat_idx, plane_uid, radians(plane_uid * 360.0 / {PLANES}) AS raan, radians(slot_id * 360.0 / (n_sats // {PLANES}) + plane_uid * 360.0 / n_sats) AS m FROM cand0)"""
_SWEEP_SQL = f"""WITH {_CAND},{_states_sql(sats='cand', extra='n_sats,')},{_CELLS},{_ground_sql()},{_view_sql('n_sats,')},
cnt AS (SELECT n_sats, cell_idx, t_idx, count(*) AS n FROM acc GROUP BY ALL),
per AS (SELECT n_sats, cell.cell_idx, count(*) FILTER (n >= 1) / {N_TIME}.0 AS a1, count(*) FILTER (n >= 2) / {N_TIME}.0 AS a2, coalesce(sum(n), 0) / {N_TIME}.0 AS siv
  FROM (cell CROSS JOIN size) cell LEFT JOIN cnt USING (n_sats, cell_idx) GROUP BY ALL),
row_ AS (SELECT n_sats, round(avg(siv), 6) AS mean_sats_in_view, round(avg(CASE WHEN a1 >= {TARGET} THEN 1.0 ELSE 0.0 END), 6) AS pct_k1, round(avg(a1), 6) AS mean_avail_k1,
  round(avg(CASE WHEN a2 >= {TARGET} THEN 1.0 ELSE 0.0 END), 6) AS pct_k2, round(avg(a2), 6) AS mean_avail_k2 FROM per GROUP BY n_sats)"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    sats = coverage_plan.candidates(spark, list(SWEEP), PLANES, ALTITUDE, INCLINATION)
    rows = coverage_plan.sweep(cells(spark, sf_dir), sats, N_TIME, STEP_S, TARGET, MASK)
    return rows.select("n_sats", *[F.round(c, 6).alias(c) for c in rows.columns if c != "n_sats"])


@_query(f"{_SWEEP_SQL} SELECT * FROM row_")
def constellation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir)


@_query(f"{_SWEEP_SQL} SELECT min(n_sats) FILTER (pct_k1 >= {GRADE}) AS min_n_k1, min(n_sats) FILTER (pct_k2 >= {GRADE}) AS min_n_k2 FROM row_")
def min_n_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_plan.smallest(_sweep(spark, sf_dir), GRADE)


@_query(
    f"{_SWEEP_SQL} SELECT n_sats, pct_k1 >= {GRADE} AS passed, pct_k1 >= {GRADE} AND row_number() OVER (PARTITION BY pct_k1 >= {GRADE} ORDER BY n_sats) = 1 AS is_winner FROM row_"
)
def lexicographic_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sweep(spark, sf_dir).select("n_sats", (F.col("pct_k1") >= GRADE).alias("passed"))
    return coverage_plan.winner(rows, "passed", "n_sats")


@_query(f"{_COVERAGE} SELECT floor(lat / 2.0) * 2.0 AS lat_bin, count(*) AS n_cells, round(avg(sat_sum / {N_TIME}.0), 9) AS sats_in_view_mean FROM cov GROUP BY 1")
def latitude_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage_plan.run_coverage(cells(spark, sf_dir), satellites(spark, sf_dir), N_TIME, STEP_S, MASK)
    return out.groupBy(coverage.latitude_bin(F.col("lat_deg")).alias("lat_bin")).agg(
        F.count("*").alias("n_cells"), F.round(F.avg("sats_in_view_mean"), 9).alias("sats_in_view_mean")
    )


@_query(f"{_COVERAGE} SELECT CAST(least(floor(steps_k1 / {N_TIME}.0 * 20), 19) AS BIGINT) AS bin, count(*) AS n_cells FROM cov GROUP BY 1")
def availability_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage_plan.run_coverage(cells(spark, sf_dir), satellites(spark, sf_dir), N_TIME, STEP_S, MASK)
    return out.groupBy(coverage.unit_bin(F.col("availability_k1")).alias("bin")).agg(F.count("*").alias("n_cells"))


def _area_sql() -> str:
    ring = [f"SELECT {i} AS i, {a[0]} AS x1, {a[1]} AS y1, {b[0]} AS x2, {b[1]} AS y2" for i, (a, b) in enumerate(zip(AREA, AREA[1:] + AREA[:1]))]
    return " UNION ALL ".join(ring)


@_query(
    f"WITH {_CELLS}, edge AS ({_area_sql()}) SELECT cell_idx, (count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)) % 2 = 1 AS inside"
    " FROM cell, edge GROUP BY cell_idx"
)
def cells_in_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in AREA])
    return cells(spark, sf_dir).select("cell_idx", in_polygon(F.col("lat_deg"), F.col("lon_deg"), ring).alias("inside"))


_DEM = "dem AS (SELECT 28.0 + 0.1 * (range // 11) AS plat, 79.5 + 0.1 * (range % 11) AS plon, 900.0 + 40.0 * (range % 11) + 5000.0 * exp(-pow((28.0 + 0.1 * (range // 11) - 28.5) / 0.2, 2)) AS hm FROM range(121))"
_HCELL = "hcell AS (SELECT n_nationkey AS cell_idx, 28.031 + n_nationkey * 0.037 AS lat, 79.61 + n_nationkey * 0.031 AS lon FROM nation)"
_HORIZON_SQL = f"""WITH {_DEM}, {_HCELL},
ax AS (SELECT cell_idx, coalesce((SELECT min(plat) FROM dem WHERE plat >= lat), (SELECT max(plat) FROM dem)) AS ra,
  coalesce((SELECT min(plon) FROM dem WHERE plon >= lon), (SELECT max(plon) FROM dem)) AS ro FROM hcell),
base AS (SELECT cell_idx, hm AS h_own FROM ax JOIN dem ON plat = ra AND plon = ro),
h0 AS (SELECT cell_idx, hm - h_own AS hm, radians(lat) AS la, radians(plat) AS lb, radians(plon - lon) AS dl FROM hcell JOIN base USING (cell_idx), dem),
h1 AS (SELECT *, 2 * {terrain.EARTH_M!r} * asin(sqrt(least(1.0, pow(sin((lb - la) / 2), 2) + cos(la) * cos(lb) * pow(sin(dl / 2), 2)))) AS d,
  degrees(atan2(sin(dl) * cos(lb), cos(la) * sin(lb) - sin(la) * cos(lb) * cos(dl))) AS az0 FROM h0),
h2 AS (SELECT cell_idx, d, CASE WHEN az0 < 0 THEN az0 + 360 ELSE az0 END AS az, degrees(atan2(hm - d * d / (2 * {terrain.EARTH_M!r}), d)) AS ang FROM h1 WHERE d > 1 AND d <= 60000),
hz AS (SELECT cell_idx, CAST(least(floor(az * 8 / 360), 7) AS BIGINT) AS az_bin, max(ang) AS mask FROM h2 WHERE ang > 0 GROUP BY 1, 2)"""


def _horizon(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("id")
    grid = spark.range(121).select((28.0 + 0.1 * F.floor(i / 11)).alias("lat_deg"), (79.5 + 0.1 * (i % 11)).alias("lon_deg"))
    k = F.col("n_nationkey")
    places = _t(spark, sf_dir, "nation").select(
        k.cast("long").alias("cell_idx"), (28.031 + k * 0.037).alias("lat_deg"), (79.61 + k * 0.031).alias("lon_deg")
    )
    ground = terrain.ridge(grid, 28.5, 5000.0, 0.2).withColumn("height_m", 900.0 + 40.0 * F.round((F.col("lon_deg") - 79.5) * 10) + F.col("height_m"))
    return places, terrain.horizon(places, ground, 60.0, 8)


@_query(f"{_HORIZON_SQL} SELECT CAST(cell_idx AS BIGINT) AS cell_idx, az_bin, round(mask, 6) AS mask_deg FROM hz")
def horizon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _horizon(spark, sf_dir)[1].select("cell_idx", F.col("az_bin").cast("long").alias("az_bin"), F.round("mask_deg", 6).alias("mask_deg"))


@_query(
    f"""{_HORIZON_SQL}, {_SATS},{_states_sql()},{_ground_sql('hcell')},{_view_sql()},
    az AS (SELECT cell_idx, t_idx, elev, degrees(atan2(-sin(radians(lon)) * dx + cos(radians(lon)) * dy,
      -sin(radians(lat)) * cos(radians(lon)) * dx - sin(radians(lat)) * sin(radians(lon)) * dy + cos(radians(lat)) * dz)) AS a FROM acc),
    azb AS (SELECT cell_idx, t_idx, elev, CAST(least(floor((CASE WHEN a < 0 THEN a + 360 ELSE a END) * 8 / 360), 7) AS BIGINT) AS az_bin FROM az)
    SELECT CAST(azb.cell_idx AS BIGINT) AS cell_idx, count(*) AS n_open, count(*) FILTER (elev >= greatest({MASK}, coalesce(mask, 0))) AS n_above_terrain
    FROM azb LEFT JOIN hz USING (cell_idx, az_bin) GROUP BY azb.cell_idx"""
)
def terrain_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, mask = _horizon(spark, sf_dir)
    states = satellite_states(satellites(spark, sf_dir), time_steps(spark, N_TIME, STEP_S))
    access = in_view(places, states, MASK).withColumn("az_bin", F.least(F.floor(azimuth_deg() * 8 / 360), F.lit(7)))
    return access.join(mask, ["cell_idx", "az_bin"], "left").groupBy("cell_idx").agg(
        F.count("*").alias("n_open"),
        F.count_if(F.col("elev_deg") >= F.greatest(F.lit(MASK), F.coalesce("mask_deg", F.lit(0.0)))).alias("n_above_terrain"),
    )


@_query(
    "SELECT s_suppkey, round(e8, 9) AS eccentric_rad FROM (WITH k AS (SELECT s_suppkey, (s_suppkey % 628) / 100.0 AS m, 0.05 + (s_suppkey % 13) / 20.0 AS e FROM supplier) SELECT s_suppkey, "
    + "list_reduce([m] || [i FOR i IN range(8)]::DOUBLE[], lambda x, y: x - (x - e * sin(x) - m) / (1 - e * cos(x))) AS e8 FROM k)"
)
def eccentric_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    e = orbit.eccentric_anomaly((k % 628) / 100.0, 0.05 + (k % 13) / 20.0)
    return _t(spark, sf_dir, "supplier").select("s_suppkey", F.round(e, 9).alias("eccentric_rad"))


@_query("SELECT c_custkey, round((10 + 5 - (c_custkey % 7) * 0.5) / 0.5, 3) AS crossing_s FROM customer")
def bisect_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = -5 + (F.col("c_custkey") % 7) * 0.5
    found = orbit.bisect(F.lit(0.0), F.lit(60.0), lambda t: base + 0.5 * t, F.lit(10.0), 40)
    return _t(spark, sf_dir, "customer").select("c_custkey", F.round(found, 3).alias("crossing_s"))


@_query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_size, rint_) - 1 AS BIGINT) AS plane_uid FROM (SELECT p_partkey, p_size * 1000.0 AS p_size, round_even(p_retailprice * 1000, 0) AS rint_ FROM part)")
def plane_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return constellation.plane_groups(rows, "p_size", "p_retailprice").select("p_partkey", "plane_uid")


@_query(
    """WITH p AS (SELECT p_partkey, p_size % 5 AS shell_id, p_partkey % 7 - 1 AS u FROM part),
    s AS (SELECT shell_id, sum(m) OVER (ORDER BY shell_id) - m AS off_ FROM (SELECT shell_id, max(u) + 1 AS m FROM p GROUP BY 1))
    SELECT p_partkey, CAST(p.shell_id AS BIGINT) AS shell_id, CAST(CASE WHEN u < 0 THEN -1 ELSE u + off_ END AS BIGINT) AS plane_uid FROM p JOIN s USING (shell_id)"""
)
def shell_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") % 5).cast("long").alias("shell_id"), (F.col("p_partkey") % 7 - 1).alias("plane_uid")
    )
    return constellation.concat_shells(rows).select("p_partkey", "shell_id", "plane_uid")


for _name, (_function, _sql) in network.QUERIES.items():
    _function.__name__ = _name
    QUERIES[_name], SQL[_name] = _function, _sql
