"""Registered queries of streams, bi-temporal reads, loads, block scans, model
cloning, contact times and hexagonal cells over the driver's tables; each has a
DuckDB twin."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satspan import more_queries
from satspan import queries as base
from satspan.functions import orbit
from satspan.operators import access, bitemporal, contacts, continuity, terrain
from satspan.plans import coverage_plan, model_plan
from satspan.sources import blocks, entities, files, hexgrid, loading
from satspan.sources.shared import new_folder
from satspan.streaming import rates, stateful

QUERIES = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with a time of the session's zone."""
    return _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# Streams -------------------------------------------------------------------------

PARTS = 3


@_query(
    """WITH e AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)
    SELECT user_id, t, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), (SELECT max(t) FROM e) + 900) AS end_s FROM e"""
)
def handover_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events arrive in files by time; a segment per start, in state by user."""
    links = _events(spark, sf_dir).select("user_id", "ts")
    out = new_folder(spark, "segments")
    stateful.run_in_parts(links, "ts", PARTS, "10 minutes", "links", lambda s: stateful.contact_segments(s, "user_id", "ts"), out)
    return stateful.timeline_of(spark.read.parquet(out), "user_id")


@_query(
    """WITH e AS (SELECT event_type, event_id, epoch_us(ts) AS us, props->>'$.k' = '0' AS m FROM events),
    d AS (SELECT event_type, min(us) AS done FROM e WHERE m GROUP BY 1)
    SELECT event_type, done AS complete_us, count(*) FILTER (NOT m AND us <= done) AS n_dump, count(*) FILTER (NOT m AND us > done AND us <= done + 86400000000) AS n_tail,
    coalesce(array_to_string((list(event_id ORDER BY event_id) FILTER (NOT m AND us > done AND us <= done + 86400000000))[1:3], ','), '') AS samples FROM e JOIN d USING (event_type) GROUP BY 1, 2"""
)
def dump_tail_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type's dump is complete with its first event whose number is 0."""
    rows = _events(spark, sf_dir).select("event_type", "ts", F.col("event_id").alias("id"), (F.get_json_object("props", "$.k") == "0").alias("mark"))
    out = new_folder(spark, "tails")
    stateful.run_in_parts(rows, "ts", PARTS, "10 minutes", "dump", lambda s: stateful.dump_then_tail(s, "ts", "event_type", "mark", 86400), out)
    found = spark.read.schema("event_type string, complete_us long, n_dump long, n_tail long, sample_ids array<bigint>").parquet(out)
    return found.select("event_type", "complete_us", "n_dump", "n_tail", F.array_join(F.col("sample_ids").cast("array<string>"), ",").alias("samples"))


# Two times -----------------------------------------------------------------------

#: Events describe the hour that they lie in and are committed up to 500 s later.
_VERSIONS = "v AS (SELECT event_type AS entity, epoch_us(ts) // 3600000000 * 3600000000 AS valid_us, epoch_us(ts) + event_id % 500 * 1000000 AS commit_us, value FROM events)"
AS_OF_US = 1_705_276_800_000_000  # 2024-01-15T00:00Z
_AS_OF = f"""WITH {_VERSIONS}, k AS (SELECT entity, valid_us, max((commit_us, value)) AS m FROM v WHERE commit_us <= {AS_OF_US} GROUP BY 1, 2)
SELECT entity, valid_us, lead(valid_us) OVER (PARTITION BY entity ORDER BY valid_us) AS valid_to_us, m[1] AS commit_us, m[2] AS value FROM k"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros("ts")
    return _events(spark, sf_dir).select(
        F.col("event_type").alias("entity"), (us - us % 3_600_000_000).alias("valid_us"), (us + F.col("event_id") % 500 * 1_000_000).alias("commit_us"), "value"
    )


@_query(_AS_OF)
def state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitemporal.as_of(versions(spark, sf_dir), AS_OF_US)


@_query(_AS_OF)
def state_as_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of commits that are up to ten minutes late."""
    rows = versions(spark, sf_dir).withColumn("commit_ts", F.timestamp_micros("commit_us"))
    out = new_folder(spark, "state")
    stateful.run_in_parts(rows, "commit_ts", PARTS, "10 minutes", "versions", lambda s: bitemporal.stream_as_of(s, AS_OF_US), out)
    return spark.read.parquet(out)


@_query(
    f"""WITH {_VERSIONS} SELECT entity, count(*) FILTER (commit_us >= {AS_OF_US} AND commit_us < {AS_OF_US} + 86400000000) AS n_changes, max(commit_us) FILTER (commit_us < {AS_OF_US}) AS before_us,
    arg_max(value, (commit_us, valid_us, value)) FILTER (commit_us < {AS_OF_US}) AS before_value FROM v GROUP BY 1"""
)
def commit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bitemporal.changes(versions(spark, sf_dir), AS_OF_US, AS_OF_US + 86_400_000_000)
    return found.groupBy("entity").agg(
        F.count_if(~F.col("before")).alias("n_changes"), F.max(F.when(F.col("before"), F.col("commit_us"))).alias("before_us"), F.max(F.when(F.col("before"), F.col("value"))).alias("before_value")
    )


WINDOWS_S = [60, 3600, 21600, 86400]


@_query(
    f"""WITH n AS (SELECT max(epoch_us(ts)) AS t FROM events), a AS (SELECT event_type, user_id, event_id, t - epoch_us(ts) AS age FROM events, n),
    w AS (SELECT unnest({WINDOWS_S}::BIGINT[]) AS s), c AS (SELECT event_type, user_id, s, count(*) FILTER (age <= s * 1000000) AS n, min(event_id) FILTER (age <= s * 1000000) AS m FROM a, w GROUP BY ALL)
    SELECT user_id, event_type, CAST(min(s) FILTER (n > 0) AS BIGINT) AS window_s, coalesce(arg_min(n, s) FILTER (n > 0), 0) AS n, arg_min(m, s) FILTER (n > 0) AS sample FROM c GROUP BY ALL"""
)
def smallest_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.struct("user_id", "event_type").alias("kind"), F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"))
    now = rows.agg(F.max("at")).first()[0]
    return bitemporal.smallest_window(rows, "kind", "at", WINDOWS_S, now).select("kind.user_id", "kind.event_type", "window_s", "n", "sample")


# Loads, dumps and models -----------------------------------------------------------


@_query("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def idempotent_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load left that stopped in its third bucket is mended by the next."""
    rows, path = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice")), new_folder(spark, "load")
    at = loading.bucket_of("o_orderkey", loading.BUCKETS)
    stopped = rows.withColumn("bucket", at).where((F.col("bucket") < 2) | ((F.col("bucket") == 2) & (F.col("o_custkey") % 2 == 0)))
    stopped.write.partitionBy("bucket").parquet(path)
    for _ in range(2):  # the second finds all complete
        loading.load(rows, path, "o_orderkey")
    return loading.loaded(spark, path, rows.schema)


@_query(
    """SELECT 'entities_antenna' AS "group", count(*) AS n FROM nation UNION ALL SELECT 'entities_platform', count(*) FILTER (s_suppkey % 6 <> 5) FROM supplier UNION ALL SELECT 'entities_unset', count(*) FILTER (s_suppkey % 6 = 5) FROM supplier
    UNION ALL SELECT 'relationships_contains', count(*) FROM nation UNION ALL SELECT 'relationships_other', count(*) FROM customer UNION ALL SELECT 'intents_unset', count(*) FROM orders
    UNION ALL SELECT NULL, (SELECT count(*) FROM nation) * 2 + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders)"""
)
def store_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a dump, counted by the write; all that it counts is there."""
    schema = spark.createDataFrame([], entities.SCHEMA).schema
    made = lambda df, name: df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema[name].dataType.elementType.fields])
    k = F.col("s_suppkey")
    motion = schema["entities"].dataType.elementType["platform"].dataType["motion"].dataType
    still = F.struct(F.array().cast(motion["entry"].dataType).alias("entry")).alias("motion")
    platform = F.when(k % 6 != 5, F.struct(F.concat(F.lit("p"), k).alias("name"), F.lit(False).alias("is_external_system"), still))
    sats = made(_t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k).alias("id"), F.lit(11).alias("kind"), platform.alias("platform")), "entities")
    antenna = F.struct(F.lit("dish").alias("type"), F.lit(True).alias("is_steerable"), F.lit(1.0).alias("max_transmit_power_w"), F.lit(2.0).alias("g_over_t_db_per_k"))
    dishes = made(_t(spark, sf_dir, "nation").select(F.concat(F.lit("a"), "n_nationkey").alias("id"), F.lit(40).alias("kind"), antenna.alias("antenna")), "entities")
    holds = _t(spark, sf_dir, "nation").select(F.lit(4).alias("kind"), F.lit("s0").alias("a"), F.concat(F.lit("a"), "n_nationkey").alias("z"))
    uses = _t(spark, sf_dir, "customer").select(F.lit(9).alias("kind"), F.concat(F.lit("c"), "c_custkey").alias("a"), F.lit("s0").alias("z"))
    plans = made(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("INSTALLED").alias("state")), "intents")
    path = new_folder(spark, "dump")
    manifest = entities.grouped_dump(entities.EntityStore.of(sats.unionByName(dishes), holds.unionByName(uses), plans), path)
    lines = spark.read.text(path).groupBy("group").agg(F.count("*").alias("_n"))
    checked = manifest.join(lines, "group", "left")
    return checked.select("group", F.when(F.col("group").isNull() | (F.col("n") == F.col("_n")), F.col("n")).alias("n"))


@_query(
    """SELECT 'satellite-' || s_suppkey || '-platform' AS id, 'n' || (s_suppkey % 25) AS a, 'p' || s_suppkey AS z, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 ELSE 0 END AS n_parts FROM supplier"""
)
def block_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text dump of the suppliers, with quoted braces and nested parts, read back."""
    k = F.col("s_suppkey").cast("string")
    part = F.lit('  part { name: "{" note { text: "}" } }\n')
    body = F.concat(
        F.lit('entity {\n  id: "satellite-'), k, F.lit('-platform"\n  a: "n'), (F.col("s_suppkey") % 25).cast("string"), F.lit('" z: "p'), k, F.lit('"\n'),
        F.repeat(part, (F.col("s_suppkey") % 3).cast("int")), F.lit("}"),
    )
    path = new_folder(spark, "text-dump")
    _t(spark, sf_dir, "supplier").select(body.alias("value")).write.text(path)
    return blocks.entity_blocks(spark, path).select("id", "a", "z", F.regexp_count("body", F.lit("part ")).cast("long").alias("n_parts"))


EPOCH_S = 1_767_225_600


def _template(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    ents = [("satellite-1-platform", 'id: "satellite-1-platform" grid: 1200.1.1 not 1200.1.15'), ("satellite-1-antenna", 'on "satellite-1-platform" uses "radio"'), ("radio", 'id: "radio"'), ("oisl-1", "x"), ("pop-1", "global")]
    rels = [(4, "satellite-1-platform", "satellite-1-antenna", "b"), (4, "satellite-1-antenna", "radio", 'z: "radio"'), (5, "satellite-1-antenna", "pop-1", "leaves")]
    return spark.createDataFrame(ents, "id string, body string"), spark.createDataFrame(rels, "kind int, a string, z string, body string")


def _network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    sats = _t(spark, sf_dir, "supplier").select(
        k.alias("sat_idx"), F.floor(k / 10).alias("plane_uid"), F.lit(7000.0).alias("a_km"), F.lit(0.0).alias("ecc"), F.lit(0.9).alias("inc_rad"), F.lit(0.1).alias("raan_rad"), F.lit(0.0).alias("argp_rad"), F.lit(0.5).alias("m_rad")
    )
    return model_plan.network_model(*_template(spark), sats, EPOCH_S)


@_query(
    f"""WITH s AS (SELECT s_suppkey + 1 AS i, s_suppkey // 10 + 1 AS p, s_suppkey % 10 + 1 AS l FROM supplier)
    SELECT 'satellite-' || i || '-platform' AS id, 'id: "satellite-' || i || '-platform" grid: 1200.' || p || '.' || l || ' not 1200.1.15' AS body, 'SAT-' || i || ' (' || p || '.' || l || ')' AS name, {EPOCH_S}::BIGINT AS epoch_s FROM s
    UNION ALL SELECT 'satellite-' || i || '-antenna', 'on "satellite-' || i || '-platform" uses "satellite-' || i || '-radio"', NULL, NULL FROM s UNION ALL SELECT 'satellite-' || i || '-radio', 'id: "satellite-' || i || '-radio"', NULL, NULL FROM s
    UNION ALL SELECT 'pop-1', 'global', NULL, NULL"""
)
def network_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _network(spark, sf_dir)[0].select("id", "body", "name", F.col("keplerian_elements.epoch.seconds").alias("epoch_s"))


@_query(
    """SELECT 'satellite-' || (s_suppkey + 1) || '-platform' AS a, 'satellite-' || (s_suppkey + 1) || '-antenna' AS z, 'b' AS body FROM supplier
    UNION ALL SELECT 'satellite-' || (s_suppkey + 1) || '-antenna', 'satellite-' || (s_suppkey + 1) || '-radio', 'z: "satellite-' || (s_suppkey + 1) || '-radio"' FROM supplier"""
)
def network_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _network(spark, sf_dir)[1].select("a", "z", "body")


# Tables written and read back ---------------------------------------------------------


@_query(f"{base._SATS.replace('n AS', 'WITH n AS', 1)} SELECT 'sat-' || sat_idx AS sat_id, round({orbit.RE + base.ALTITUDE!r}, 6) AS a_km, round(raan, 9) AS raan_rad, round(m, 9) AS m_rad FROM sat")
def elements_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements as CSV with a manifest, in the second run's file."""
    sats, path = base.satellites(spark, sf_dir).withColumn("sat_id", F.concat(F.lit("sat-"), "sat_idx")), files.run_path(new_folder(spark, "elements") + ".csv", 2)
    files.write_table(files.element_rows(sats), path, {"shell": "walker", "planes": base.PLANES})
    return files.read_elements(spark, path).where("sat_id <> 'sat_id'").select("sat_id", F.round("a_km", 6).alias("a_km"), F.round("raan_rad", 9).alias("raan_rad"), F.round("M_rad", 9).alias("m_rad"))


@_query(f"{base._COVERAGE} SELECT cell_idx, round(lat, 6) AS lat_deg, round(lon, 6) AS lon_deg, printf('%.6f', steps_k1 / {base.N_TIME}.0) AS availability FROM cov")
def availability_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The availability of every cell through its CSV."""
    path = new_folder(spark, "availability")
    rows = coverage_plan.run_coverage(base.cells(spark, sf_dir), base.satellites(spark, sf_dir), base.N_TIME, base.STEP_S, base.MASK)
    files.write_csv(files.availability_rows(rows), path, {"area": "all", "steps": base.N_TIME})
    back = spark.read.csv(path, schema="cell_idx LONG, lat DOUBLE, lon DOUBLE, availability STRING", header=True)
    return back.select("cell_idx", F.round("lat", 6).alias("lat_deg"), F.round("lon", 6).alias("lon_deg"), "availability")


@_query(
    """SELECT 'entities' AS list, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS n, NULL::BIGINT AS id_sum UNION ALL SELECT 'relationships', count(*), sum(n_nationkey)::BIGINT FROM nation
    UNION ALL SELECT 'intents', count(*), sum(length('i-' || o_orderkey))::BIGINT FROM orders WHERE o_orderstatus = 'O'"""
)
def recorded_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot recorded with its installed intents, and what is read from it."""
    path, have = new_folder(spark, "recorded"), more_queries.store(spark, sf_dir)
    entities.record(have, path, ["INSTALLED"])
    back = entities.EntityStore.recorded(spark, path)
    one = lambda rows, name, total: rows.agg(F.lit(name).alias("list"), F.count("*").alias("n"), total.cast("long").alias("id_sum"))
    number = F.substring_index("z", "-", -1).cast("long")
    out = one(back.list_entities(), "entities", F.lit(None)).unionByName(one(back.list_relationships(), "relationships", F.sum(number)))
    ids = F.concat(F.lit("i-"), F.regexp_extract("id", r"(\d+)", 1))
    return out.unionByName(one(back.list_intents(), "intents", F.sum(F.length(ids))))


@_query("SELECT 'p-' || s_suppkey AS sat_id FROM supplier WHERE s_suppkey % 7 > 0 AND s_suppkey % 5 > 0")
def first_source_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the first source that answers: a dump that is not there, then the store."""
    gone = new_folder(spark, "gone")
    found = entities.first_source(lambda: entities.elements(entities.EntityStore.recorded(spark, gone)), lambda: entities.elements(more_queries.store(spark, sf_dir)))
    return found.select(F.col("sat_id") if "sat_id" in found.columns else F.col("id").alias("sat_id"))


@_query(f"WITH {base._CELLS}, p AS (SELECT round(lat, 3) AS lat_deg, round(lon, 3) - 360 * floor((round(lon, 3) + 180) / 360) AS lon_deg, (cell_idx % 90)::DOUBLE AS h FROM cell) SELECT lat_deg, lon_deg, round(avg(h), 6) AS height_m FROM p GROUP BY 1, 2")
def elevation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation points as text with a header and a line of units; repeated points are averaged."""
    path = new_folder(spark, "elevation")
    rows = base.cells(spark, sf_dir).select(F.concat_ws(",", F.round("lat_deg", 3), F.round("lon_deg", 3), (F.col("cell_idx") % 90).cast("double")).alias("value"))
    head = spark.createDataFrame([("latitude,longitude,altitude",), ("degrees_north,degrees_east,m",)], "value string")
    head.unionByName(rows).write.text(path)
    return files.read_elevation(spark, path).withColumn("height_m", F.round("height_m", 6))


@_query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def accumulated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events bucket by bucket: each micro-batch is reduced and kept under its number."""
    rows = _events(spark, sf_dir).select("event_type", "value", "ts")
    folder, out = new_folder(spark, "buckets"), new_folder(spark, "sums")
    rows.repartitionByRange(4, "ts").write.parquet(folder)
    sums = lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    rates.accumulate(stateful.file_stream(spark, folder, rows.schema), sums, out, new_folder(spark, "checkpoint"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@_query(
    f"WITH {base._CELLS}, b AS (SELECT cell_idx, lat, unnest(range(4)) AS az_bin FROM cell) SELECT cell_idx, az_bin, round(abs(lat) / 10 * az_bin, 6) AS mask_deg FROM b WHERE abs(lat) / 10 * az_bin > 0"
)
def callable_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of a terrain that is a function of the place."""
    masks = terrain.masks_of(base.cells(spark, sf_dir), lambda lat, lon: F.array(*[F.abs(lat) / 10 * i for i in range(4)]), 4)
    return masks.select("cell_idx", "az_bin", F.round("mask_deg", 6).alias("mask_deg"))


@_query("SELECT s_suppkey, upper(s_name) AS name, s_suppkey % 90 + 0.5 AS lat_deg FROM supplier")
def patched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field and a nested field of each document replaced by expressions."""
    docs = _t(spark, sf_dir, "supplier").select("s_suppkey", F.struct(F.col("s_name").alias("name"), F.struct(F.lit(0.0).alias("lat_deg")).alias("place")).alias("d"))
    out = model_plan.patched(docs, {"d.name": F.upper("d.name"), "d.place.lat_deg": (F.col("s_suppkey") % 90 + 0.5).cast("double")})
    return out.select("s_suppkey", "d.name", "d.place.lat_deg")


# Contact times -----------------------------------------------------------------------


def _margin_sql() -> str:
    """km above the mask of satellite s and cell g at t seconds."""
    a = orbit.RE + base.ALTITUDE
    n = math.sqrt(orbit.MU / a**3)
    f = (orbit.RE / a) ** 2 * orbit.J2
    c, s = math.cos(math.radians(base.INCLINATION)), math.sin(math.radians(base.INCLINATION))
    dn, dp, dm = -1.5 * n * f * c, 0.75 * n * f * (5 * c * c - 1), n * (1 + 1.5 * f * (1 - 1.5 * s * s))
    return f"""
ang1 AS (SELECT *, ((2461041.5 + mid / 86400.0) - 2451545.0) / 36525.0 AS jc, raan + ({dn!r}) * mid AS o, ({dp!r}) * mid + m + ({dm!r}) * mid AS u FROM half),
ang2 AS (SELECT *, 67310.54841 + (876600.0 * 3600 + 8640184.812866) * jc + 0.093104 * jc * jc - 6.2e-6 * jc * jc * jc AS sec FROM ang1),
ang3 AS (SELECT *, radians((sec - 86400.0 * floor(sec / 86400.0)) / 240.0) AS gm, {a!r} * (cos(o) * cos(u) - sin(o) * sin(u) * {c!r}) AS xi, {a!r} * (sin(o) * cos(u) + cos(o) * sin(u) * {c!r}) AS yi, {a!r} * sin(u) * {s!r} AS z FROM ang2),
ang4 AS (SELECT *, cos(gm) * xi + sin(gm) * yi - cx AS dx, cos(gm) * yi - sin(gm) * xi - cy AS dy, z - cz AS dz FROM ang3),
mar AS (SELECT * EXCLUDE (jc, o, u, sec, gm, xi, yi, z, dx, dy, dz), dx * ux + dy * uy + dz * uz - {math.sin(math.radians(base.MASK))!r} * sqrt(dx * dx + dy * dy + dz * dz) AS margin FROM ang4)"""


_STEPS = orbit.bisection_steps(base.STEP_S, 1e-3)
_CONTACTS = f"""{base._INTERVALS},
ends AS (SELECT cell_idx, sat_idx, s, e, 0 AS side, (s - 1) * {base.STEP_S}::DOUBLE AS out_s, s * {base.STEP_S}::DOUBLE AS in_s FROM iv WHERE s > 0
  UNION ALL SELECT cell_idx, sat_idx, s, e, 1, (e + 1) * {base.STEP_S}::DOUBLE, e * {base.STEP_S}::DOUBLE FROM iv WHERE e < {base.N_TIME - 1}),
bis AS (SELECT ends.*, raan, m, cx, cy, cz, ux, uy, uz, 0 AS it FROM ends JOIN sat USING (sat_idx) JOIN gnd USING (cell_idx)
  UNION ALL (WITH half AS (SELECT *, (out_s + in_s) / 2 AS mid FROM bis WHERE it < {_STEPS}),{_margin_sql()}
  SELECT cell_idx, sat_idx, s, e, side, CASE WHEN margin >= 0 THEN out_s ELSE mid END, CASE WHEN margin >= 0 THEN mid ELSE in_s END, raan, m, cx, cy, cz, ux, uy, uz, it + 1 FROM mar)),
crs AS (SELECT cell_idx, sat_idx, s, e, side, (out_s + in_s) / 2 AS t FROM bis WHERE it = {_STEPS}),
con AS (SELECT iv.cell_idx, iv.sat_idx, iv.s, iv.e, coalesce(a.t, 0.0) AS start_s, coalesce(b.t, {(base.N_TIME - 1) * base.STEP_S}) AS end_s FROM iv
  LEFT JOIN crs a ON a.cell_idx = iv.cell_idx AND a.sat_idx = iv.sat_idx AND a.s = iv.s AND a.side = 0 LEFT JOIN crs b ON b.cell_idx = iv.cell_idx AND b.sat_idx = iv.sat_idx AND b.s = iv.s AND b.side = 1)"""


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact times by place of the cells, with ``n_cells``."""
    spans = continuity.intervals(base._access(spark, sf_dir, True), ["cell_idx", "n_cells", "sat_idx"])
    return contacts.contact_times(spans, access.places_of(base.cells(spark, sf_dir)), base.satellites(spark, sf_dir), base.N_TIME, base.STEP_S, base.MASK)


@_query(f"{_CONTACTS} SELECT cell_idx, sat_idx, s AS start_idx, e AS end_idx, round(start_s, 4) AS start_s, round(end_s, 4) AS end_s FROM con")
def contact_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rounded by place: there are far more rows by cell.
    found = _contacts(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("start_s", "end_s")})
    return access.pairs_at_cells(found, base.cells(spark, sf_dir)).select("cell_idx", "sat_idx", "start_idx", "end_idx", "start_s", "end_s")


@_query(f"{_CONTACTS} SELECT cell_idx, count(*) AS n_contacts, round(sum(end_s - start_s), 3) AS contact_s, round(min(end_s - start_s), 3) AS shortest_s, round(max(end_s - start_s), 3) AS longest_s FROM con GROUP BY 1")
def contact_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = access.at_cells(contacts.contact_seconds(_contacts(spark, sf_dir), "cell_idx"), base.cells(spark, sf_dir))
    return found.select("cell_idx", "n_contacts", *[F.round(c, 3).alias(c) for c in ("contact_s", "shortest_s", "longest_s")])


# Hexagonal cells -----------------------------------------------------------------------

LEVEL = 3


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"{float(x)!r}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


def _nearest_sql(source: str, x: str, y: str) -> str:
    """q and r of the lattice point nearest to (x, y), beside all columns of ``source``."""
    a = f"SELECT *, ({x}) AS lx, ({y}) * {2 / hexgrid.ROOT3!r} AS lr FROM {source}"
    b = f"SELECT *, lx - lr / 2 AS lq FROM ({a})"
    c = f"SELECT *, round_even(lq, 0) AS iq, round_even(lr, 0) AS ir, round_even(-lq - lr, 0) AS js FROM ({b})"
    d = f"SELECT *, abs(iq - lq) AS eq, abs(ir - lr) AS er, abs(js + lq + lr) AS es FROM ({c})"
    return f"SELECT * EXCLUDE (lx, lr, lq, iq, ir, js, eq, er, es), CASE WHEN eq > er AND eq > es THEN -ir - js ELSE iq END AS q2, CASE WHEN eq > er AND eq > es THEN ir WHEN er > es THEN -iq - js ELSE ir END AS r2 FROM ({d})"


def _times_sql(x: str, y: str, c: complex) -> tuple[str, str]:
    return f"({x}) * {c.real!r} - ({y}) * {c.imag!r}", f"({x}) * {c.imag!r} + ({y}) * {c.real!r}"


def _hex_sql() -> str:
    """The steps of ``hex_cells`` as CTEs over the same tables."""
    fac = _values([(i, *map(float, (*f["f"], *f["u"], *f["v"]))) for i, f in enumerate(hexgrid.faces())])
    edg = _values([(i, j, t.real, t.imag, s.real, s.imag) for i, (j, t, s) in enumerate(hexgrid.edges())])
    cor = _values([(i, j, p.real, p.imag, t.real, t.imag) for i, (j, p, t) in enumerate(hexgrid.corners())])
    bas = _values([(i, hexgrid._code(*c)) for i, c in enumerate(hexgrid.base_cells())])
    scale, half = hexgrid.faces()[0]["scale"], hexgrid.ROOT3 / 2
    ctes, n = [], 0

    def add(sql: str) -> str:
        nonlocal n
        n += 1
        ctes.append(f"h{n} AS ({sql})")
        return f"h{n}"

    def over(source: str, when: str) -> str:
        out = [(-1.0, 0.0), (0.5, -half), (0.5, half)]
        far = ", ".join(f"px * {c!r} + py * {s!r} AS d{k}" for k, (c, s) in enumerate(out))
        a = add(f"SELECT *, {far} FROM {source}")
        b = add(f"SELECT *, greatest(d0, d1, d2) AS best, face * 3 + CASE WHEN d0 >= d1 AND d0 >= d2 THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS e FROM {a}")
        new = {"face": "nb", "px": "px * rc - py * rs + ox", "py": "px * rs + py * rc + oy", "tc": "tc * rc - ts * rs", "ts": "tc * rs + ts * rc"}
        cols = ", ".join(f"CASE WHEN {when} THEN {x} ELSE {c} END AS {c}" for c, x in new.items())
        return add(f"SELECT * EXCLUDE (face, px, py, tc, ts, d0, d1, d2, best, e, ei, nb, rc, rs, ox, oy), {cols} FROM {b} JOIN edg ON ei = e")

    def named(source: str, level: int) -> str:
        px, py = _times_sql("q + r / 2.0", f"r * {half!r}", 1 / hexgrid.lattice_scale(level))
        a = over(add(f"SELECT * EXCLUDE (q, r), {px} AS px, {py} AS py, 1.0 AS tc, 0.0 AS ts FROM {source}"), f"best > {1 + hexgrid.EPS!r}")
        b = add(f"SELECT *, px * px + py * py > {(2 - hexgrid.EPS) ** 2!r} AS crn, face * 3 + CASE WHEN 2 * px > 3 THEN 0 WHEN -px + {hexgrid.ROOT3!r} * py > 3 THEN 1 ELSE 2 END AS k FROM {a}")
        new = {"face": "home", "px": "hx", "py": "hy", "tc": "tc * kc - ts * ks", "ts": "tc * ks + ts * kc"}
        cols = ", ".join(f"CASE WHEN crn THEN {x} ELSE {c} END AS {c}" for c, x in new.items())
        c = add(f"SELECT * EXCLUDE (face, px, py, tc, ts, k, ci, home, hx, hy, kc, ks), {cols} FROM {b} JOIN cor ON ci = k")
        d = over(c, f"best > {1 - hexgrid.EPS!r} AND nb < face AND NOT crn")
        x, y = _times_sql("px", "py", hexgrid.lattice_scale(level))
        e = add(_nearest_sql(d, x, y))
        return add(f"SELECT * EXCLUDE (q2, r2, crn), q2 AS q, r2 AS r FROM {e}")

    a = add(f"SELECT c_custkey, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM (SELECT cell_idx AS c_custkey, lat, lon FROM cell)")
    b = add(f"SELECT c_custkey, max_by((face, x * f0 + y * f1 + z * f2, x * u0 + y * u1 + z * u2, x * v0 + y * v1 + z * v2), x * f0 + y * f1 + z * f2) AS m FROM {a}, fac GROUP BY 1")
    c = add(f"SELECT c_custkey, m[1] AS face, m[3] / (m[2] * {scale!r}) AS px, m[4] / (m[2] * {scale!r}) AS py FROM {b}")
    x, y = _times_sql("px", "py", hexgrid.lattice_scale(LEVEL))
    d = add(f"SELECT c_custkey, face, q2 AS q, r2 AS r FROM ({_nearest_sql(c, x, y)})")
    e = named(d, LEVEL)
    at = [f"f{i} + (px * u{i} + py * v{i}) * {scale!r}" for i in range(3)]
    f = add(f"SELECT c_custkey, h.face, q, r, {', '.join(f'{p} AS g{i}' for i, p in enumerate(at))} FROM {e} h JOIN fac ON fac.face = h.face")
    now = add(f"SELECT c_custkey, face, q, r, degrees(atan2(g2, sqrt(g0 * g0 + g1 * g1))) AS lat, degrees(atan2(g1, g0)) AS lon, '' AS digits FROM {f}")
    for level in range(LEVEL, 0, -1):
        w = complex(2.5, half if level % 2 == 0 else -half)
        x, y = _times_sql("q + r / 2.0", f"r * {half!r}", 1 / w)
        up = add(_nearest_sql(now, x, y))
        wx, wy = _times_sql("q2 + r2 / 2.0", f"r2 * {half!r}", w)
        at_ = add(f"SELECT c_custkey, face, lat, lon, digits, q + r / 2.0 - ({wx}) AS cx, r * {half!r} - ({wy}) AS cy, q2 AS q, r2 AS r FROM {up}")
        p = named(at_, level - 1)
        turn = "degrees(atan2(cx * ts + cy * tc, cx * tc - cy * ts)) / 60"
        digit = f"CASE WHEN cx * cx + cy * cy < 0.25 THEN 0 ELSE CAST((round({turn}) + 6) % 6 AS INT) + 1 END"
        now = add(f"SELECT c_custkey, face, q, r, lat, lon, ({digit})::VARCHAR || digits AS digits FROM {p}")
    last = f"SELECT c_custkey, lpad(num::VARCHAR, 3, '0') || digits AS hex_id, round(lat, 6) AS hex_lat_deg, round(lon, 6) AS hex_lon_deg, lpad(num::VARCHAR, 3, '0') || digits[1:1] AS parent_id FROM {now} JOIN bas ON code = CAST(face * 100 + (q + 4) * 10 + r + 4 AS INT)"
    names = "fac(face, f0, f1, f2, u0, u1, u2, v0, v1, v2) AS ({}), edg(ei, nb, rc, rs, ox, oy) AS ({}), cor(ci, home, hx, hy, kc, ks) AS ({}), bas(num, code) AS ({})"
    return f"WITH {base._CELLS}, {names.format(fac, edg, cor, bas)}, {', '.join(ctes)} {last}"


def _hexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hexgrid.hex_cells(base.cells(spark, sf_dir), LEVEL)


@_query(_hex_sql())
def hex_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hexes(spark, sf_dir).select(
        F.col("cell_idx").alias("c_custkey"), "hex_id", F.round("hex_lat_deg", 6).alias("hex_lat_deg"), F.round("hex_lon_deg", 6).alias("hex_lon_deg"), hexgrid.hex_parent(F.col("hex_id"), 1).alias("parent_id")
    )


@_query(f"SELECT parent_id AS shard_id, count(*) AS n_points, count(DISTINCT hex_id) AS n_cells FROM ({_hex_sql()}) GROUP BY 1")
def hex_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hexgrid.hex_shards(_hexes(spark, sf_dir), 1).groupBy("shard_id").agg(F.count("*").alias("n_points"), F.countDistinct("hex_id").alias("n_cells"))


