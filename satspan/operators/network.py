"""Network-model and link analytics: joins, timelines, counts, deltas.

``QUERIES`` maps a name to its function over the driver's tables and the DuckDB
twin; the functions above it are the general operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from satspan.operators.continuity import intervals, timeline
from satspan.operators.ranking import least_of_later


def hour(ts: str) -> Column:
    return F.floor(F.unix_timestamp(ts) / 3600)


def forward_value(left: DataFrame, refs: DataFrame, at: str, ref: str, width: float, out: str = "reference") -> DataFrame:
    """As-of join: each ``at`` with the least ``ref`` not below it, null if all
    are; both are numbers.

    Rows and references meet in buckets of ``width``, in falling order, so one
    running minimum tells each row; a bucket's rows above its last reference take
    the first one of a later bucket, from a table of a row per bucket.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    held = refs.select(F.col(ref).alias("_ref")).where("_ref is not null").distinct()
    first = held.groupBy(bucket("_ref").alias("_bucket")).agg(F.min("_ref").alias("_first"))
    rows = left.withColumns({"_at": F.col(at), "_bucket": bucket(at), "_row": F.lit(True)})
    both = rows.unionByName(held.withColumns({"_at": F.col("_ref"), "_bucket": bucket("_ref")}), allowMissingColumns=True)
    falling = Window.partitionBy("_bucket").orderBy(F.desc("_at"), F.desc_nulls_last("_ref")).rowsBetween(Window.unboundedPreceding, 0)
    mine = both.withColumn("_near", F.min("_ref").over(falling)).where("_row")
    # A bucket without references takes the first one of the next that has some.
    every = rows.select("_bucket").distinct().unionByName(first, allowMissingColumns=True).groupBy("_bucket").agg(F.max("_first").alias("_first"))
    nxt = least_of_later(every, "_bucket", "_first", "_later").select("_bucket", "_later")
    return (
        mine.join(nxt, "_bucket", "left")  # one row per bucket
        .withColumn(out, F.coalesce("_near", "_later"))
        .select(*left.columns, out)
    )


def forward_reference(left: DataFrame, right: DataFrame, at: str, ref: str) -> DataFrame:
    """As-of join of times: each ``at`` with the least ``ref`` not before it; by
    the hour, with the first reference of a later hour carried in."""
    left = left.withColumns({at: F.col(at).cast("timestamp"), "_us": F.unix_micros(F.col(at).cast("timestamp"))})
    refs = right.select(F.unix_micros(F.col(ref).cast("timestamp")).alias("_us_ref"))
    found = forward_value(left, refs, "_us", "_us_ref", 3.6e9, "_found")
    return found.withColumn("reference", F.timestamp_micros("_found")).drop("_us", "_found")


def satellite_of(antenna: Column) -> Column:
    """The satellite that an antenna id names: all up to ``-platform``."""
    return F.substring_index(antenna, "-platform", 1)


def observed_coverage(segments: DataFrame, ks: tuple[int, ...] = (1, 2), sat_of=satellite_of) -> DataFrame:
    """Availability from accessibility segments.

    ``segments(id, interval_start_s, sampling_resolution_s, accessibilities)``
    with ids ``T:<bucket>#<antenna>@<lat>/<lon>``; antennas collapse to their
    satellite, the time grid is that of all segments, and a point without a
    segment at a step counts 0 there.
    """
    pattern = r"^T:([^#]*)#([^@]*)@([^/]*)/(.*)"
    part = lambda i: F.regexp_extract("id", pattern, i)
    rows = segments.where(F.col("id").rlike(pattern)).select(
        sat_of(part(2)).alias("sat"), part(3).try_cast("double").alias("lat_deg"),
        part(4).try_cast("double").alias("lon_deg"), "interval_start_s", "sampling_resolution_s", F.posexplode("accessibilities").alias("pos", "seen"),
    ).withColumn("t_s", F.col("interval_start_s") + F.col("pos") * F.col("sampling_resolution_s"))
    n = rows.agg(F.countDistinct("t_s").alias("n_time"))  # one row
    per = (
        rows.groupBy("lat_deg", "lon_deg", "t_s").agg(F.countDistinct(F.when(F.col("seen"), F.col("sat"))).alias("n"))
        .groupBy("lat_deg", "lon_deg").agg(F.sum("n").alias("s"), *[F.count_if(F.col("n") >= k).alias(f"c{k}") for k in ks])
    )
    return per.crossJoin(F.broadcast(n)).select(
        "lat_deg", "lon_deg", "n_time", (F.col("s") / F.col("n_time")).alias("sats_in_view_mean"),
        *[(F.col(f"c{k}") / F.col("n_time")).alias(f"availability_k{k}") for k in ks],
    )


def platform_series(segments: DataFrame) -> DataFrame:
    """``id, pos, seen`` of segments whose flags are the blocks of several
    platforms in a row: a sample is seen if any platform sees it. Flags that do
    not divide by the platforms are one series."""
    n = F.greatest(F.size("platforms"), F.lit(1))
    samples = F.when(F.size("accessibilities") % n == 0, F.floor(F.size("accessibilities") / n)).otherwise(F.size("accessibilities"))
    rows = segments.select("id", samples.alias("_n"), F.posexplode("accessibilities").alias("p", "seen"))
    return rows.groupBy("id", (F.col("p") % F.col("_n")).cast("long").alias("pos")).agg(F.bool_or("seen").alias("seen"))


def merge_buckets(buckets: DataFrame, ks: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Coverage of points over buckets of time: availabilities weighted by the
    samples of each bucket; a point in some buckets only has those."""
    n = F.sum("n_time")
    weighted = lambda c: (F.sum(F.col(c) * F.col("n_time")) / n).alias(c)
    return buckets.groupBy("lat_deg", "lon_deg").agg(
        n.alias("n_time"), weighted("sats_in_view_mean"), *[weighted(f"availability_k{k}") for k in ks]
    )


def by_prefix(rows: DataFrame, prefix: str, column: str = "id") -> DataFrame:
    """Rows whose id begins so; the scan gets the filter."""
    return rows.where(F.col(column).startswith(prefix))


def committed(rows: DataFrame, start: str, end: str, column: str = "commit_ts") -> DataFrame:
    """Rows by commit time, which need not be the time that they describe; the
    start is included, the end is not."""
    at = F.col(column)
    return rows.where((at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp")))


def family(entity_id: Column) -> Column:
    """``drop`` for links between satellites, ``sat``, ``ut``, else ``global``."""
    return (
        F.when(entity_id.contains("oisl") | entity_id.contains("-to-satellite-"), "drop")
        .when(entity_id.rlike(r"^satellite-\d+-"), "sat").when(entity_id.rlike(r"^user-terminal-\d+-"), "ut").otherwise("global")
    )


def link_kind(modulator: Column) -> Column:
    """Kind of a link by its modulator: an inter-satellite one with its direction,
    ``user``, ``feeder`` or ``other``."""
    return (
        F.when(modulator.contains("oisl"), F.concat(F.lit("oisl-"), F.split_part(F.split_part(modulator, F.lit("oisl-"), F.lit(2)), F.lit("-"), F.lit(1))))
        .when(modulator.contains("user"), "user").when(modulator.contains("feeder") | modulator.contains("gateway"), "feeder").otherwise("other")
    )


def short_name(entity_id: Column) -> Column:
    out = entity_id
    for long, short in (("-platform", ""), ("satellite-", "sat-"), ("gateway-", "gw-"), ("user-terminal-", "ut-"), ("-network-node", "")):
        out = F.replace(out, F.lit(long), F.lit(short))
    return out


def plane_and_slot(name: Column) -> tuple[Column, Column]:
    """The last two numbers of a name that ends in ``-a.plane.slot``; null if it
    does not."""
    parts = F.regexp_extract(name, r"-([^-]*\.[^-]*\.[^-]*)$", 1)
    piece = lambda i: F.get(F.split(parts, r"\."), F.lit(i)).try_cast("long")
    both = piece(1).isNotNull() & piece(2).isNotNull() & (F.size(F.split(parts, r"\.")) == 3)
    return F.when(both, piece(1)), F.when(both, piece(2))


def hop_types(hops: DataFrame, categories: DataFrame) -> DataFrame:
    """Counts of hops by the categories of their ends; an unknown end is a PoP.
    ``hops(src, dst)``, ``categories(id, category)``."""
    side = lambda c: categories.select(F.col("id").alias(c), F.col("category").alias(f"{c}_category"))
    named = hops.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    return named.groupBy(*[F.coalesce(f"{c}_category", F.lit("PoP")).alias(f"{c}_category") for c in ("src", "dst")]).agg(F.count("*").alias("n"))


def busiest(rows: DataFrame, key: str, least: int = 2, top: int = 30) -> DataFrame:
    """The first ``top`` keys by falling number of rows, of those with at least
    ``least``; ties by key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), key).limit(top)


def first_buckets(rows: DataFrame, bucket: str, n: int) -> DataFrame:
    """Rows of the first n buckets by name."""
    names = rows.select(bucket).distinct().orderBy(bucket).limit(n)  # n rows
    return rows.join(F.broadcast(names), bucket, "left_semi")


def waves(rows: DataFrame, at: str, kind: str, bins: int = 60) -> DataFrame:
    """Histogram of the hours since the first row, by kind: ``bins`` equal bins, the
    last one closed."""
    ends = rows.agg(F.min(at).alias("_a"), F.max(at).alias("_b"))  # one row
    width = F.greatest((F.col("_b") - F.col("_a")) / F.lit(float(bins)), F.lit(1e-9))
    bin_ = F.least(F.floor((F.col(at) - F.col("_a")) / width), F.lit(bins - 1)).cast("long")
    return rows.crossJoin(F.broadcast(ends)).groupBy(kind, bin_.alias("bin")).agg(F.count("*").alias("n"), F.min((F.col(at) - F.col("_a")) / 3600.0).alias("first_hour"))


def load_missing(have: DataFrame, required: DataFrame, key: str = "id") -> DataFrame:
    """The rows of ``required`` that are still to be loaded: those not there yet."""
    return required.join(have.select(key), key, "left_anti")


def load_state(have: DataFrame, required: DataFrame, key: str = "id") -> DataFrame:
    """One row: rows required and there, and ``complete``, ``partial`` or ``empty``."""
    both = required.select(key).join(have.select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
    n, there = F.count("*"), F.count_if(F.col("_there").isNotNull())
    state = F.when(there == n, "complete").when(there == 0, "empty").otherwise("partial")
    return both.agg(n.alias("n_required"), there.alias("n_there"), state.alias("state"))


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("user_id", hour("ts").alias("t_idx"))
    return intervals(rows, ["user_id"])


def event_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _t(spark, sf_dir, "events").groupBy("event_type", hour("ts").alias("h")).agg(F.countDistinct("user_id").alias("n"))
    return per.groupBy("event_type").agg(*[F.count_if(F.col("n") >= k).alias(f"hours_k{k}") for k in (1, 2, 3)])


def handover_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("t")).distinct()
    return timeline(rows, "user_id", "t").select("user_id", "t", "end_s")


def tumbling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window("ts", "12 hours")
    return _t(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(
        F.unix_timestamp("w.start").alias("start_s"), "event_type", "n"
    )


def enactment_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("event_type", F.unix_timestamp("ts").alias("t"))
    first = rows.agg(F.min("t").alias("t0"))  # one row
    since = rows.crossJoin(F.broadcast(first)).select("event_type", F.floor((F.col("t") - F.col("t0")) / 3600).alias("hours"))
    return since.groupBy("event_type", "hours").agg(F.count("*").alias("n"))


def type_state_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"))
        .pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    )


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def relationship_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, nations = _t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation")
    return regions.join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_name").agg(
        F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("members")
    )


def node_to_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = _t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_name").alias("platform"))
    hops = _t(spark, sf_dir, "customer")
    return hops.join(owners, F.col("c_nationkey") == F.col("s_nationkey"), "left").select(
        "c_custkey", F.coalesce("platform", "c_name").alias("platform")
    )


def gateway_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    nations = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        load.join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .groupBy(F.coalesce("n_name", F.lit("PoP")).alias("gateway")).agg(F.sum("n").alias("n_hops"))
    )


def load_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return load.agg(
        F.min("n").alias("min_n"), F.percentile("n", F.lit(0.5)).alias("median_n"), F.max("n").alias("max_n"),
        F.round(F.max("n") / F.greatest(F.min("n"), F.lit(1)), 9).alias("imbalance"),
    )


def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("u"), (F.col("l_partkey") % 50).alias("v"))
    return rows.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(
        F.count("*").alias("n"), F.count_if(F.col("u") % 10 == F.col("v") % 10).alias("n_in_plane")
    )


def hop_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = _t(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("served"))
    rows = _t(spark, sf_dir, "lineitem").join(served, "l_suppkey", "left")
    ground = F.col("l_returnflag") == "R"
    return rows.agg(
        F.count_if(ground).alias("n_ground"), F.count_if(~ground & F.col("served").isNotNull()).alias("n_served"),
        F.count_if(~ground & F.col("served").isNull()).alias("n_unserved"),
        F.round(F.count_if(~ground & F.col("served").isNotNull()) / F.greatest(F.lit(1), F.count_if(~ground)), 9).alias("ratio"),
    )


def capacity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = F.col("l_discount") > 0
    return _t(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("n"), F.count_if(served).alias("n_served"), F.round(100 * F.count_if(served) / F.count("*"), 6).alias("served_pct"),
        F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.percentile(F.when(served, F.col("l_quantity")), F.lit(0.5)), 4).alias("median_served"),
    )


def id_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = r"^(https?)://([^/]+)/([a-z]+)/([0-9]*)"
    return _t(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", p, 2).alias("host"), F.regexp_extract("url", p, 3).alias("area"),
        F.regexp_extract("url", p, 4).alias("number"),
    )


def event_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(k).alias("n"), F.sum(k.cast("long")).alias("total"), F.max(k.cast("long")).alias("largest")
    )


def segment_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    return rows.groupBy("label", "pos").agg(F.countDistinct(F.when(F.col("v") > 0, F.col("vec_id"))).alias("n_seen"), F.bool_or(F.col("v") > 0).alias("any_seen"))


def bucket_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = _t(spark, sf_dir, "events").groupBy("event_type", (F.col("event_id") % 7).alias("bucket")).agg(
        F.count("*").alias("n"), F.avg("value").alias("avail")
    )
    return buckets.groupBy("event_type").agg(
        F.sum("n").alias("n"), F.round(F.sum(F.col("avail") * F.col("n")) / F.sum("n"), 6).alias("weighted_mean")
    )


def delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda k, name: _t(spark, sf_dir, "events").where(F.col("event_id") % 2 == k).groupBy("event_type").agg(F.avg("value").alias(name))
    d = F.col("a") - F.col("b")
    return half(0, "a").join(half(1, "b"), "event_type").agg(
        F.round(F.avg(d), 6).alias("mean_delta"), F.round(F.max(F.abs(d)), 6).alias("max_abs_delta"),
        F.round(F.avg(F.when(F.abs(d) <= 1, 1.0).otherwise(0.0)), 6).alias("share_close"),
    )


def dedup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("user_id", "event_type").dropDuplicates()


def union_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cell"))
    return a.union(_t(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


def containment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey")


def asof_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("event_id", "ts")
    found = forward_reference(events, _t(spark, sf_dir, "orders"), "ts", "o_orderdate")
    return found.select("event_id", F.unix_micros("reference").alias("reference_us"))


def dump_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").rollup("source", "lang").agg(
        F.count("*").alias("n_docs"), F.sum(F.octet_length("text")).alias("n_bytes")
    )


def platform_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("o_orderstatus") == "P", "non-keplerian").when(F.col("o_totalprice") > 250000, "external")
    return _t(spark, sf_dir, "orders").groupBy(F.coalesce(reason, F.lit("served")).alias("verdict")).agg(F.count("*").alias("n"))


def minimum_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(90 - F.percentile("p_size", F.lit(0.5)), 6).alias("min_elev_deg"))


_H = "floor(epoch(ts) / 3600)"
QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (event_sessions, f"""SELECT user_id, CAST(min(h) AS BIGINT) AS start_idx, CAST(max(h) AS BIGINT) AS end_idx FROM (SELECT user_id, h, h - row_number() OVER (PARTITION BY user_id ORDER BY h) AS k
            FROM (SELECT DISTINCT user_id, {_H} AS h FROM events)) GROUP BY user_id, k"""),
        (event_availability, f"""SELECT event_type, count(*) FILTER (n >= 1) AS hours_k1, count(*) FILTER (n >= 2) AS hours_k2, count(*) FILTER (n >= 3) AS hours_k3
            FROM (SELECT event_type, {_H} AS h, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2) GROUP BY 1"""),
        (handover_timeline, """WITH e AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)
            SELECT user_id, t, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), max(t) OVER () + 900) AS end_s FROM e"""),
        (tumbling_rate, "SELECT CAST(floor(epoch(ts) / 43200) * 43200 AS BIGINT) AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
        (enactment_waves, """SELECT event_type, CAST(floor((floor(epoch(ts)) - t0) / 3600) AS BIGINT) AS hours, count(*) AS n FROM events, (SELECT min(floor(epoch(ts))) AS t0 FROM events) GROUP BY 1, 2"""),
        (type_state_pivot, """SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1"""),
        (value_counts, "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2"),
        (relationship_join, "SELECT r_name, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS members FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1"),
        (node_to_platform, """SELECT c_custkey, coalesce(platform, c_name) AS platform FROM customer LEFT JOIN (SELECT s_nationkey, min(s_name) AS platform FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey"""),
        (gateway_load, "SELECT coalesce(n_name, 'PoP') AS gateway, count(*) AS n_hops FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"),
        (load_imbalance, "SELECT min(n) AS min_n, median(n) AS median_n, max(n) AS max_n, round(max(n) / greatest(min(n), 1), 9) AS imbalance FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)"),
        (edge_counts, """SELECT least(u, v) AS a, greatest(u, v) AS b, count(*) AS n, count(*) FILTER (u % 10 = v % 10) AS n_in_plane FROM (SELECT l_suppkey % 50 AS u, l_partkey % 50 AS v FROM lineitem) GROUP BY 1, 2"""),
        (hop_verdicts, """SELECT count(*) FILTER (g) AS n_ground, count(*) FILTER (NOT g AND s) AS n_served, count(*) FILTER (NOT g AND NOT s) AS n_unserved,
            round(count(*) FILTER (NOT g AND s) / greatest(1, count(*) FILTER (NOT g)), 9) AS ratio
            FROM (SELECT l_returnflag = 'R' AS g, l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AS s FROM lineitem)"""),
        (capacity_stats, """SELECT count(*) AS n, count(*) FILTER (l_discount > 0) AS n_served, round(100.0 * count(*) FILTER (l_discount > 0) / count(*), 6) AS served_pct,
            round(sum(l_quantity), 2) AS total, round(median(l_quantity) FILTER (l_discount > 0), 4) AS median_served FROM lineitem"""),
        (id_decode, r"""SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/([0-9]*)', 2) AS host, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/([0-9]*)', 3) AS area,
            regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/([0-9]*)', 4) AS number FROM pages"""),
        (event_property, """SELECT event_type, count(k) AS n, CAST(sum(CAST(k AS BIGINT)) AS BIGINT) AS total, max(CAST(k AS BIGINT)) AS largest FROM (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events) GROUP BY 1"""),
        (segment_explode, """SELECT label, CAST(pos AS INTEGER) AS pos, count(DISTINCT vec_id) FILTER (v > 0) AS n_seen, bool_or(v > 0) AS any_seen
            FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2"""),
        (bucket_merge, "SELECT event_type, count(*) AS n, round(avg(value), 6) AS weighted_mean FROM events GROUP BY 1"),
        (delta_stats, """SELECT round(avg(d), 6) AS mean_delta, round(max(abs(d)), 6) AS max_abs_delta, round(avg(CASE WHEN abs(d) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS share_close
            FROM (SELECT avg(value) FILTER (event_id % 2 = 0) - avg(value) FILTER (event_id % 2 = 1) AS d FROM events GROUP BY event_type)"""),
        (dedup_links, "SELECT DISTINCT user_id, event_type FROM events"),
        (union_fill, "SELECT c_nationkey AS cell FROM customer UNION SELECT s_nationkey FROM supplier"),
        (containment_check, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
        (asof_reference, "SELECT event_id, epoch_us(o) AS reference_us FROM events ASOF LEFT JOIN (SELECT DISTINCT o_orderdate AS o FROM orders) ON ts <= o"),
        (dump_manifest, "SELECT source, lang, count(*) AS n_docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM documents GROUP BY ROLLUP (source, lang)"),
        (platform_partition, "SELECT CASE WHEN o_orderstatus = 'P' THEN 'non-keplerian' WHEN o_totalprice > 250000 THEN 'external' ELSE 'served' END AS verdict, count(*) AS n FROM orders GROUP BY 1"),
        (minimum_elevation, "SELECT p_brand, round(90 - median(p_size), 6) AS min_elev_deg FROM part GROUP BY 1"),
    )
}
