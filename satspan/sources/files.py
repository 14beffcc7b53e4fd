"""CSV tables with a manifest of comment lines; elevation points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS_CSV = "sat_id STRING, a_km DOUBLE, e DOUBLE, i_rad DOUBLE, raan_rad DOUBLE, argp_rad DOUBLE, M_rad DOUBLE"


def write_csv(df: DataFrame, path: str, manifest: dict[str, object] | None = None) -> None:
    """Rows as CSV files; the manifest as a JSON file beside them."""
    df.write.mode("overwrite").csv(path, header=True)
    rows = [(k, str(v)) for k, v in sorted((manifest or {}).items())]
    df.sparkSession.createDataFrame(rows, "key string, value string").write.mode("overwrite").json(path.rstrip("/") + "_manifest")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=ELEMENTS_CSV, header=True, comment="#")


def availability_rows(coverage: DataFrame) -> DataFrame:
    """Sink layout: ordinal cell, place, availability."""
    return coverage.select(F.col("cell_idx").alias("cell_id"), "lat_deg", "lon_deg", F.format_string("%.6f", "availability_k1").alias("availability"))


def read_elevation(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon, height rows; others are skipped, longitudes wrapped, repeated
    points averaged."""
    raw = spark.read.csv(path, schema="lat STRING, lon STRING, height STRING", comment="#")
    n = lambda c: F.col(c).try_cast("double")
    return (
        raw.select(n("lat").alias("lat_deg"), (F.pmod(n("lon") + 180, F.lit(360.0)) - 180).alias("lon_deg"), n("height").alias("height_m"))
        .where("lat_deg is not null and lon_deg is not null and height_m is not null")
        .groupBy("lat_deg", "lon_deg").agg(F.avg("height_m").alias("height_m"))
    )


def write_table(df: DataFrame, path: str, manifest: dict[str, object] | None = None) -> None:
    """One CSV file part with ``# key: value`` lines before the header, for small
    tables of results (a row per cell or candidate, in their order)."""
    lines = [f"# {k}: {v}" for k, v in (manifest or {}).items()]
    head = df.sparkSession.createDataFrame([(0, i, x) for i, x in enumerate([*lines, ",".join(df.columns)])], "part int, n long, value string")
    body = df.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value")).withColumns({
        "part": F.lit(1), "n": F.monotonically_increasing_id()
    })
    head.unionByName(body).coalesce(1).sortWithinPartitions("part", "n").select("value").write.mode("overwrite").text(path)


def element_rows(satellites: DataFrame) -> DataFrame:
    """Sink layout of satellites; ``read_elements`` reads it."""
    named = {"e": "ecc", "i_rad": "inc_rad", "M_rad": "m_rad"}
    return satellites.select(*[F.col(named.get(c, c)).alias(c) for c in (x.split()[0] for x in ELEMENTS_CSV.split(", "))])


def coverage_rows(coverage: DataFrame, k: int = 1) -> DataFrame:
    """Sink layout of coverage: ordinal cell, place, availability and, where the run
    had them, the handover columns."""
    rows = [F.col("cell_idx").alias("cell_id"), F.col("lat_deg").alias("lat"), F.col("lon_deg").alias("lon"), F.format_string("%.6f", f"availability_k{k}").alias("availability")]
    if "mbb_feasible" in coverage.columns:
        rows += [F.col("mbb_feasible").cast("int").alias("mbb_feasible"), F.col("mbb_overlap_worst_s"), F.col("mbb_n_handovers")]
    return coverage.orderBy("cell_idx").select(*rows)


def sweep_rows(rows: DataFrame, mode: str, ks: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Sink layouts of a sweep: ``coverage_vs_n``, ``multi_shape`` (with
    ``is_winner``) or ``min_n_vs_inclination``."""
    six = lambda c: F.format_string("%.6f", c).alias(c)
    pct, mean = [six(f"pct_k{k}") for k in ks], [six(f"mean_avail_k{k}") for k in ks]
    if mode == "min_n_vs_inclination":
        return rows.orderBy("inclination_deg").select("inclination_deg", *[f"min_n_k{k}" for k in ks], "min_n_mbb")
    gate = [F.when(F.col("pct_mbb").isNotNull(), F.format_string("%.6f", "pct_mbb")).alias("pct_mbb"), F.col("mbb_pass").cast("int").alias("mbb_pass")]
    shape = [F.col("n_sats").alias("N"), "planes", "sats_per_plane"]
    if mode == "multi_shape":
        return rows.orderBy("planes", "sats_per_plane").select(*shape, *pct, *gate, F.col("is_winner").cast("int").alias("is_pareto"))
    if mode != "coverage_vs_n":
        raise ValueError(f"no layout {mode}")
    return rows.orderBy("n_sats").select(*shape, six("mean_sats_in_view"), *pct, *mean, *gate)


def run_path(path: str, run: int) -> str:
    """The path of a run: ``stem_run{n}.ext``, so earlier runs stay."""
    stem, dot, ext = path.rpartition(".")
    return f"{stem}_run{run}.{ext}" if dot and "/" not in ext else f"{path}_run{run}"


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cell centres (``cell_id, lat, lon`` first) of a CSV file with manifest lines."""
    raw = spark.read.csv(path, schema="cell_id LONG, lat DOUBLE, lon DOUBLE, rest STRING", header=True, comment="#", enforceSchema=True)
    return raw.where("lat is not null").select(F.col("cell_id").alias("cell_idx"), F.col("lat").alias("lat_deg"), F.col("lon").alias("lon_deg"))


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``body, id, a, z`` of the entity blocks of a protobuf text dump: Spark's
    reader splits the file at the line that opens a block, so a block is a row."""
    rows = spark.read.option("lineSep", "\nentity {\n").text(path)
    first = F.regexp_replace("value", r"^entity \{\n", "")
    field = lambda p: F.regexp_extract("body", p, 1)
    return (
        rows.select(F.regexp_replace(first, r"\n\}\s*$", "").alias("body")).where(F.trim("body") != "")
        .select("body", field(r'(?m)^  id: "([^"]+)"').alias("id"), field(r'\ba: "([^"]+)"').alias("a"), field(r'\bz: "([^"]+)"').alias("z"))
    )
