"""Network-model documents: JSON snapshots to tables, elements and hops."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from satspan.functions.orbit import mean_from_true, mean_motion, two_pi

PLATFORM, ANTENNA, CONTAINS = 11, 40, 4
LISTS = ("entities", "relationships", "intents")

SCHEMA = """
entities ARRAY<STRUCT<id STRING, kind INT,
  platform STRUCT<name STRING, is_external_system BOOLEAN, motion STRUCT<entry ARRAY<STRUCT<
    keplerian_elements STRUCT<semimajor_axis_m DOUBLE, eccentricity DOUBLE, inclination_deg DOUBLE, raan_deg DOUBLE,
      argument_of_periapsis_deg DOUBLE, true_anomaly_deg DOUBLE, epoch STRUCT<seconds BIGINT>>,
    tle STRUCT<line1 STRING, line2 STRING>>>>>,
  antenna STRUCT<type STRING, is_steerable BOOLEAN, max_transmit_power_w DOUBLE, g_over_t_db_per_k DOUBLE>>>,
relationships ARRAY<STRUCT<kind INT, a STRING, z STRING>>,
intents ARRAY<STRUCT<id STRING, state STRING, route STRUCT<path_segments ARRAY<STRUCT<src_network_node_id STRING,
  dst_network_node_id STRING, src_interface_id STRING, dst_interface_id STRING>>>>>
"""


class EntityStore:
    """A read-only snapshot: each list is a DataFrame. ``path`` is one JSON document
    with the three lists; ``recorded`` reads the folder that ``record`` wrote."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        document = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
        self._lists = {k: document.select(F.explode(k).alias("x")).select("x.*") for k in LISTS}

    @classmethod
    def of(cls, entities: DataFrame, relationships: DataFrame, intents: DataFrame) -> EntityStore:
        store = cls.__new__(cls)
        store._lists = dict(zip(LISTS, (entities, relationships, intents)))
        return store

    @classmethod
    def recorded(cls, spark: SparkSession, path: str) -> EntityStore:
        schema = spark.createDataFrame([], SCHEMA).schema
        return cls.of(*[spark.read.schema(schema[k].dataType.elementType).json(f"{path}/{k}") for k in LISTS])

    def list_entities(self, kind: int | None = None) -> DataFrame:
        rows = self._lists["entities"]
        return rows if kind is None else rows.where(F.col("kind") == kind)

    def list_relationships(self, condition: str | None = None) -> DataFrame:
        rows = self._lists["relationships"]
        return rows if condition is None else rows.where(condition)

    def get_entity(self, entity_id: str) -> DataFrame:
        found = self.list_entities().where(F.col("id") == entity_id)
        if found.isEmpty():
            raise LookupError(f"no entity {entity_id}")
        return found

    def list_intents(self, states: list[str] | None = None) -> DataFrame:
        rows = self._lists["intents"]
        return rows if states is None else rows.where(F.col("state").isin(states))


def verdicts(store: EntityStore) -> DataFrame:
    """Platforms with ``skip_reason``: null for those that can be propagated."""
    kepler = F.filter("platform.motion.entry", lambda e: e["keplerian_elements"].isNotNull())
    reason = F.when(F.coalesce(F.size(kepler), F.lit(0)) < 1, "non-keplerian motion").when(
        F.coalesce("platform.is_external_system", F.lit(False)), "external system"
    )
    rows = store.list_entities(PLATFORM).where(F.col("platform").isNotNull())
    return rows.select("id", F.col("platform.name").alias("name"), F.get(kepler, F.lit(0))["keplerian_elements"].alias("k"), reason.alias("skip_reason"))


def elements(store: EntityStore, ref_epoch_s: int | None = None) -> DataFrame:
    """Elements of the served platforms at one reference epoch (the earliest
    unless given); node and perigee are not moved."""
    rows = verdicts(store).where("skip_reason is null").withColumn("epoch_s", F.coalesce("k.epoch.seconds", F.lit(0)))
    ref = rows.agg(F.min("epoch_s").alias("ref")) if ref_epoch_s is None else rows.sparkSession.range(1).select(F.lit(ref_epoch_s).alias("ref"))
    a, e = F.col("k.semimajor_axis_m") / 1000.0, F.col("k.eccentricity")
    mean = mean_from_true(F.radians("k.true_anomaly_deg"), e)
    return rows.crossJoin(F.broadcast(ref)).select(
        F.col("id").alias("sat_id"), a.alias("a_km"), e.alias("ecc"), F.radians("k.inclination_deg").alias("inc_rad"),
        F.radians("k.raan_deg").alias("raan_rad"), F.radians("k.argument_of_periapsis_deg").alias("argp_rad"),
        two_pi(mean + mean_motion(a) * (F.col("ref") - F.col("epoch_s"))).alias("m_rad"), F.col("ref").alias("ref_epoch_s"),
    )


def antennas(store: EntityStore) -> DataFrame:
    """Platforms with the sorted ids of the antennas they contain."""
    holds = store.list_relationships(f"kind = {CONTAINS}")
    inner = store.list_entities(ANTENNA).select(F.col("id").alias("z"))
    return (
        store.list_entities(PLATFORM).select("id").join(holds.join(inner, "z", "left_semi"), F.col("id") == F.col("a"), "left")
        .groupBy("id").agg(F.array_sort(F.collect_list("z")).alias("antenna_ids"))
    )


def hops(intents: DataFrame) -> DataFrame:
    return intents.select("id", "state", F.posexplode("route.path_segments").alias("hop", "s")).select("id", "state", "hop", "s.*")


def antenna_facts(store: EntityStore) -> DataFrame:
    """The flattened antenna documents."""
    return store.list_entities(ANTENNA).where(F.col("antenna").isNotNull()).select("id", "antenna.*")


def inventory(store: EntityStore) -> DataFrame:
    """One row: entities, platforms and antennas, platforms by verdict, installed
    intents, and whether any platform can be propagated."""
    kinds = store.list_entities().agg(
        F.count("*").alias("n_entities"), F.count_if(F.col("kind") == PLATFORM).alias("n_platforms"), F.count_if(F.col("kind") == ANTENNA).alias("n_antennas")
    )
    reason = F.col("skip_reason")
    motion = verdicts(store).agg(
        F.count_if(reason.isNull()).alias("n_served"), F.count_if(reason == "external system").alias("n_external"),
        F.count_if(reason == "non-keplerian motion").alias("n_other"),
    )
    intents = store.list_intents(["INSTALLED"]).agg(F.count("*").alias("n_intents"))
    return kinds.crossJoin(motion).crossJoin(intents).withColumn("passed", F.col("n_served") > 0)  # one row each


def record(store: EntityStore, path: str, states: list[str] | None = None) -> None:
    """Write a snapshot of what the engine uses, a folder of JSON lines per list;
    ``EntityStore.recorded`` reads it."""
    for name, rows in zip(LISTS, (store.list_entities(), store.list_relationships(), store.list_intents(states))):
        rows.write.mode("overwrite").json(f"{path}/{name}")


def dump(store: EntityStore, path: str) -> DataFrame:
    """Write the entities in a folder per kind; returns the manifest (kind, rows
    and bytes, and the totals as a row without a kind)."""
    rows = store.list_entities().withColumn("document", F.to_json(F.struct("*"))).select("kind", "id", "document")
    rows.write.mode("overwrite").partitionBy("kind").parquet(path)
    return rows.rollup("kind").agg(F.count("*").alias("n"), F.sum(F.octet_length("document")).alias("n_bytes"))


def first_source(*sources) -> DataFrame:
    """The rows of the first source (a function without arguments) that answers;
    the last one's error if none does."""
    for k, source in enumerate(sources):
        try:
            found = source()
            found.isEmpty()
            return found
        except (LookupError, ValueError, OSError, PySparkException):
            if k + 1 == len(sources):
                raise
    raise ValueError("no source was given")



#: The parts of an entity of which one is set, and kinds of relationships by name.
ARMS = ("platform", "antenna")
KINDS = {CONTAINS: "contains"}


def _grouped(store: EntityStore) -> DataFrame:
    """group and document of everything in the store: entities by the part that is
    set, relationships by kind, intents by whether they have a route."""
    arm = F.coalesce(*[F.when(F.col(a).isNotNull(), F.lit(f"entities_{a}")) for a in ARMS], F.lit("entities_unset"))
    kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(f"relationships_{n}")) for k, n in KINDS.items()], F.lit("relationships_other"))
    route = F.when(F.col("route").isNotNull(), "intents_route").otherwise("intents_unset")
    lists = ((store.list_entities(), arm), (store.list_relationships(), kind), (store.list_intents(), route))
    rows = [x.select(group.alias("group"), F.to_json(F.struct("*")).alias("document")) for x, group in lists]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def groups() -> list[str]:
    """All groups of a dump, known from the schema."""
    entities_ = [f"entities_{a}" for a in (*ARMS, "unset")]
    return [*entities_, *[f"relationships_{n}" for n in (*KINDS.values(), "other")], "intents_route", "intents_unset"]


def grouped_dump(store: EntityStore, path: str) -> DataFrame:
    """Write the store as text, a document a line, in a folder per group; returns the
    manifest (group, n, n_bytes, and the totals as a row without a group).

    The counts are gathered by the write itself (``observe``), so the store is read
    once and the manifest says what was written."""
    names = groups()
    mine = [F.col("group") == g for g in names]
    size = F.octet_length("document") + 1  # and the line's end
    sums = [F.count_if(m).alias(f"n{k}") for k, m in enumerate(mine)] + [F.sum(F.when(m, size)).alias(f"b{k}") for k, m in enumerate(mine)]
    seen = Observation()
    _grouped(store).observe(seen, *sums).write.mode("overwrite").partitionBy("group").text(path)
    found = seen.get
    rows = [(g, found[f"n{k}"], found[f"b{k}"] or 0) for k, g in enumerate(names) if found[f"n{k}"]]
    total = (None, sum(r[1] for r in rows), sum(r[2] for r in rows))
    return store.list_entities().sparkSession.createDataFrame([*rows, total], "group string, n long, n_bytes long")
