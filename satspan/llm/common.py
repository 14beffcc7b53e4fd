"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts: the six ASCII blanks.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Where a session on one machine names none (a test run) a temporary folder is
    set; on a cluster that is an error, since executors would not see each
    other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-satspan-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    survives lost executors and runs what stands above only once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/satspan/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Array of the words of a text (null or blank: no words)."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    none = F.array().cast("array<string>")
    return F.when(inner == "", none).otherwise(F.split(inner, f"{BLANK}+"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only (null stays null)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Ids that are broadcast at most: 8 bytes each, so 16 MB.
BROADCAST_IDS = 2_000_000


def filter_by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id is (left_semi) or is not (left_anti) among
    ``ids``. The ids are broadcast if counted to be few, else joined by shuffle."""
    ids = materialize(ids, "ids")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def global_rank(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """``df`` with ``rank`` (from 0 in ``order``) and ``n_rows``.

    A range shuffle deals the rows out in order; a row's rank is its place in
    its partition plus the rows of the partitions before. Only one row per
    partition meets in one task or is broadcast.
    """
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    # The id holds the partition in its upper bits and the row's place below.
    dealt = materialize(dealt.withColumn("place", F.monotonically_increasing_id()), label).withColumns({
        "part": F.shiftright("place", 33),
        "place": F.col("place").bitwiseAND(F.lit((1 << 33) - 1)),
    })
    parts = dealt.groupBy("part").agg((F.max("place") + 1).alias("n_part"))
    offsets = parts.select(
        "part",
        (F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part")).alias("offset"),
        F.sum("n_part").over(Window.partitionBy()).alias("n_rows"),
    )
    return (
        dealt.join(F.broadcast(offsets), "part")
        .withColumn("rank", F.col("offset") + F.col("place"))
        .drop("part", "place", "offset")
    )
