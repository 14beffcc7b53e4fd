"""Brace-delimited blocks of text dumps, whatever the size of the file.

Spark's reader deals a file out in byte ranges.  In each range the opening and
closing braces of every piece of text are counted (not those in quotes or
comments), and the depth before a range is the sum of the ranges before it: a
prefix sum with one row a range.  With the depth known everywhere, a block ends
where it comes back to zero, so blocks may begin in one range and end in another,
several may stand on a line, and braces may nest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A quoted string or a comment: braces in these do not count.
_QUIET = r'"(?:[^"\\]|\\.)*+"|#[^\n]*+'
#: Text up to and with the next closing brace that counts.
_PIECE = rf'(?:{_QUIET}|[^"#}}]++|")*+\}}?'


def _before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all earlier pieces of the file."""
    inside = Window.partitionBy("path", "range").orderBy("line", "piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("path", "range").agg(F.sum(value).alias("_total"))  # a row for each range
    earlier = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("path", "range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    return rows.join(offsets, ["path", "range"]).withColumn(name, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_offset")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """``path, block`` (its number in the file, from 0) and ``text`` of every block,
    from what opens it (after the last one's end, blank lines left out) to its
    closing brace.  Text after the last block is left out; a file in which a brace
    closes nothing is an error.  A block is put together in one row."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("line"), "value",
    )
    cut = F.filter(F.regexp_extract_all("value", F.lit(_PIECE), F.lit(0)), lambda x: x != "")
    pieces = lines.select("path", "range", "line", F.posexplode_outer(cut).alias("piece", "part"), F.size(cut).alias("_n"))
    loud = F.regexp_replace(F.coalesce("part", F.lit("")), _QUIET, "")
    count = lambda brace: F.length(loud) - F.length(F.replace(loud, F.lit(brace), F.lit("")))
    whole = F.concat(F.coalesce("part", F.lit("")), F.when(F.coalesce("piece", F.lit(0)) + 1 >= F.col("_n"), "\n").otherwise(""))
    rows = pieces.select(
        "path", "range", "line", F.coalesce("piece", F.lit(0)).alias("piece"), whole.alias("part"), (count("{") - count("}")).alias("_step"), (count("}") > 0).alias("_closes")
    )
    deep = _before(rows, "_step", "_depth")
    after = F.col("_depth") + F.col("_step")
    checked = F.when(after < 0, F.raise_error(F.concat(F.lit("a brace closes nothing in "), F.col("path"))).cast("int")).otherwise(F.when(F.col("_closes") & (after == 0), 1).otherwise(0))
    numbered = _before(deep.withColumn("_ends", checked), "_ends", "block")
    order = F.struct("range", "line", "piece", "part", "_ends")
    whole_blocks = numbered.groupBy("path", "block").agg(F.array_sort(F.collect_list(order)).alias("_p"))
    # A piece that ends a block leaves the rest of its line to the next one.
    text = F.array_join(F.transform("_p", lambda x: x["part"]), "")
    return whole_blocks.where(F.exists("_p", lambda x: x["_ends"] == 1)).select("path", "block", F.btrim(text, F.lit(" \t\r\n")).alias("text"))


def entity_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``body, id, a, z`` of the entity blocks of a dump."""
    field = lambda p: F.regexp_extract("body", p, 1)
    opening = r"^(?:#[^\n]*\n\s*)*entity\s*\{\n?"  # comments may stand before it
    rows = blocks(spark, path).where(F.col("text").rlike(opening))
    inner = F.regexp_replace(F.regexp_replace("text", opening, ""), r"\n?\}\s*$", "")
    return rows.select(inner.alias("body")).select(
        "body", field(r'(?m)^  id: "([^"]+)"').alias("id"), field(r'\ba: "([^"]+)"').alias("a"), field(r'\bz: "([^"]+)"').alias("z")
    )
