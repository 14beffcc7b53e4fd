"""Change rates of an event stream, and open-ended sessions closed by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def change_rate(events: DataFrame, time: str, kind: str, window: str = "12 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and kind; works on streams and tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    seconds = F.window(time, window)
    return rows.groupBy(seconds.alias("w"), kind).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n"
    )


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process what is there and return the result table."""
    query = (
        stream.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)


def snapshot_then_tail(events: DataFrame, complete_at: str, time: str, kind: str, seconds: int, samples: int = 3) -> DataFrame:
    """Per kind the rows of the first dump (up to its completion), those of the
    ``seconds`` after it, their rate, and the least ids of these."""
    done = F.lit(complete_at).cast("timestamp")
    tail = (F.col(time) > done) & (F.col(time) <= done + F.make_dt_interval(secs=F.lit(seconds)))
    counts = events.groupBy(kind).agg(F.count_if(F.col(time) <= done).alias("n_dump"), F.count_if(tail).alias("n_tail"))
    place = F.row_number().over(Window.partitionBy(kind).orderBy("id"))
    first = events.where(tail).select(kind, "id").withColumn("_place", place).where(F.col("_place") <= samples)  # cut before the shuffle too
    ids = first.groupBy(kind).agg(F.array_sort(F.collect_list("id")).alias("sample_ids"))
    return counts.join(ids, kind, "left").withColumn("rate_per_s", F.col("n_tail") / F.lit(float(seconds)))


def described_and_committed(events: DataFrame, described: str, committed: str, window: str, late: str = "10 minutes") -> DataFrame:
    """Counts by the time that rows describe, and how far their commits lag at most;
    on a stream the watermark is that of the described time."""
    rows = events.withWatermark(described, late) if events.isStreaming else events
    lag = F.unix_micros(F.col(committed).cast("timestamp")) - F.unix_micros(F.col(described).cast("timestamp"))
    return rows.groupBy(F.window(described, window).alias("w")).agg(F.count("*").alias("n"), (F.max(lag) / 1e6).alias("max_lag_s")).select("w.start", "w.end", "n", "max_lag_s")


def accumulate(stream: DataFrame, merge, path: str, checkpoint: str) -> None:
    """Each micro-batch (a bucket or a few) is reduced by ``merge`` and written as a
    folder of its own under its number, so a batch that runs again replaces itself
    and memory holds one batch."""

    def one(batch: DataFrame, number: int) -> None:
        merge(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
