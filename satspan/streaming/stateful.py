"""Streams with state per key: contact segments, dumps that end in a tail, and
bi-temporal versions as of a commit time.

Each processor holds what may still change and settles it when the watermark has
passed it: no earlier row can come then, so results do not depend on how rows are
dealt to micro-batches, and a query that starts again from its checkpoint goes on
where it was.  Rows arrive in any order within the watermark's lateness; what is
settled leaves the state, so the state holds a lateness's rows per key, and what
an operator needs to go on (the open segment, the counts, the versions).

Rows with a null key move the watermark and are nothing else (heartbeats).  Keys
are strings inside, and columns are without nulls: the Python side would make
floats of whole numbers beside nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from satspan.sources.shared import new_folder

#: State that survives restarts and does not live on the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = 1) -> DataFrame:
    """The files of a folder, some in a micro-batch; with None all that are there."""
    read = spark.readStream.schema(schema)
    return (read if files_per_batch is None else read.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there, in as many micro-batches as the source makes of it,
    appending to ``out``."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(out)
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run_in_parts(rows: DataFrame, time: str, parts: int, late: str, label: str, make: Callable[[DataFrame], DataFrame], out: str) -> None:
    """Run ``make`` of a stream of ``rows`` that arrive in ``parts`` parts by time, and
    of a heartbeat far enough ahead that everything settles.

    A part is a micro-batch: it is written, in as many files as tasks write, and the
    query goes on from its checkpoint with what is there.  So no part comes before an
    earlier one: files of one write are found in the order of their last change,
    which is that of tasks' ends, and a later one's watermark would make the others late.
    """
    spark = rows.sparkSession
    folder, checkpoint = new_folder(spark, label), new_folder(spark, "checkpoint")
    at = F.unix_micros(time)
    cuts = sorted({int(x) for x in rows.select(at.cast("double").alias("at")).approxQuantile("at", [i / parts for i in range(1, parts)], 0.01)})
    low = lambda i: at.isNull() if i == 0 else F.lit(False)
    ranges = [low(i) | ((at > a if a is not None else F.lit(True)) & (at <= b if b is not None else F.lit(True))) for i, (a, b) in enumerate(zip([None, *cuts], [*cuts, None]))]
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != time]
    beat = rows.agg(F.max(time).alias(time)).select((F.col(time) + F.expr(f"INTERVAL {late}") + F.expr("INTERVAL 400 DAYS")).alias(time), *empty)
    for part in [*[rows.where(r) for r in ranges], beat.select(*rows.columns)]:
        part.write.mode("append").parquet(folder)
        run_available(make(file_stream(spark, folder, rows.schema, None)), out, checkpoint)


class _Segments(StatefulProcessor):
    """Starts of one terminal that may still change, and its open segment."""

    def __init__(self, unit: str, tail: int):
        self.unit, self.tail = unit, tail

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "starts array<bigint>")
        self.open = handle.getValueState("open", "t long, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is not None:
            new = {int(t) for frame in rows for t in frame["start_s"].unique()}
            if new:
                # A row of a key is one call each to the state; its starts are one value instead.
                self.waiting.update((sorted(new.union(self.waiting.get()[0] if self.waiting.exists() else ())),))
                # A start is settled when no row of its second can come any more.
                self.handle.registerTimer(min(new) * 1000 + 999)
        else:
            for _ in rows:
                pass
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        starts = list(self.waiting.get()[0]) if self.waiting.exists() else []
        settled = [t for t in starts if t * 1000 + 999 <= now]
        open_ = self.open.get() if self.open.exists() else None
        out = []
        for t in settled:
            if open_ is not None:
                out.append((key[0], open_[0], t, True))
            open_ = (t, False)
        if open_ is not None:
            if not open_[1] and (open_[0] + self.tail) * 1000 <= now:
                out.append((key[0], open_[0], open_[0] + self.tail, False))
                open_ = (open_[0], True)
            self.open.update(open_)
            if not open_[1]:
                self.handle.registerTimer((open_[0] + self.tail) * 1000)
        rest = starts[len(settled) :]
        if rest:
            self.waiting.update((rest,))
            self.handle.registerTimer(rest[0] * 1000 + 999)
        elif starts:
            self.waiting.clear()
        return iter([pd.DataFrame(out, columns=[self.unit, "t", "end_s", "settled"])] if out else [])

    def close(self) -> None:
        pass


def contact_segments(links: DataFrame, unit: str, time: str, late: str = "10 minutes", tail: int = 900) -> DataFrame:
    """Service segments of a stream of open-ended links: ``unit, t, end_s, settled``.

    A segment ends at its terminal's next start (``settled``).  One without a next
    start after ``tail`` seconds is closed by a timer (not settled); if a start
    comes after all, the settled row follows, and takes the other's place in
    :func:`timeline_of`.  Repeated starts of a second are one.
    """
    kind = links.schema[unit].dataType
    rows = links.withWatermark(time, late).select(F.col(unit).cast("string"), time, F.unix_timestamp(time).alias("start_s"))
    found = rows.groupBy(unit).transformWithStateInPandas(
        statefulProcessor=_Segments(unit, tail), outputStructType=f"{unit} string, t long, end_s long, settled boolean",
        outputMode="Append", timeMode="EventTime",
    )
    return found.withColumn(unit, F.col(unit).cast(kind))


def timeline_of(segments: DataFrame, unit: str, tail: int = 900) -> DataFrame:
    """The contact plan of the segments so far: a settled row goes before the
    timer's, and a terminal's last segment ends ``tail`` after the last start of all."""
    last = segments.agg(F.max("t").alias("_last"))  # one row
    best = segments.groupBy(unit, "t").agg(F.max(F.when(F.col("settled"), F.col("end_s"))).alias("_end"))
    return best.crossJoin(F.broadcast(last)).select(unit, "t", F.coalesce("_end", F.col("_last") + tail).alias("end_s"))


class _Dump(StatefulProcessor):
    """Counts of one group's dump and tail; rows that wait for the watermark."""

    def __init__(self, kind: str, window_ms: int, samples: int):
        self.kind, self.window_ms, self.samples = kind, window_ms, samples

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, n long")
        self.counts = handle.getValueState("counts", "n_dump long, n_tail long, ids array<bigint>")
        self.done = handle.getValueState("done", "us long")
        self.ended = handle.getValueState("ended", "ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if key[0] is None or self.ended.exists():
                continue
            marks = frame.loc[frame["is_mark"], "at_us"]
            if len(marks):
                at = int(marks.min())
                if not self.done.exists() or at < self.done.get()[0]:
                    self.done.update((at,))
            held = frame[~frame["is_mark"]].groupby(["at_us", "id"]).size()
            if len(held):  # one call to the state for all rows of the batch
                self.waiting.appendList([(int(us), int(i), int(n)) for (us, i), n in held.items()])
            low = int(frame["at_us"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if not self.ended.exists():
            now = timerValues.getCurrentWatermarkInMs()
            # A marker that is not there yet lies after the watermark, and so after all that settles now.
            done = self.done.get()[0] if self.done.exists() else None
            end = None if done is None else done + self.window_ms * 1000
            n_dump, n_tail, ids = self.counts.get() if self.counts.exists() else (0, 0, [])
            ids, later = list(ids), []
            held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
            for us, i, n in held:
                if us // 1000 + 1 > now:
                    later.append((us, i, n))
                elif done is None or us <= done:
                    n_dump += n
                elif us <= end:
                    n_tail += n
                    ids = sorted([*ids, *[i] * min(n, self.samples)])[: self.samples]
            rest = min((us for us, _, _ in later), default=None)
            if later:
                self.waiting.put(later)
            elif held:
                self.waiting.clear()
            self.counts.update((n_dump, n_tail, ids))
            if end is not None and end // 1000 + 1 <= now:
                self.ended.update((True,))
                out.append((key[0], done, n_dump, n_tail, ids))
            else:
                if end is not None:
                    self.handle.registerTimer(end // 1000 + 1)
                if rest is not None:
                    self.handle.registerTimer(rest // 1000 + 1)
        return iter([pd.DataFrame(out, columns=[self.kind, "complete_us", "n_dump", "n_tail", "sample_ids"])] if out else [])

    def close(self) -> None:
        pass


def dump_then_tail(events: DataFrame, time: str, kind: str, mark: str, seconds: int, late: str = "10 minutes", samples: int = 3) -> DataFrame:
    """Per group of a stream one row when its tail is over: ``complete_us`` (when
    its dump was complete, the first row with ``mark``), the rows of the dump
    (up to then) and those of the ``seconds`` after it, and the least ids of these.

    ``events(id, time, kind, mark)``; marks are no rows of the dump.  The stream
    finds the switch itself; a group without a mark stays in the dump.
    """
    name = events.schema[kind].dataType
    rows = events.withWatermark(time, late).select(F.col(kind).cast("string"), time, F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.unix_micros(time).alias("at_us"), F.coalesce(mark, F.lit(False)).alias("is_mark"))
    found = rows.groupBy(kind).transformWithStateInPandas(
        statefulProcessor=_Dump(kind, seconds * 1000, samples), outputStructType=f"{kind} string, complete_us long, n_dump long, n_tail long, sample_ids array<bigint>",
        outputMode="Append", timeMode="EventTime",
    )
    return found.withColumn(kind, F.col(kind).cast(name))


def dump_then_tail_batch(events: DataFrame, time: str, kind: str, mark: str, seconds: int, samples: int = 3) -> DataFrame:
    """The same over a table."""
    rows = events.where(F.col(kind).isNotNull()).select(kind, F.col("id").cast("long").alias("id"), F.unix_micros(time).alias("us"), F.coalesce(mark, F.lit(False)).alias("m"))
    done = rows.where("m").groupBy(kind).agg(F.min("us").alias("complete_us"))  # a row for each group
    at = rows.where("NOT m").join(done, kind)
    tail = (F.col("us") > F.col("complete_us")) & (F.col("us") <= F.col("complete_us") + seconds * 1_000_000)
    counts = at.groupBy(kind).agg(F.count_if(F.col("us") <= F.col("complete_us")).alias("n_dump"), F.count_if(tail).alias("n_tail"))
    place = F.row_number().over(Window.partitionBy(kind).orderBy("id"))
    ids = at.where(tail).select(kind, "id").withColumn("place", place).where(F.col("place") <= samples).groupBy(kind).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return done.join(counts, kind, "left").join(ids, kind, "left").select(
        kind, "complete_us", F.coalesce("n_dump", F.lit(0)).alias("n_dump"), F.coalesce("n_tail", F.lit(0)).alias("n_tail"),
        F.coalesce("ids", F.array().cast("array<bigint>")).alias("sample_ids"),
    )


def run_until(stream: DataFrame, out: str, checkpoint: str, groups: int, kind: str, timeout_s: float = 300.0) -> int:
    """Run a stream of one row per group until it has told of ``groups`` groups, then
    end it; the count comes from the stream's own metrics (``observe``), so
    nothing is read for it.  Returns the groups told of."""
    import time as clock

    spark = stream.sparkSession
    counted = stream.observe("told", F.count(F.col(kind)).alias("n"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    query = counted.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start(out)
    told: dict[int, int] = {}
    end = clock.time() + timeout_s
    try:
        while query.isActive and clock.time() < end:
            for p in query.recentProgress:
                metrics = p.observedMetrics.get("told") if hasattr(p, "observedMetrics") else None
                if metrics is not None:
                    told[p.batchId] = metrics["n"]
            if sum(told.values()) >= groups:
                break
            clock.sleep(0.2)
    finally:
        query.stop()
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return sum(told.values())
