"""Versions with two times: from when a row holds, and when it was committed.

A version says: from ``valid`` on the entity has this value, known since
``committed``.  A later commit for the same entity and valid time replaces an
earlier one; so the state of an entity depends on the commit time that one reads
at.  Reads select on commit time, never on the time that is described.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def as_of(versions: DataFrame, commit_us: int, entity: str = "entity", valid: str = "valid_us", committed: str = "commit_us") -> DataFrame:
    """The timeline of each entity as known at a commit time: ``entity, valid_us,
    valid_to_us`` (null: for good), ``commit_us`` and the version's other columns.

    Of equal entity and valid time the last commit wins (of equal commits the
    greatest row).  One version meets another in partial maxima before the
    shuffle, so an entity of many corrections is few rows.
    """
    rest = [c for c in versions.columns if c not in (entity, valid, committed)]
    known = versions.where(F.col(committed) <= commit_us)
    last = known.groupBy(entity, valid).agg(F.max(F.struct(F.col(committed), *rest)).alias("_v"))
    until = F.lead(valid).over(Window.partitionBy(entity).orderBy(valid))
    return last.withColumn("valid_to_us", until).select(entity, valid, "valid_to_us", f"_v.{committed}", *[f"_v.{c}" for c in rest])


def changes(versions: DataFrame, from_us: int, to_us: int, entity: str = "entity", committed: str = "commit_us") -> DataFrame:
    """What a read of the commits in [from, to) returns: these versions, and of each
    entity the last one committed before them (``before`` is true)."""
    inside = versions.where((F.col(committed) >= from_us) & (F.col(committed) < to_us)).withColumn("before", F.lit(False))
    rest = [c for c in versions.columns if c not in (entity, committed)]
    last = versions.where(F.col(committed) < from_us).groupBy(entity).agg(F.max(F.struct(F.col(committed), *rest)).alias("_v"))
    first = last.select(*[entity if c == entity else F.col(f"_v.{c}").alias(c) for c in versions.columns], F.lit(True).alias("before"))
    return inside.unionByName(first)


def smallest_window(rows: DataFrame, group: str, committed: str, windows_s: list[int], now_us: int, sample: str = "id") -> DataFrame:
    """Per group the smallest window before ``now_us`` that holds a commit, the rows
    in it and the least ``sample`` among them; nulls and 0 where even the largest
    holds none.

    The ages are counted into all windows at once (partial counts that add up), so
    no window is probed by a scan of its own.
    """
    sizes = sorted(windows_s)
    age = F.lit(now_us) - F.col(committed)
    inside = lambda w: (age >= 0) & (age <= w * 1_000_000)
    aggs = [F.count_if(inside(w)).alias(f"n{w}") for w in sizes] + [F.min(F.when(inside(w), F.col(sample))).alias(f"s{w}") for w in sizes]
    counted = rows.groupBy(group).agg(*aggs)

    def first(value):
        return F.coalesce(*[F.when(F.col(f"n{w}") > 0, value(w)) for w in sizes])

    return counted.select(
        group, first(lambda w: F.lit(w)).cast("long").alias("window_s"),
        F.coalesce(first(lambda w: F.col(f"n{w}")), F.lit(0)).alias("n"), first(lambda w: F.col(f"s{w}")).alias("sample"),
    )


def read_windows(rows: DataFrame, chosen: DataFrame, group: str, committed: str, now_us: int) -> DataFrame:
    """The rows of each group's chosen window (a row for each group)."""
    age = F.lit(now_us) - F.col(committed)
    return rows.join(chosen.select(group, "window_s"), group).where((age >= 0) & (age <= F.col("window_s") * 1_000_000)).drop("window_s")


class _Versions(StatefulProcessor):
    """The last version known at the commit time, by valid time."""

    def __init__(self, entity: str, commit_us: int):
        self.entity, self.commit_us = entity, commit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getMapState("versions", "valid_us long", "commit_us long, value double")
        self.told = handle.getValueState("told", "told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = False
        for frame in rows:
            if key[0] is None:
                continue
            known = frame[frame["commit_us"] <= self.commit_us]
            # Of a batch only the last of each valid time meets the state.
            known = known.sort_values(["commit_us", "value"]).drop_duplicates("valid_us", keep="last")
            for valid, commit, value in zip(known["valid_us"], known["commit_us"], known["value"]):
                seen = True
                k = (int(valid),)
                old = self.versions.getValue(k)
                new = (int(commit), float(value))
                if old is None or tuple(old) < new:
                    self.versions.updateValue(k, new)
        if seen:
            self.handle.registerTimer(self.commit_us // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [] if self.told.exists() else sorted((k[0], v[0], v[1]) for k, v in self.versions.iterator())
        self.told.update((True,))
        until = [x[0] for x in held[1:]] + [None]
        out = [(key[0], v, u, c, x) for (v, c, x), u in zip(held, until)]
        self.versions.clear()
        frame = pd.DataFrame(out, columns=[self.entity, "valid_us", "valid_to_us", "commit_us", "value"])
        return iter([frame.astype({"valid_to_us": "Int64"})] if out else [])

    def close(self) -> None:
        pass


def stream_as_of(versions: DataFrame, commit_us: int, entity: str = "entity", time: str = "commit_ts", late: str = "10 minutes") -> DataFrame:
    """:func:`as_of` over a stream of ``entity, valid_us, commit_us, value`` (double,
    not null) and the commit time as a timestamp: an entity's rows come when the
    watermark of commits has passed the time asked for, since before that another
    commit may still arrive.  Late rows count until then."""
    kind = versions.schema[entity].dataType
    whole = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("valid_us", "commit_us")]
    rows = versions.withWatermark(time, late).select(F.col(entity).cast("string"), time, *whole, F.coalesce("value", F.lit(0.0)).alias("value"))
    found = rows.groupBy(entity).transformWithStateInPandas(
        statefulProcessor=_Versions(entity, commit_us), outputStructType=f"{entity} string, valid_us long, valid_to_us long, commit_us long, value double",
        outputMode="Append", timeMode="EventTime",
    )
    return found.withColumn(entity, F.col(entity).cast(kind))
