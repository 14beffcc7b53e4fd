"""Streams with state against their batch forms, over several batches and a restart."""

import random

import pytest
from pyspark.sql import functions as F

from satspan.operators import bitemporal
from satspan.operators.continuity import timeline
from satspan.streaming import stateful


def put(rows, folder):
    rows.coalesce(1).write.mode("append").parquet(folder)


def as_set(df, *columns):
    return sorted(tuple(None if r[c] is None else (tuple(r[c]) if isinstance(r[c], list) else r[c]) for c in columns) for r in df.collect())


def in_steps(spark, chunks, schema, folder, make, out, checkpoint):
    """Each chunk arrives, and the query starts again from its checkpoint."""
    for chunk in chunks:
        put(spark.createDataFrame(chunk, schema).withColumn("ts", F.timestamp_millis("ms")), folder)
        stateful.run_available(make(stateful.file_stream(spark, folder, spark.read.parquet(folder).schema)), out, checkpoint)
    return spark.read.parquet(out)


def test_segments_equal_the_batch_timeline(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", "c"]), 1_000_000 + r.randrange(6_000_000)) for _ in range(150)]
    rows += [("once", 2_000_000), ("once", 2_000_000), ("late", 5_900_000)]
    by_time = sorted(rows, key=lambda x: x[1] + r.randrange(240_000))  # out of order within the lateness
    chunks = [by_time[:40], by_time[40:90], by_time[90:], [(None, 20_000_000)]]
    make = lambda s: stateful.contact_segments(s, "unit", "ts", "5 minutes")
    got = in_steps(spark, chunks, "unit string, ms long", str(tmp_path / "in"), make, str(tmp_path / "out"), str(tmp_path / "cp"))
    links = spark.createDataFrame(rows, "unit string, ms long").select("unit", F.floor(F.col("ms") / 1000).alias("t")).distinct()
    want = timeline(links, "unit", "t").select("unit", "t", "end_s")
    assert as_set(stateful.timeline_of(got, "unit"), "unit", "t", "end_s") == as_set(want, "unit", "t", "end_s")
    # the timer's rows: those whose next start was more than 900 s away, or never came
    timer = as_set(got.where("NOT settled"), "unit", "t", "end_s")
    far = as_set(want.join(got.groupBy("unit").agg(F.max("t").alias("last")), "unit").where("t = last OR end_s - t > 900 + 300"), "unit", "t")
    assert {x[:2] for x in timer} >= set(far) and all(e == t + 900 for _, t, e in timer)
    assert got.where("settled").groupBy("unit", "t").count().where("count > 1").isEmpty()


def test_dump_and_tail_equal_the_batch_form(spark, tmp_path):
    r = random.Random(2)
    rows = [(k, r.randrange(3_000_000), i, False) for i, k in enumerate(r.choice("xyz") for _ in range(300))]
    rows += [("x", 1_000_000, -1, True), ("x", 1_400_000, -1, True), ("y", 2_000_500, -2, True)]  # z stays in its dump
    rows = sorted(rows, key=lambda x: x[1] + r.randrange(100_000))
    chunks = [rows[:100], rows[100:210], rows[210:], [(None, 90_000_000, None, None)]]
    make = lambda s: stateful.dump_then_tail(s, "ts", "kind", "mark", 600, "3 minutes")
    got = in_steps(spark, chunks, "kind string, ms long, id long, mark boolean", str(tmp_path / "in"), make, str(tmp_path / "out"), str(tmp_path / "cp"))
    table = spark.createDataFrame(rows, "kind string, ms long, id long, mark boolean").withColumn("ts", F.timestamp_millis("ms"))
    columns = ("kind", "complete_us", "n_dump", "n_tail", "sample_ids")
    assert as_set(got, *columns) == as_set(stateful.dump_then_tail_batch(table, "ts", "kind", "mark", 600), *columns)
    inside = sorted(i for k, ms, i, m in rows if k == "x" and not m and 1_000_000 < ms <= 1_600_000)
    assert {x[0]: x for x in as_set(got, *columns)}["x"][1:] == (1_000_000_000, sum(k == "x" and not m and ms <= 1_000_000 for k, ms, _, m in rows), len(inside), tuple(inside[:3]))


def test_tail_ends_by_its_own_metrics(spark, tmp_path):
    rows = [("x", 1_000_000 + 1000 * i, i, i == 5) for i in range(40)] + [(None, 90_000_000, None, None)]
    table = spark.createDataFrame(rows, "kind string, ms long, id long, mark boolean").withColumn("ts", F.timestamp_millis("ms"))
    put(table, str(tmp_path / "in"))
    stream = stateful.dump_then_tail(stateful.file_stream(spark, str(tmp_path / "in"), table.schema), "ts", "kind", "mark", 10, "1 second")
    assert stateful.run_until(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 1, "kind", 120) == 1
    assert as_set(spark.read.parquet(str(tmp_path / "out")), "n_dump", "n_tail") == [(5, 10)]


def versions(seed, n):
    r = random.Random(seed)
    return [(r.choice("pq"), r.randrange(20) * 1_000_000, 1_000_000 + r.randrange(4_000_000), float(r.randrange(9))) for _ in range(n)]


def known(rows, at_ms):
    """By hand: entity and valid time to the last commit at most ``at_ms``."""
    best = {}
    for e, v, ms, x in rows:
        if ms <= at_ms:
            best[e, v] = max(best.get((e, v), (-1, 0)), (ms * 1000, x))
    out = []
    for (e, v), (c, x) in sorted(best.items()):
        later = [w for f, w in best if f == e and w > v]
        out.append((e, v, min(later, default=None), c, x))
    return sorted(out)


COLUMNS = ("entity", "valid_us", "valid_to_us", "commit_us", "value")


def test_as_of_a_commit_time(spark):
    rows = versions(3, 200)
    table = spark.createDataFrame([(e, v, ms * 1000, x) for e, v, ms, x in rows], "entity string, valid_us long, commit_us long, value double")
    for at in (0, 2_500_000, 9_000_000):
        assert as_set(bitemporal.as_of(table, at * 1000), *COLUMNS) == known(rows, at)
    a, b = 2_000_000, 3_000_000
    got = as_set(bitemporal.changes(table, a * 1000, b * 1000), "entity", "commit_us", "before")
    inside = [(e, ms * 1000, False) for e, _, ms, _ in rows if a <= ms < b]
    last = [(k, max(ms for e, _, ms, _ in rows if e == k and ms < a) * 1000, True) for k in "pq"]
    assert got == sorted(inside + last)


def test_as_of_waits_for_the_watermark_and_counts_late_rows(spark, tmp_path):
    rows = versions(4, 120)
    r = random.Random(4)
    order = sorted(rows, key=lambda x: x[2] + r.randrange(250_000))
    schema = "entity string, valid_us long, ms long, value double"
    at, folder, out = 3_000_000, str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda s: bitemporal.stream_as_of(s.withColumn("commit_us", F.col("ms") * 1000), at * 1000, "entity", "ts", "5 minutes")
    early = [x for x in order if x[2] < 3_200_000]
    got = in_steps(spark, [early[:50], early[50:]], schema, folder, make, out, str(tmp_path / "cp"))
    assert got.count() == 0  # the watermark is 3,200 s less 5 minutes: another commit may come
    late = [("p", 500, at, 99.0)]
    rest = [x for x in order if x[2] >= 3_200_000]
    got = in_steps(spark, [late, rest, [(None, 0, 90_000_000, 0.0)]], schema, folder, make, out, str(tmp_path / "cp"))
    assert as_set(got, *COLUMNS) == known(rows + late, at)


def test_session_without_a_shared_folder(spark):
    from satspan.sources import shared

    assert shared.new_folder(spark, "x").startswith(shared.shared_dir(spark))
    with pytest.raises(ValueError):

        class Far:
            conf = type("C", (), {"get": staticmethod(lambda *a: None)})
            sparkContext = type("S", (), {"master": "spark://x"})

        shared.shared_dir(Far)
