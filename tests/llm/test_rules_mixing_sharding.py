from collections import Counter

import pytest
from pyspark.sql import functions as F

from satspan.llm import hilbert_sharding, quality_rules, source_mixing

from .helpers import WORD, documents, empty, prose, texts


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    seen = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    covered = {i + k for i in range(n - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_quality_measures_match_brute_force(spark):
    rows = quality_rules.score(documents(spark)).collect()
    assert len(rows) == len(texts()) + 1
    for r in rows:
        want = measures(texts()[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_keep_returns_rows_as_they_are(spark):
    docs = documents(spark)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted(r["doc_id"] for r in quality_rules.score(docs).where("kept").collect())
    assert ids.count(0) == 2 and 3 not in ids and 11 not in ids
    assert quality_rules.keep(empty(spark)).count() == 0


def test_quality_plan_has_no_user_function(spark):
    plan = quality_rules.keep(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def water(sizes, share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    target, open_ = {}, set(sizes)
    while True:
        left = total - sum(target.values())
        unit = left / max(1e-12, sum(weight[s] for s in open_)) if open_ else 0
        over = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in open_}
        target |= {s: 2 * sizes[s] for s in over}
        open_ -= over


@pytest.mark.parametrize("n", [3, 40, 200])
def test_mixing_targets_and_takes(spark, n):
    docs = documents(spark, [prose(i, 5 + (i * 37) % 90) for i in range(n)])
    rows = source_mixing.plan(docs).collect()
    again = source_mixing.plan(docs.repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    want = water(dict(sizes))
    taken = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_mixing_edges(spark):
    assert source_mixing.plan(empty(spark)).count() == 0
    assert source_mixing.mix(empty(spark)).count() == 0
    rows = source_mixing.plan(documents(spark, [None, "", "a b c"])).collect()
    assert len(rows) == 4 and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    docs = documents(spark)
    assert source_mixing.mix(docs).columns == docs.columns


def test_mix_of_rows_that_share_an_id(spark):
    rows = [(str(i % 5) if i % 7 else None, prose(i, 20 + i % 30), f"s{i % 3}", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, order int")
    taken = {r["source"]: r["t"] for r in source_mixing.plan(docs).groupBy("source").agg(F.max("target").alias("t")).collect()}
    mixed = source_mixing.mix(docs)
    assert mixed.columns == docs.columns
    got, times = Counter(), Counter()
    for r in mixed.collect():
        got[r["source"]] += len(r["text"].split())
        times[r["order"]] += 1
    assert all(abs(got[s] - t) <= 60 for s, t in taken.items()) and max(times.values()) <= 2
    named = docs.withColumnRenamed("doc_id", "x").withColumn("doc_id", F.concat(F.lit("é"), "x")).withColumn("lang", F.lit(None).cast("string"))
    assert hilbert_sharding.plan(named).count() == quality_rules.score(named).count() == 300


def test_hilbert_curve_visits_neighbours(spark):
    n = 8
    cells = spark.range(n**3).select(
        (F.col("id") % n).alias("x"), (F.floor(F.col("id") / n) % n).alias("y"), F.floor(F.col("id") / n**2).alias("z")
    )
    rows = cells.withColumn("h", hilbert_sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(n**3))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("n", [5, 39, 40, 203])
def test_sharding_is_even_and_gapless(spark, n):
    docs = documents(spark, [prose(i, 3 + i % 50) if i % 9 else None for i in range(n)])
    rows = hilbert_sharding.plan(docs).collect()
    assert len(rows) == n + 1
    shards = Counter(r["shard"] for r in rows)
    counts = [shards[s] for s in range(40)]
    assert sum(counts) == n + 1 and max(counts) - min(counts) <= 1
    for s in shards:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(shards[s]))
    again = {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in hilbert_sharding.plan(docs.repartition(2)).collect()}
    assert again == {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in rows}
    assert hilbert_sharding.plan(empty(spark)).count() == 0


def test_equal_texts_stay_together(spark):
    import itertools
    import random

    r = random.Random(11)
    rows = [(i, t, r.choice(["en", "de", None]), f"s{r.randrange(9)}", "x") for i, t in enumerate(
        [prose(k % 150, 3 + k % 40) for k in range(700)] + ["one hot text"] * 160 + [None, ""] * 4
    )]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string")
    out = hilbert_sharding.plan(docs, carry=True).collect()
    assert sorted((x["doc_id"], x["text"]) for x in out) == sorted(x[:2] for x in rows)
    counts = Counter(x["shard"] for x in out)
    assert len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1
    # by brute force: copies follow each other, and cuts split a text only where they must
    ordered = [x["text"] or "" for x in sorted(out, key=lambda x: x["rank"])]
    assert len([k for k, _ in itertools.groupby(ordered)]) == len(set(ordered))
    shards_of = {}
    for x in out:
        shards_of.setdefault(x["text"] or "", set()).add(x["shard"])
    split = sum(len(s) - 1 for s in shards_of.values())
    starts = {k for k in range(1, len(ordered)) if ordered[k] != ordered[k - 1]}
    least, big = divmod(len(ordered), 40)
    best = {0: 0}
    for j in range(1, 40):
        best = {k: max(best[m] for m in (k, k - 1) if m in best) + (j * least + k in starts) for k in range(0, big + 1) if (k in best or k - 1 in best) and big - k <= 40 - j}
    assert split == 39 - max(best.values()) and split <= 39


def test_rows_without_an_id(spark):
    from satspan.llm import license_index, secret_crf, setsketch_dedup

    row = (None, prose(1, 120), None, None, None, None, None, None, None)
    docs = documents(spark).unionByName(spark.createDataFrame([row, row], documents(spark).schema))
    n = len(texts()) + 3
    assert quality_rules.score(docs).count() == source_mixing.plan(docs).count() == hilbert_sharding.plan(docs).count() == n
    assert license_index.scan(docs).count() == secret_crf.scan(docs).count() == n
    judged = setsketch_dedup.score(docs).collect()
    assert len(judged) == n and all(r["kept"] for r in judged if r["doc_id"] is None)
