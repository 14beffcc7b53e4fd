"""Sharding by a Hilbert curve over quantised metadata.

Language, source and length are quantised to a few bits each, the cell's index
on a Hilbert curve orders the rows, and the order is cut into runs whose row
counts differ by one at most (law ``rows``).  Neighbours on the curve share
ranges of every dimension, so files cut this way can be pruned on any of them.

Rows with equal texts take the least curve index among them, so they follow each
other, and each cut is moved to a place between two texts where the law leaves a
choice; a group is in two shards only where no such place is near, and in more
only if it is larger than a shard.  So no more groups are split than there are
cuts.

The order is total (curve index, text checksum and hash, id), a range shuffle
deals it out, and a row's rank is its place in its partition plus the rows of the
partitions before it; only one row per partition meets in one task, and the rows
near the cuts (the square of the shards at most, without their texts) meet on
the driver.

Defined results: null text has 16 bytes and the checksum of an empty text; null
dimensions quantise to cell 0; repeated rows take slots of their own; ids may be
null and of any type; an empty table gives an empty result; with ``carry`` a
column of the input that has an output's name gives way.  The distinct languages
and sources (a row each) meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satspan.llm.common import BROADCAST_IDS, global_rank, materialize

SHARDS = 40
BITS = 6


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Index of the cell ``axes`` (each below 2**bits) on the Hilbert curve,
    as a long: the published axes-to-transpose steps as one array fold."""
    n = len(axes)
    state = F.array(*[a.cast("long") for a in axes])
    steps = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    # A fold over the step numbers keeps the expression small.
    numbers = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q, i in steps])

    def fold(x: Column, s: Column) -> Column:
        p = s["q"] - 1
        own = F.element_at(x, s["i"] + 1)
        high = own.bitwiseAND(s["q"]) != 0
        t = x[0].bitwiseXOR(own).bitwiseAND(p)
        return F.transform(
            x,
            lambda v, k: F.when(k == 0, F.when(high, v.bitwiseXOR(p)).otherwise(v.bitwiseXOR(t)))
            .when((k == s["i"]) & ~high, v.bitwiseXOR(t))
            .otherwise(v),
        )

    folded = F.aggregate(numbers, state, fold)
    grayed = F.aggregate(
        folded,
        F.array().cast("array<bigint>"),
        lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), zero).bitwiseXOR(v))),
    )

    def finish(x: Column) -> Column:
        last = F.element_at(x, -1)
        t = zero
        for b in range(bits - 1, 0, -1):
            q = 1 << b
            t = t.bitwiseXOR(F.when(last.bitwiseAND(F.lit(q)) != 0, F.lit(q - 1).cast("long")).otherwise(zero))
        spread = zero
        for i in range(n):
            own = x[i].bitwiseXOR(t)
            for b in range(bits):
                bit = F.shiftright(own, b).bitwiseAND(one)
                spread = spread.bitwiseOR(F.shiftleft(bit, b * n + (n - 1 - i)))
        return spread

    # transform over a one-element array binds the array to a name once
    return F.element_at(F.transform(F.array(grayed), finish), 1)


def _cell_of(values: DataFrame, name: str, bits: int) -> DataFrame:
    """Each distinct value's place in order, spread over 2**bits cells."""
    n = F.count("*").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.col(name).asc_nulls_first())) - 1
    return values.select(F.col(name).alias(f"{name}_value"), F.floor(place * (1 << bits) / n).alias(f"{name}_cell"))


OWN = ["doc_id", "lang", "source", "size", "text_crc32", "curve", "rank", "shard", "slot"]
_TEXT = ["text_crc32", "text_hash", "size"]


def _cuts(near: dict[int, bool], n_rows: int, shards: int) -> list[int]:
    """The ranks at which shards begin (but for the first): counts are the least or
    one more, and as many cuts as can be stand where ``near`` says that a new text
    begins.  ``best[j]`` holds, for each number of larger shards so far, the most
    such cuts and the way there."""
    least, big = divmod(n_rows, shards)
    best = {0: (0, ())}
    for j in range(1, shards):
        step: dict[int, tuple[int, tuple[int, ...]]] = {}
        for more, (hits, way) in best.items():
            for one in (0, 1):
                k = more + one
                if k > big or big - k > shards - j:
                    continue
                at = j * least + k
                found = (hits + bool(near.get(at)), way + (at,))
                if k not in step or found[0] > step[k][0]:
                    step[k] = found
        best = step
    return list(max(best.values(), key=lambda x: x[0])[1]) if best else []


def plan(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, carry: bool = False) -> DataFrame:
    """Per row: doc_id, lang, source, size, text_crc32, curve index, rank,
    shard and slot; with ``carry`` also the other columns of ``docs``, first."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = [
        "doc_id", "lang", "source",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
    ]
    carried = [c for c in docs.columns if c not in OWN] if carry else []
    rows = materialize(docs.select(*narrow), "sharding")
    pairs = rows.groupBy("lang", "source").agg(F.count("*").alias("row_count"))
    langs = _cell_of(pairs.select("lang").distinct(), "lang", bits)
    sources = _cell_of(pairs.select("source").distinct(), "source", bits)
    cells = (
        pairs.join(langs, F.col("lang").eqNullSafe(F.col("lang_value")))
        .join(sources, F.col("source").eqNullSafe(F.col("source_value")))
        .select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "lang_cell", "source_cell")
    )
    length_cell = F.least(F.floor(F.log2("size") * 2), F.lit((1 << bits) - 1))

    def with_curve(x: DataFrame) -> DataFrame:
        joined = x.join(cells, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))
        index = hilbert_index([F.col("lang_cell"), F.col("source_cell"), length_cell], bits)
        return joined.withColumn("curve", index).drop("_lang", "_source", "lang_cell", "source_cell")

    # Texts whose copies lie in different cells go to the least of these.
    spread = with_curve(rows).groupBy(*_TEXT).agg(F.min("curve").alias("least"), F.max("curve").alias("most")).where("least < most")
    spread = materialize(spread.select(*_TEXT, "least"), "sharding-copies")
    few = spread.count() <= BROADCAST_IDS
    whole = docs.select(*narrow, F.struct(*carried).alias("carried")) if carried else rows
    placed = with_curve(whole).join(F.broadcast(spread) if few else spread, _TEXT, "left")
    placed = placed.withColumn("curve", F.coalesce("least", "curve")).drop("least")
    dealt = global_rank(placed, ["curve", *_TEXT, "doc_id"], "sharding-order")
    n_rows = rows.count()
    near = [j * (n_rows // shards) + k for j in range(1, shards) for k in range(-1, min(j, n_rows % shards) + 1)]
    texts = {r["rank"]: r[1:] for r in dealt.where(F.col("rank").isin(near)).select("rank", *_TEXT).collect()} if near and n_rows else {}
    cuts = _cuts({k: texts[k] != texts.get(k - 1) for k in texts}, n_rows, shards)
    starts = F.array(*[F.lit(c).cast("long") for c in [0, *cuts]])
    dealt = dealt.withColumn("shard", (F.size(F.filter(starts, lambda c: c <= F.col("rank"))) - 1).cast("int"))
    dealt = dealt.withColumn("slot", F.col("rank") - F.element_at(starts, F.col("shard") + 1))
    return dealt.select(*[F.col(f"carried.{c}").alias(c) for c in carried], *OWN)
