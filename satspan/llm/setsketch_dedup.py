"""Near-duplicate detection with SetSketch registers.

A document's set are the hashes of its distinct five-word shingles.  Each
element draws a seeded Poisson stream of points; a register keeps the least
point that falls on it, stored as an exponentially spaced level
``floor(1 - log_b x)``, truncated at both ends.  Registers of a union are the
element-wise maxima, and equal registers become likelier with the Jaccard
similarity, so bands of registers find candidates, the joint likelihood of
"above, below, equal" estimates their similarity, and the surviving pairs are
confirmed on the full sets.

Work on groups stays linear: equal sets are one class from the start, a bucket
links its members to one leader first, and only members of buckets that are not
yet one component are compared with those of other components, by an exact
prefix filter on their rarest shingles.

Defined results: null, empty and blank texts have an empty set and are linked
with nothing; a text of one to four words has one shingle, its whole sequence;
repeated rows are copies; ids may be of any type, and an id that occurs with
different texts names a row of each: ``score`` judges each by its own text,
``keep`` leaves one row of each group and thus no text without a near copy; rows
without an id are kept and link nothing; an empty table gives an empty result;
extra columns are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satspan.llm.common import BROADCAST_IDS, global_rank, materialize
from satspan.llm.components import components
from satspan.llm.textbytes import U, mix, pieces, shingle_sets

REGISTERS = 256
BASE = 1.001
#: 51 bands of 5 registers: a pair at 0.75 shares none with probability 1e-6.
ROWS = 5
BANDS = REGISTERS // ROWS
LEVELS = 1 << 15
SIMILARITY = 0.75
#: Candidates below this estimate are dropped; it lies 5.5 standard errors
#: (0.027 at 0.75) under the threshold.
LEAST_ESTIMATE = 0.60
#: Bytes of text that are worked on at once.
PIECE = 1_000_000
#: Classes that are broadcast at most, of about 100 bytes each.
BROADCAST_CLASSES = 100_000


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Levels (int16) of each set's registers, one row per set."""
    n = np.array([len(s) for s in sets])
    least = np.full(len(sets) * REGISTERS, np.inf)
    if n.sum():
        item = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)) * REGISTERS, n)
        # Points beyond this are needed with probability exp(-9) per set; a
        # register without a point is truncated to level 0.
        bound = np.repeat((np.log(REGISTERS) + 9) / np.maximum(n, 1), n)
        x = np.zeros(len(item))
        turn = 0
        while len(item):
            turn = (turn + 0xD1B54A32D192ED03) % (1 << 64)
            r = mix(item + U(turn))
            x = x - np.log(((r >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / REGISTERS
            live = x <= bound
            item, row, bound, x, r = item[live], row[live], bound[live], x[live], r[live]
            np.minimum.at(least, row + (r & U(REGISTERS - 1)).astype(np.int64), x)
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least) / np.log(BASE)) + LEVELS // 2
    return np.clip(np.where(np.isinf(least), 0, level), 0, LEVELS - 1).astype(np.int16).reshape(-1, REGISTERS)


def band_keys(levels: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    parts = levels[:, : BANDS * ROWS].reshape(len(levels), BANDS, ROWS).astype(U)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U)), parts.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key ^ parts[:, :, j]) + U(j)
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of register rows whose set sizes are known."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - above - below
    top = np.minimum(u / v, v / u)

    def share(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = share(u - v * j), share(v - u * j)
        return above * np.log(p) + below * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(len(u)), top
    for _ in range(30):  # the likelihood has one peak: ternary search
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def _set_key(s: np.ndarray) -> str | None:
    """Sums of two finalised hashes name the set."""
    return f"{int(mix(s).sum()):016x}{int(mix(s ^ U(0x5851F42D4C957F2D)).sum()):016x}" if len(s) else None


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            sets = shingle_sets(part.column(1))
            levels = registers(sets)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_key(s) for s in sets], pa.string()),
                 pa.array([x.tobytes() for x in levels], pa.binary())],
                ["doc_id", "text_key", "n_shingles", "set_key", "levels"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            sets = [s for s in shingle_sets(part.column(0)) if len(s)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, U), *sets]).view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in sets], pa.string()), items], ["set_key", "items"])


def _banded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for at in range(0, len(f), 2000):
            g = f.iloc[at : at + 2000]
            levels = np.frombuffer(b"".join(g["levels"]), dtype=np.int16).reshape(-1, REGISTERS)
            yield pd.DataFrame({
                "band": band_keys(levels).reshape(-1),
                "id": np.repeat(g["id"].to_numpy(), BANDS),
                "n": np.repeat(g["n"].to_numpy(), BANDS),
            })


def _likely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        if len(f):
            a, b = (np.frombuffer(b"".join(f[c]), dtype=np.int16).reshape(-1, REGISTERS) for c in ("levels_a", "levels_b"))
            j = estimate(a, b, f["n_a"].to_numpy(float), f["n_b"].to_numpy(float))
            yield f.loc[j >= LEAST_ESTIMATE, ["a", "b"]]


def _sets_of(docs: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """``classes(set_key, doc_id, ...)`` with the items of each class, found again
    in the text of one of its documents. The classes are broadcast if counted few."""
    classes = materialize(classes, f"{label}-wanted")
    some = F.broadcast if classes.count() <= BROADCAST_CLASSES else (lambda df: df)
    texts = docs.select("doc_id", "text").join(some(classes.select("doc_id")), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(_sets, "set_key string, items array<long>")
    # An id may have other texts too, and a text several rows.
    return materialize(sets.join(some(classes), "set_key").dropDuplicates(["set_key"]), label)


def _checked(docs: DataFrame, reps: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("levels").alias(f"levels_{c}"))
    likely = materialize(
        pairs.join(one("a"), "a").join(one("b"), "b").mapInPandas(_likely, "a long, b long"), f"{label}-likely"
    )
    ids = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
    sets = _sets_of(docs, reps.join(ids, "id", "left_semi").select("set_key", "doc_id", "id"), f"{label}-sets")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("items").alias(f"items_{c}"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    similar = 100 * both >= 75 * (F.size("items_a") + F.size("items_b") - both)
    return materialize(likely.join(side("b"), "b").join(side("a"), "a").where(similar).select("a", "b"), f"{label}-links")


def _rare_pairs(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle among each
    one's rarest ``n - ceil(0.75 n) + 1``.

    With shingles in one order, two sets of similarity 0.75 must share one of
    these, so no link is lost, and passages that many texts hold come last in
    the order and are not paired on.
    """
    sets = _sets_of(docs, open_, "setsketch-open")
    rows = sets.select(F.explode("items").alias("item"), "id", F.size("items").cast("long").alias("n"), "component")
    # Counted in each task first, so that a common shingle is few rows.
    copies = rows.groupBy("item").agg(F.count("*").alias("copies")).where("copies > 1")
    shared = rows.join(copies, "item")
    # Items of one text only come first in its order; they are n - held.
    own = Window.partitionBy("id")
    prefix = (
        shared.withColumn("place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("copies", "item")))
        .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 75 / 100) + 1)
        .select("item", "id", "n", "component", (F.col("n") - F.col("place")).alias("after"))
    )
    prefix = materialize(prefix, "setsketch-rare")
    x, y = prefix.alias("x"), prefix.alias("y")
    return (
        x.join(
            y,
            (F.col("x.item") == F.col("y.item")) & (F.col("x.id") < F.col("y.id"))
            & (F.col("x.component") != F.col("y.component"))
            # After the first shared item at most so many more are shared.
            & ((1 + F.least("x.after", "y.after")) * 175 >= (F.col("x.n") + F.col("y.n")) * 75),
        )
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    )


def _numbered(reps: DataFrame) -> tuple[DataFrame, bool]:
    """The classes with a number ``id`` in the order of ``doc_id``, and whether it is
    the document id itself (whole numbers, each of one class).

    The order matters: a bucket's leader is its least number, and early documents
    are likelier to be the texts that others were copied from.
    """
    whole = dict(reps.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    if whole and reps.groupBy("doc_id").count().where("count > 1").isEmpty():
        return reps.withColumn("id", F.col("doc_id").cast("long")), True
    ranked = global_rank(reps, ["doc_id", "set_key"], "setsketch-order")
    return ranked.withColumnRenamed("rank", "id").drop("n_rows"), False


def links(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key (a hash of the text), n_shingles, class_id (least
    id with an equal set), component_id (least id reachable; the row's own for an
    empty set) and component (a number, null for rows that link with nothing)."""
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    rows = materialize(
        docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
            _sketched, f"doc_id {kind}, text_key long, n_shingles long, set_key string, levels binary"
        ),
        "setsketch",
    )
    # A class is all documents with equal sets; the least id stands for it.
    reps = (
        rows.where("set_key is not null and doc_id is not null").groupBy("set_key")
        .agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "levels")).alias("r"))
        .select("set_key", "r.*")
    )
    reps, plain = _numbered(materialize(reps, "setsketch-classes"))
    bands = reps.select("id", "n", "levels").mapInPandas(_banded, "band long, id long, n long")
    shared = bands.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("members")).where("members > 1")
    crowded = materialize(bands.join(shared.select("band", "leader"), "band"), "setsketch-buckets")
    star = crowded.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    found = _checked(docs, reps, star, "setsketch-star")
    linked = components(found)
    # Members of buckets that hold more than one component compare across
    # components, by the rare shingles that a linked pair must share.
    place = crowded.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = place.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    open_ = place.join(mixed.select("band"), "band", "left_semi").select("id", "component").distinct()
    across = _rare_pairs(docs, reps.select("set_key", "doc_id", "id").join(open_, "id"))
    more = _checked(docs, reps, across, "setsketch-across")
    joined = components(found.union(more))
    classes = reps.select("set_key", F.col("doc_id").alias("class_id"), "id").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    if plain:
        classes = classes.withColumn("component_id", F.col("component").cast(kind))
    else:
        classes = classes.join(reps.select(F.col("id").alias("component"), F.col("doc_id").alias("component_id")), "component")
    classes = classes.select("set_key", "class_id", "component_id", "component")
    known = F.when(F.col("doc_id").isNotNull(), F.col("set_key"))
    many = rows.select("doc_id", "text_key", "n_shingles", known.alias("set_key")).join(classes, "set_key", "left")
    return many.select("doc_id", "text_key", "n_shingles", "class_id", F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def score(docs: DataFrame) -> DataFrame:
    judged = links(docs).select("doc_id", "n_shingles", "class_id", "component_id")
    return judged.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that of the least id, and
    of the rows with this id one."""
    judged = materialize(links(docs).where("component is not null").select("doc_id", "text_key", "component"), "setsketch-judged")
    row = F.struct("doc_id", "text_key")
    stays = judged.groupBy("component").agg(F.min(row).alias("s"))
    gone = judged.join(stays, "component").where(row != F.col("s")).select("doc_id", "text_key").distinct()
    again = judged.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_key")
    keyed = docs.withColumn("_text_key", F.xxhash64("text"))
    left = _by_text(keyed, gone, "left_anti")
    again = materialize(again, "setsketch-again")
    if not again.isEmpty():
        once = _by_text(left, again, "left_anti")
        left = once.unionByName(_by_text(left, again, "left_semi").dropDuplicates(["doc_id", "_text_key"]))
    return left.drop("_text_key")


def _by_text(keyed: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Rows whose id and text are, or are not, among ``rows``, which is broadcast
    if counted few."""
    rows = materialize(rows.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "setsketch-rows")
    few = rows.count() <= BROADCAST_IDS // 2
    return keyed.join(F.broadcast(rows) if few else rows, (F.col("doc_id") == F.col("_id")) & (F.col("_text_key") == F.col("_key")), how)
