"""Mixing sources to target weights by balanced (cube-method) sampling.

Each source has a target number of words; every document is taken floor(r) times, r = target / source's
words, and once more with inclusion probability r - floor(r). Which documents get that extra copy is
decided by the cube method. The flight phase moves the probabilities of three documents at a time along
the null-space of the two balancing constraints (words taken and documents taken), until one of them is
0 or 1. Of the two ways along it a coin takes the nearer end the more often, so that each probability is kept
on average: a document's chance of an extra copy does not depend on its length. Documents are dealt into blocks of bounded size (source and hash); each block leaves at most two
undecided documents, which meet again in the next round of blocks, so the sums of the whole source stay
exact until at most two documents of a source are left. These land on the rounding whose words come
nearest to the target.

Rows: a null text has no words; documents without words are taken 0 words. A null source is a source of
its own, the last. The choice depends on the seed, source, doc_id and text alone, so reruns and other
partitionings agree; fully equal rows are interchangeable. An empty table gives an empty result. Any number
of sources is mixed; their targets are computed where they lie.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_left, stored, table
from .textkit import mix

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
BLOCK = 2048
SEED = 20
EPS = 1e-9

_SCHEMA = "source string, doc_id long, size long, source_size long, target double, base long, p double, ord long"


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``sources(source, size, n)`` with ``target``, by code point of the source, null last.

    A target stops at ``limit`` times its source's size; what is over goes to the others by weight, until
    none is above. A source once above stays so, as the others' shares only grow; each round is one sum over
    the sources, and the driver holds only that.
    """
    placed = sources.orderBy(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("no"))
    placed = stored(placed, "sources")
    before = [0]
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # a row for each task of the sort
    for part in range(max(sizes, default=-1) + 1):
        before.append(before[-1] + sizes.get(part, 0))
    held = Window.partitionBy("part").orderBy("no")
    shift = F.get(F.array(*[F.lit(x) for x in before]), F.col("part"))
    place = F.pmod(shift + F.row_number().over(held) - 1, F.lit(len(weights)))
    weighed = stored(placed.select("source", "size", "n", F.get(F.array(*[F.lit(w) for w in weights]), place.cast("int")).alias("weight")), "weights")
    whole = weighed.agg(F.sum("size")).first()[0] or 0
    rate, over = 0.0, -1
    while True:
        above = F.lit(rate) * F.col("weight") > limit * F.col("size")
        sums = weighed.agg(F.count_if(above), F.sum(F.when(above, F.col("size")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if sums[0] == over or not sums[2]:
            break
        over, rate = sums[0], (share * whole - limit * sums[1]) / sums[2]
    above = F.lit(rate) * F.col("weight") > limit * F.col("size")
    return weighed.select("source", "size", "n", F.when(above, limit * F.col("size")).otherwise(F.lit(rate) * F.col("weight")).alias("target"))


def flight(size: np.ndarray, p: np.ndarray, ord_: np.ndarray) -> np.ndarray:
    """Probabilities after the flight phase: all but two at most are 0 or 1, and sum(p) and sum(p * size) are as before.

    Units are taken in the given order. A move of ``up`` along the null-space is made with probability
    down / (up + down), else one of ``down`` against it, so it is zero on average. The coin is drawn from the
    hashes ``ord_`` of the three units, so reruns agree.
    """
    p = p.astype(float).copy()
    drawn = mix(ord_.astype(np.int64).view(np.uint64)).tolist()
    live: list[int] = []
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = round(p[i])
            continue
        live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        # null-space of [[1, 1, 1], [size_a, size_b, size_c]]
        u = (float(size[c] - size[b]), float(size[a] - size[c]), float(size[b] - size[a]))
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(live, u, strict=True) if v)
        down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(live, u, strict=True) if v)
        coin = ((drawn[a] + 3 * drawn[b] + 5 * drawn[c]) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) / (1 << 64)
        step = up if coin * (up + down) < down else -down
        for k, v in zip(live, u, strict=True):
            p[k] += step * v
        for k in list(live):
            if p[k] <= EPS or p[k] >= 1 - EPS:
                p[k] = round(p[k])
                live.remove(k)
    return p


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Round the few undecided units so that the words come nearest to their expectation; then the count; then fewer words."""
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    p = p.copy()
    if len(open_):
        words, count = float((p[open_] * size[open_]).sum()), float(p[open_].sum())
        best = min(itertools.product((0, 1), repeat=len(open_)), key=lambda s: (abs(np.dot(s, size[open_]) - words), abs(sum(s) - count), np.dot(s, size[open_]), s))
        p[open_] = best
    return p


def _decided(rows: pa.Table, land: bool) -> pa.Table:
    """The flight (and landing) of one block; ids stay in Arrow, where a null among them changes none."""
    rows = rows.sort_by([("ord", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
    size, p = rows["size"].to_numpy(), flight(rows["size"].to_numpy(), rows["p"].to_numpy(), rows["ord"].to_numpy())
    return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(landing(size, p) if land else p))


def _fly(rows: pa.Table) -> pa.Table:
    return _decided(rows, land=False)


def _land(rows: pa.Table) -> pa.Table:
    return _decided(rows, land=True)


def word_count(text="text"):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of ``docs``."""
    rows = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("ord"))
    rows = stored(rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))), "sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), weights, share, limit)
    facts = stored(
        sources.select(
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key"), F.col("size").alias("source_size"), F.col("target").cast("double").alias("target"),
            F.coalesce(F.try_divide("target", "size"), F.lit(0.0)).cast("double").alias("ratio"), F.ceil(F.col("n") / block).alias("blocks"), F.col("n").alias("n_rows"),
        ), "targets",
    )
    rows = lookup_left(rows, facts.drop("n_rows"), ["key"], facts.select("key", "n_rows"))
    base = F.floor(F.col("ratio") + EPS)
    rows = rows.select(
        "source", "doc_id", "size", "source_size", "target", base.alias("base"),
        F.when(F.col("size") == 0, 0.0).otherwise(F.greatest(F.col("ratio") - base, F.lit(0.0))).alias("p"), "ord", F.pmod("ord", "blocks").alias("block"),
    )
    done = None
    most = facts.agg(F.max("n_rows")).first()[0] or 0
    undecided = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
    while most > block:
        flown = stored(rows.groupBy("source", "block").applyInArrow(_fly, _SCHEMA + ", block long"), "flight")
        settled = flown.filter(~undecided)
        done = settled if done is None else done.unionByName(settled)
        # each block leaves two documents at most
        rows = flown.filter(undecided).withColumn("block", F.floor(F.col("block") / (block // 4)))
        most = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    landed = rows.groupBy("source").applyInArrow(_land, _SCHEMA + ", block long")
    out = landed if done is None else done.unionByName(landed)
    copies = (F.col("base") + F.round("p").cast("long")).alias("copies")
    return out.select("doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))


def op5_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
