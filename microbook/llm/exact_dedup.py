"""Exact deduplication against a minimal perfect hash index of historical digests.

The index of distinct historical digests is split into shards by digest. A shard holds a minimal
perfect hash (cascaded bit arrays: a digest that is alone in its slot of level l is placed there, the
others go on to level l+1) whose slots hold the full 32-byte digest and the locator of the winner.
A looked-up digest is placed by the hash and then compared byte by byte with the slot's digest, so a
digest that is no member (which the hash sends to some slot as well) is never taken for a repeat; such
nonmembers are grouped among themselves.

Rows: a null text counts as empty; texts are equal when they are identical after each run of white
space became one space. Of equal texts the smallest doc_id stays (a null doc_id only if there is no
other; rows of one text with the same doc_id all carry it as ``keep_id`` and all count as kept).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_left, parts, stored, table
from .textkit import mix
from .url_filter import split_by

DIGESTS_PER_SHARD = 50_000
#: Bits per key of a level; keys whose bit is taken by another go to the next level.
GAMMA = 2.0
MAX_LEVELS = 40
INDEX_SCHEMA = "shard int, n int, sizes array<int>, bits binary, digests binary, keep_ids array<bigint>, counts array<bigint>"
INDEX = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("digests", pa.binary()), ("keep_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def normalised(text="text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of every row, on the JVM."""
    return docs.select("doc_id", F.sha2(F.encode(normalised(), "UTF-8"), 256).alias("text_sha256"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: its smallest doc_id and its number of rows; combined before the shuffle."""
    return rows.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n_rows"))


def _words(hexes) -> np.ndarray:
    """(n, 4) big-endian words of hexadecimal SHA-256 digests."""
    raw = bytes.fromhex("".join(hexes))
    return np.frombuffer(raw, ">u8").reshape(-1, 4).astype(np.uint64)


def _slot(words: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(words[:, 1] + words[:, 2] * np.uint64(2 * level + 1) + np.uint64(level))
    return (h % np.uint64(size)).astype(np.int64)


def build_mph(words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, all levels' bits, and each digest's slot number 0..n-1 (``words`` are distinct)."""
    sizes: list[int] = []
    bits: list[np.ndarray] = []
    at = np.full(len(words), -1, np.int64)
    left, base = np.arange(len(words)), 0
    while len(left) and len(sizes) < MAX_LEVELS:
        size = max(64, int(GAMMA * len(left)))
        slot = _slot(words[left], len(sizes), size)
        level = np.bincount(slot, minlength=size) == 1
        alone = level[slot]
        at[left[alone]] = base + slot[alone]
        left, base = left[~alone], base + size
        sizes.append(size)
        bits.append(level)
    if len(left):
        raise ValueError("digests are not distinct")
    all_bits = np.concatenate(bits) if bits else np.zeros(0, bool)
    rank = np.cumsum(all_bits) - 1
    return sizes, all_bits, rank[at] if len(at) else at


def mph_slots(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each digest; -1 where the hash shows already that it is no member."""
    out = np.full(len(words), -1, np.int64)
    rank = np.cumsum(bits) - 1
    left, base = np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        slot = base + _slot(words[left], level, size)
        hit = bits[slot]
        out[left[hit]] = rank[slot[hit]]
        left, base = left[~hit], base + size
        if not len(left):
            break
    return out


def _shard(n: int):
    return F.pmod(F.xxhash64("text_sha256"), F.lit(n)).cast("int")


def _build(rows: pa.Table) -> pa.Table:
    """The index of one shard; ids stay in Arrow, where a null among them changes none."""
    hexes = rows["text_sha256"].to_pylist()
    sizes, bits, slot = build_mph(_words(hexes))
    order = np.argsort(slot)
    body = bytes.fromhex("".join(hexes[i] for i in order.tolist()))
    row = {"shard": rows["shard"][0].as_py(), "n": len(hexes), "sizes": sizes, "bits": np.packbits(bits).tobytes(), "digests": body, "keep_ids": rows["keep_id"].take(order).to_pylist(), "counts": rows["n_rows"].take(order).to_pylist()}
    return pa.Table.from_pylist([row], INDEX)


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard from ``distinct_digests`` of the historical rows."""
    return history.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_build, INDEX_SCHEMA)


def _probe(queries: pa.Table, index: pa.Table) -> pa.Table:
    seen_id, seen_rows = pa.nulls(len(queries), pa.int64()), pa.array(np.zeros(len(queries), np.int64))
    if len(queries) and len(index):
        sizes, words = index["sizes"][0].as_py(), _words(queries["text_sha256"].to_pylist())
        bits = np.unpackbits(np.frombuffer(index["bits"][0].as_py(), np.uint8), count=sum(sizes)).astype(bool)
        slot = mph_slots(words, sizes, bits)
        held = np.frombuffer(index["digests"][0].as_py(), ">u8").reshape(-1, 4).astype(np.uint64)
        member = (slot >= 0) & (held[np.maximum(slot, 0)] == words).all(axis=1)
        at = pa.array(slot, mask=~member)  # a null takes nothing
        seen_id = index["keep_ids"][0].values.take(at)
        seen_rows = index["counts"][0].values.take(at).fill_null(0)
    return queries.select(["text_sha256", "keep_id", "n_rows"]).append_column("seen_id", seen_id).append_column("seen_rows", seen_rows)


def probe_index(queries: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Look ``distinct_digests`` up: adds ``seen_id`` (the winner's locator) and ``seen_rows`` (0: no member)."""
    schema = "text_sha256 string, keep_id bigint, n_rows bigint, seen_id bigint, seen_rows bigint"
    return queries.withColumn("shard", _shard(shards)).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe, schema)


def exact_dedup(docs: DataFrame, history_share: float = 0.5) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``.

    The rows with the lower ``history_share`` of the doc_ids are the history that is indexed; the
    digests of the others are looked up in it, and those that are no members are grouped by themselves.
    """
    spark = docs.sparkSession
    rows = stored(digests(docs), "digests")
    n, border = rows.agg(F.count("*"), F.percentile_approx("doc_id", history_share, 1000)).first()
    old = F.col("doc_id").isNotNull() & (F.col("doc_id") <= F.lit(border))
    history = distinct_digests(rows.filter(old))
    later = distinct_digests(rows.filter(~old | F.lit(border is None)))
    shards = max(8 * parts(spark), -(-n // DIGESTS_PER_SHARD))
    index = stored(build_index(history, shards), "mph")
    found = probe_index(later, index, shards)
    later_facts = found.select(
        "text_sha256",
        F.coalesce(F.least("seen_id", "keep_id"), "seen_id", "keep_id").alias("keep_id"),
        (F.col("n_rows") + F.col("seen_rows")).alias("group_size"),
    )
    # the history's own digests are those of the index slots; where later rows repeat them, their sizes add up
    both = stored(
        history.select("text_sha256", "keep_id", F.col("n_rows").alias("group_size")).unionByName(later_facts).groupBy("text_sha256").agg(F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")),
        "winners",
    )
    out = lookup_left(rows, both, ["text_sha256"], both.select("text_sha256", F.col("group_size").alias("n_rows")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay; of fully equal rows (same doc_id and text) one stays.

    Only rows that may have to go (a Bloom filter of fixed size tells) are shuffled.
    """
    cols = docs.columns
    verdict = stored(exact_dedup(docs).select("doc_id", "text_sha256", "kept"), "verdicts")
    gone = verdict.filter("not kept").select("doc_id", "text_sha256")
    again = verdict.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1").select("doc_id", "text_sha256")
    gone, again = stored(gone.distinct(), "gone"), stored(again, "again")
    marked = docs.withColumn("__sha", F.sha2(F.encode(normalised(), "UTF-8"), 256))
    stay, asks = split_by(marked, [F.col("doc_id"), F.col("__sha")], gone.unionByName(again))
    asks = asks.alias("a").join(gone.alias("g"), F.col("a.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("a.__sha") == F.col("g.text_sha256")), "left_anti")
    return stay.unionByName(asks.dropDuplicates(["doc_id", "__sha"])).select(*[f"`{c}`" for c in cols])


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = {
    "op9_exact_dedup": r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)"""
}
