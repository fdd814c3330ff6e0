"""URL rules behind a blocked Bloom filter.

The keys of the listed rules (host suffix and path prefix) fill a blocked Bloom filter: a key's hash
picks one block of 512 bits and eight bits within it, so a probe touches one cache line. A page's keys
that pass the filter go to an exact hash join with the list, which removes the false positives. The
filter has 12 bits per listed key but never over ``max_bytes``: beyond that the false-positive rate
rises and more keys go to the join; results do not change.

Rows: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed.
Repeated pages each get their row. Of rules that fit, the longest (host and path together, then the
longer host, then the block rule) wins; repeated rules count once; rules with a null or empty host fit
nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup_left, table
from .textkit import mix

BITS_PER_KEY = 12
BLOCK_WORDS = 8
#: A power of two.
SLICES = 64
MAX_BYTES = 32 << 20
#: A list of up to this many rules (of bounded length) is broadcast for the exact join; a longer one is shuffled.
BROADCAST_RULES = 10_000

#: The rules of the query: (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


class BlockedBloom:
    """512-bit blocks; keys are 64-bit hashes."""

    def __init__(self, n_keys: int, max_bytes: int = MAX_BYTES):
        blocks = max(1, min(-(-n_keys * BITS_PER_KEY // 512), max_bytes // 64))
        #: A key's last bits choose one of the slices, which are filled independently.
        self.slices = SLICES if blocks >= SLICES else 1
        self.each = -(-blocks // self.slices)
        self.words = np.zeros((self.slices * self.each, BLOCK_WORDS), np.uint64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64))
        block = (h % np.uint64(self.each)).astype(np.int64)
        if self.slices > 1:
            block += (keys.astype(np.uint64) & np.uint64(SLICES - 1)).astype(np.int64) * self.each
        g = mix(h ^ np.uint64(0x9E3779B97F4A7C15))
        # six bits for each of the eight words of the block
        shift = (g[:, None] >> (np.arange(BLOCK_WORDS, dtype=np.uint64) * np.uint64(6))) & np.uint64(63)
        return block, np.uint64(1) << shift

    def add(self, keys: np.ndarray) -> None:
        block, masks = self._places(keys)
        for j in range(BLOCK_WORDS):
            np.bitwise_or.at(self.words[:, j], block, masks[:, j])

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        block, masks = self._places(keys)
        return ((self.words[block] & masks) == masks).all(axis=1)


def build_bloom(keys: DataFrame, n: int, max_bytes: int = MAX_BYTES) -> BlockedBloom:
    """Filter of a DataFrame's only column (64-bit hashes). Each task fills one slice of the filter, so the
    driver gets slices that add up to ``max_bytes`` at most."""
    out = BlockedBloom(n, max_bytes)
    if not n:
        return out
    k = F.col(keys.columns[0])
    part = k.bitwiseAND(SLICES - 1).cast("int") if out.slices > 1 else F.lit(0)

    def fill(rows: pa.Table) -> pa.Table:
        own = BlockedBloom(n, max_bytes)
        own.add(rows["k"].to_numpy().view(np.uint64))
        at = rows["part"][0].as_py()
        return pa.table({"part": pa.array([at], pa.int32()), "words": pa.array([own.words[at * own.each : (at + 1) * own.each].tobytes()], pa.binary())})

    filled = keys.select(k.alias("k"), part.alias("part")).filter("k is not null").groupBy("part").applyInArrow(fill, "part int, words binary")
    for row in filled.collect():
        out.words[row["part"] * out.each : (row["part"] + 1) * out.each] = np.frombuffer(row["words"], np.uint64).reshape(-1, BLOCK_WORDS)
    return out


def maybe_in(bloom, key: Column) -> Column:
    """Whether a 64-bit hash may be in a broadcast filter."""

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        return pd.Series(bloom.value.maybe(keys.to_numpy(np.int64).view(np.uint64)))

    return maybe(key)


def split_by(rows: DataFrame, keys: list[Column], listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those surely not listed, which need not move, and those that may be. ``listed`` has the keys as its only columns."""
    n = listed.count()
    if not n:
        return rows, rows.limit(0)
    bloom = rows.sparkSession.sparkContext.broadcast(build_bloom(listed.select(F.xxhash64(*listed.columns).alias("k")), n))
    marked = rows.withColumn("__maybe", maybe_in(bloom, F.xxhash64(*keys)))
    return marked.filter("not __maybe").drop("__maybe"), marked.filter("__maybe").drop("__maybe")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def url_filter(pages: DataFrame, rules: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``rules`` has host, path, verdict."""
    rules = rules.filter(F.coalesce(F.col("host"), F.lit("")) != "").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict")
    labels = F.length("r_host") - F.length(F.replace(F.col("r_host"), F.lit("."))) + 1
    stats = rules.agg(F.count("*"), F.collect_set(F.length("r_path")), F.collect_set(labels)).first()
    n, lengths, depths = stats[0], sorted(stats[1]), sorted(stats[2])
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not n:
        return pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    bloom = pages.sparkSession.sparkContext.broadcast(build_bloom(rules.select(_key(F.col("r_host"), F.col("r_path"))), n, max_bytes))

    @F.pandas_udf("array<int>")
    def passing(keys: pd.Series) -> pd.Series:
        sizes = keys.map(len).to_numpy()
        flat = np.concatenate([np.asarray(k, np.int64) for k in keys]) if len(keys) else np.zeros(0, np.int64)
        hit = bloom.value.maybe(flat.view(np.uint64))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return pd.Series(np.split(place[hit].astype(np.int32), np.cumsum(np.bincount(owner[hit], minlength=len(sizes)))[:-1]) if len(sizes) else [])

    # only suffixes with as many labels as some rule's host can fit it
    depth = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."))) + 1
    own = F.filter(F.array(*[F.lit(x) for x in depths]), lambda c: (c <= depth) & (F.col("host") != ""))
    suffixes = F.transform(own, lambda c: F.call_function("substring_index", F.col("host"), F.lit("."), -c))
    cuts = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length("path"))
    heads = F.transform(cuts, lambda x: F.substring(F.col("path"), F.lit(1), x))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(heads, lambda p: F.struct(h.alias("r_host"), p.alias("r_path")))))
    # a url's verdict depends on host and path alone, so each pair is judged once
    urls = pages.groupBy("host", "path").agg(F.count("*").alias("n_rows"))
    probed = urls.withColumn("pairs", pairs)
    probed = probed.withColumn("hits", passing(F.transform("pairs", lambda x: _key(x["r_host"], x["r_path"]))))
    hits = probed.select("host", "path", F.explode(F.transform("hits", lambda i: F.get("pairs", i))).alias("k")).select("host", "path", "k.r_host", "k.r_path")
    if n <= BROADCAST_RULES:
        exact = hits.join(F.broadcast(rules), ["r_host", "r_path"])
    else:
        exact = lookup_left(hits, rules, ["r_host", "r_path"]).filter(F.col("verdict").isNotNull())
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), "verdict")
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "verdict"), rank).alias("b"))
    facts = best.select("host", "path", "b.rule", "b.verdict")
    out = lookup_left(pages, facts, ["host", "path"], urls)
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op6_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages"), rules)


ORACLE = {
    "op6_url_filter": r"""
with u as (select page_id, case when url is null or position('://' in url) = 0 then '' else substr(url, position('://' in url) + 3) end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from u),
r(rh, rp, rv) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
b as (select host, path, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(rv, length(rh || rp)) as rv
      from (select distinct host, path from p) q join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by host, path)
select page_id, p.host, p.path, rule, coalesce(rv, 'allow') as verdict from p left join b on p.host = b.host and p.path = b.path"""
}
