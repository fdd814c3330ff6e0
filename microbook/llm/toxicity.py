"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

Features are the n-grams (4 to 6 code points) of the lower-cased text with each run of white space as
one space, hashed to 2**20 slots; a feature counts once per text. Naive Bayes gives each slot the log
of the ratio of its smoothed frequencies in toxic and in other texts; a logistic regression is then
trained on the presences scaled by these ratios.

The fit uses a bounded sample of labelled rows (``max_toxic`` and ``max_clean``: those with the smallest
hashes of their doc_id and text digest, up to ``max_bytes`` of text), which the driver holds; the weights that are broadcast have a
fixed size. Scoring is one pass over whole texts without a shuffle.

Rows: a null or empty text has no features and gets the score of the bias. A document without a label,
or with a null one, takes no part in the fit; nor do labels with a null doc_id. Without labels of both
kinds all scores are 0. Repeated documents each get their row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .textkit import give_back

GRAMS = (4, 5, 6)
BITS = 20
MAX_TOXIC, MAX_CLEAN = 1_500, 2_500
#: Bytes of text of the sample: rows beyond them, in the sample's order, are left out.
MAX_BYTES = 128 << 20
#: Slots whose log-count ratio is nearer to 0 tell nothing and get no weight.
LEAST_RATIO = 1.5
#: A text's features are divided by this power of their number, so long texts do not outweigh short ones.
LENGTH_POWER = 0.25
#: Code points whose n-grams are hashed at once.
PIECE = 1 << 18
#: Features whose products a round of the fit holds at once.
SLICE = 1 << 16
_SPACES = re.compile(r"\s+")


def slots(text: str | None) -> np.ndarray:
    """Distinct slots of a text's n-grams, any order."""
    s = " " + _SPACES.sub(" ", (text or "").lower()).strip() + " "
    if len(s) <= 2:
        return np.zeros(0, np.int32)
    c = np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)
    found, widest = [], max(GRAMS)
    for at in range(0, max(1, len(c) - min(GRAMS) + 1), PIECE):
        own = c[at : at + PIECE + widest - 1]
        h = own.copy()
        for n in range(2, widest + 1):
            if len(own) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) + own[n - 1 :] * np.uint32(0x9E3779B1)
            if n in GRAMS:
                x = h[:PIECE] ^ (h[:PIECE] >> np.uint32(15))
                found.append((x * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    if not found:
        return np.zeros(0, np.int32)
    return np.concatenate(found).astype(np.int32)


class _Distinct:
    """Distinct slots without a sort: each slot keeps its last position."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int32)

    def __call__(self, idx: np.ndarray) -> np.ndarray:
        places = np.arange(len(idx), dtype=np.int32)
        self.last[idx] = places
        return idx[self.last[idx] == places]


def fit(texts: list[str | None], labels: np.ndarray, rounds: int = 80, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights of the slots, bias)."""
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return np.zeros(1 << BITS, np.float32), -np.inf
    distinct, width = _Distinct(), 1 << BITS
    count, toxic = np.zeros(width, np.int32), np.zeros(width, np.int32)
    size = np.zeros(len(texts))
    for i, text in enumerate(texts):
        idx = distinct(slots(text))
        size[i] = len(idx)
        count[idx] += 1
        toxic[idx] += int(labels[i])
    p, q = 1.0 + toxic, 1.0 + count - toxic
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(count < 3) | (np.abs(ratio) < LEAST_RATIO)] = 0.0
    # the texts are hashed a second time, so only telling slots are held
    rows = []
    for text in texts:
        idx = distinct(slots(text))
        rows.append(idx[ratio[idx] != 0])
    first = np.cumsum([0, *map(len, rows)])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(first))
    # only telling slots get a weight: they are numbered anew, so what a round holds follows their number
    used = np.flatnonzero(ratio)
    place = np.zeros(width, np.int32)
    place[used] = np.arange(len(used))
    col, ratio = place[np.concatenate(rows)], ratio[used]
    del rows, place, count, toxic, p, q
    # a round takes some texts at a time, so little is held beside the features
    slices, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(first, first[at] + SLICE, "right")) - 1)
        slices.append((at, to, slice(first[at], first[to])))
        at = to
    value, scale = np.empty(len(col), np.float32), np.maximum(size, 1.0) ** -LENGTH_POWER
    for _, _, own in slices:
        value[own] = ratio[col[own]] * scale[row[own]]
    weight_of = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    w, bias = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    z = np.empty(len(texts))
    for t in range(1, rounds + 1):
        for at, to, own in slices:
            z[at:to] = np.bincount(row[own] - at, weights=w[col[own]] * value[own], minlength=to - at) + bias
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight_of / len(labels)
        g = np.zeros(len(used))
        for _, _, own in slices:
            np.add.at(g, col[own], miss[row[own]] * value[own])
        g += l2 * w
        gb = miss.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.1 / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= step * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(width, np.float32)
    weights[used] = w * ratio
    return weights, float(bias)


def score_texts(texts, weights: np.ndarray, bias: float, distinct: _Distinct) -> np.ndarray:
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        idx = distinct(slots(t))
        z = bias + float(weights[idx].sum(dtype=np.float64)) / max(1.0, len(idx)) ** LENGTH_POWER if len(idx) else bias
        out[i] = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    return out


def held_out(doc_id="doc_id") -> Column:
    """Every fifth document by checksum; a null doc_id counts as learnt from (it has no label)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> pd.DataFrame:
    """The bounded sample (text, toxic): the ids are chosen among the labels, so only chosen texts move."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    chosen = known.filter("toxic = 1").orderBy(order, "doc_id").limit(max_toxic).unionByName(known.filter("toxic = 0").orderBy(order, "doc_id").limit(max_clean))
    # at most max_toxic + max_clean ids: broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    # a doc_id that is repeated does not widen the sample
    rows = stored(rows.select("text", "toxic", order.alias("o"), "doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("bytes")), "labelled")
    place = ["o", "doc_id", "h"]
    sizes = rows.orderBy(*place).limit(max_toxic + max_clean).select(*place, "bytes").toArrow().to_pandas()
    fit_in = sizes[sizes["bytes"].fillna(0).cumsum() <= max_bytes]
    if fit_in.empty:
        return pd.DataFrame({"text": [], "toxic": []})
    return rows.orderBy(*place).limit(len(fit_in)).select("text", "toxic").toArrow().to_pandas()


def train(docs: DataFrame, labels: DataFrame, **bounds) -> tuple[np.ndarray, float]:
    rows = training_rows(docs, labels, **bounds)
    model = fit(rows["text"].tolist(), rows["toxic"].to_numpy())
    del rows
    give_back()
    return model


def scored(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """``docs`` with the score in the column ``name``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = held.value
        distinct = _Distinct()
        try:
            for texts in batches:
                yield pd.Series(score_texts(texts, weights, bias, distinct))
        finally:
            give_back()

    return docs.withColumn(name, score("text"))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5."""
    cols = docs.columns
    return scored(docs, train(docs, labels), "__toxicity").filter("__toxicity < 0.5").select(*[f"`{c}`" for c in cols])
