"""Trailing-window normalisation: each date is scaled by the pooled statistics of the N dates before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ieee_div


def long_steps(samples: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """(keys, step, feature, value) of the nested sequences."""
    steps = samples.select(*keys, F.posexplode(x).alias("step", "v"))
    return steps.select(*keys, "step", F.posexplode("v").alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


def date_moments(values: DataFrame, by: list[str]) -> DataFrame:
    """Per date (and ``by``): n, mean and the sum of squared deviations from the mean; combined before the shuffle."""
    return values.groupBy("date", *by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"))


#: Sums of dates and features that a task holds before it sends them.
HELD = 200_000


def sample_moments(samples: DataFrame, x: str = "x") -> DataFrame:
    """``date_moments`` of every feature over all samples and steps, from the nested sequences as they are.

    A task keeps (n, mean, m2) of each date and feature and merges in what a batch adds, so no cell becomes a row and
    at most a row per task, date and feature is shuffled. NULL values count for nothing; samples may differ in steps.
    """
    kind = samples.schema["date"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def told() -> pa.RecordBatch:
            dates, features, moments = [d for d, _ in held], [f for _, f in held], np.array(list(held.values())).reshape(-1, 3)
            return pa.RecordBatch.from_arrays([pa.array(dates, date_type), pa.array(features, pa.int32()), pa.array(moments[:, 0].astype(np.int64)), pa.array(moments[:, 1]), pa.array(moments[:, 2])], ["date", "feature", "n", "mean", "m2"])

        date_type = None
        for batch in batches:
            dates, steps = batch.column("date").dictionary_encode(), batch.column(x).flatten()
            date_type = batch.column("date").type
            per_sample, per_step = (c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (batch.column(x), steps))
            cells = steps.flatten()
            feature = np.arange(len(cells)) - np.repeat(np.cumsum(per_step) - per_step, per_step)
            width = int(feature.max()) + 1 if len(feature) else 1
            of = dates.indices.fill_null(len(dates.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.repeat(np.repeat(of, per_sample), per_step) * width + feature
            values, known = cells.to_numpy(zero_copy_only=False).astype(np.float64), cells.is_valid().to_numpy(zero_copy_only=False)
            values, code = values[known], code[known]
            n = np.bincount(code)
            mean = np.bincount(code, values) / np.maximum(n, 1)
            m2 = np.bincount(code, (values - mean[code]) ** 2)
            names = [*dates.dictionary.to_pylist(), None]
            for c in np.flatnonzero(n).tolist():
                key = (names[c // width], c % width)
                a, mu, q = held.get(key, (0, 0.0, 0.0))
                total, apart = a + n[c], mean[c] - mu
                held[key] = (total, mu + apart * n[c] / total, q + m2[c] + apart * apart * a * n[c] / total)
            if len(held) > HELD:
                yield told()
                held.clear()
        if held:
            yield told()

    each = samples.select("date", x).mapInArrow(run, f"date {kind}, feature int, n long, mean double, m2 double")
    parts = each.groupBy("date", "feature").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("total"), F.collect_list(F.struct("n", "mean", "m2")).alias("parts"))
    parts = parts.withColumn("mean", F.col("total") / F.col("n"))
    # around the common mean, so nothing cancels; a part is a task's share of the date
    m2 = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return parts.select("date", "feature", "n", "mean", m2.alias("m2"))


def trailing_stats(moments: DataFrame, days: int, by: list[str]) -> DataFrame:
    """(date, by, mu, sd) from the ``days`` dates present before each date; dates with fewer have no row.

    Moments of the dates are merged (sum of squares within dates plus between them), never raw squares, so
    large means do not cancel. sd is the sample deviation. One row per date enters the window.
    """
    dates = moments.select("date").distinct().withColumn("rank", F.row_number().over(Window.orderBy("date")))
    w = Window.partitionBy(*by).orderBy("rank").rowsBetween(-days, -1)
    ranked = moments.join(F.broadcast(dates), "date") if not by else moments.join(dates, "date")
    n, total = F.sum("n").over(w), F.sum(F.col("n") * F.col("mean")).over(w)
    listed = F.collect_list(F.struct("n", "mean", "m2")).over(w)
    out = ranked.withColumns({"__n": n, "mu": F.try_divide(total, n), "__l": listed}).filter(F.col("rank") > days)
    around = F.aggregate("__l", F.lit(0.0), lambda a, d: a + d["m2"] + d["n"] * (d["mean"] - F.col("mu")) * (d["mean"] - F.col("mu")))
    return out.select("date", *by, "mu", F.sqrt(F.try_divide(around, F.col("__n") - 1)).alias("sd"))


def check_spread(stats: DataFrame) -> DataFrame:
    """Fails at run time for a date whose deviations are all zero; single zeros pass."""
    flat = F.max("sd").over(Window.partitionBy("date")) == 0
    return stats.withColumn("sd", F.when(flat, F.raise_error(F.lit("all standard deviations are zero"))).otherwise(F.col("sd")))


def trailing_normalize(values: DataFrame, days: int, by: list[str], check: bool = False) -> DataFrame:
    """``values`` (date, by, value, ...) with ``value`` replaced by (value - mu) / sd of the trailing dates.

    A zero deviation gives an infinity or NaN. The first ``days`` dates give no rows.
    """
    stats = trailing_stats(date_moments(values, by), days, by)
    if check:
        stats = check_spread(stats)
    scaled = values.join(stats, ["date", *by])
    return scaled.withColumn("value", ieee_div(F.col("value") - F.col("mu"), F.col("sd"))).drop("mu", "sd")


def normalize_samples(samples: DataFrame, days: int, z_columns: tuple[str, ...] = ("z1", "z2"), horizon: int = 0, keys: tuple[str, ...] = ("date", "stock_id")) -> DataFrame:
    """Samples with x and z scaled; y and identifiers untouched. ``horizon`` drops the last steps of x first."""
    if horizon:
        samples = samples.withColumn("x", F.slice("x", 1, F.greatest(F.size("x") - horizon, F.lit(0))))
    stats = check_spread(trailing_stats(sample_moments(samples), days, ["feature"]))
    wide = stats.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("feature", "mu", "sd"))).alias("s"))
    scaled = F.transform("x", lambda row: F.transform(row, lambda v, i: ieee_div(v.cast("double") - F.get(F.col("s.mu"), i), F.get(F.col("s.sd"), i)).cast("float")))
    out = samples.join(wide, "date").withColumn("x", scaled).drop("s")
    for z in z_columns:
        if z in samples.columns:
            own = trailing_stats(date_moments(samples.select("date", F.col(z).cast("double").alias("value")), []), days, []).withColumnsRenamed({"mu": "__mu", "sd": "__sd"})
            out = out.join(own, "date").withColumn(z, ieee_div(F.col(z).cast("double") - F.col("__mu"), F.col("__sd"))).drop("__mu", "__sd")
    return out
