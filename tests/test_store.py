"""Moments from nested sequences, sequences from one list a stock-day, sinks that replace what they write."""

import datetime as dt
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from microbook.operators import intraday, normalize
from microbook.sources import io


def test_moments_of_nested_sequences(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        x = (1e6 + rng.normal(size=(int(rng.integers(0, 5)), 3))).tolist()
        if x and i % 7 == 0:
            x[0][1] = None
        rows.append((i % 6 if i % 50 else None, x if i % 40 else None))
    df = spark.createDataFrame(rows, "date int, x array<array<double>>").repartition(7)
    with_few = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")  # several batches a task
    try:
        got = {(r["date"], r["feature"]): (r["n"], r["mean"], r["m2"]) for r in normalize.sample_moments(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_few)
    want: dict = {}
    for d, x in rows:
        for step in x or []:
            for f, v in enumerate(step):
                if v is not None:
                    want.setdefault((d, f), []).append(v)
    assert set(got) == set(want)
    for key, values in want.items():
        n, mean, m2 = got[key]
        assert n == len(values) and mean == pytest.approx(np.mean(values), rel=1e-12)
        assert m2 == pytest.approx(((np.array(values) - np.mean(values)) ** 2).sum(), rel=1e-6)


def test_no_cell_becomes_a_row(spark, capsys):
    df = spark.range(3000).select((F.col("id") % 4).cast("int").alias("date"), F.array(F.array(F.col("id").cast("double"), F.lit(1.0)), F.array(F.lit(2.0), F.lit(3.0))).alias("x")).repartition(6)
    out = normalize.sample_moments(df)
    assert out.count() == 4 * 2
    out.explain()
    assert "Generate" not in capsys.readouterr().out
    told = out.select(F.sum("n")).first()[0]
    assert told == 3000 * 2 * 2


def test_empty_samples_have_no_moments(spark):
    assert normalize.sample_moments(spark.createDataFrame([], "date date, x array<array<float>>")).collect() == []


def test_sequences_are_slices_of_a_day(spark):
    at = dt.datetime(2024, 1, 2)
    rows = [(s, at.date(), at + dt.timedelta(seconds=i), float(i), float(i) / 10) for s, n in (("a", 30), ("b", 7), ("c", 12)) for i in range(n)]
    df = spark.createDataFrame(rows, "stock_id string, date date, t timestamp, v double, y double").repartition(5)
    got = {(r["stock_id"], (r["anchor_t"] - at).seconds): ([c for step in r["x"] for c in step], r["y"]) for r in intraday.sliding_sequences(df, ["v"], 3, 6, 4).collect()}
    want = {}
    for s, n in (("a", 30), ("b", 7), ("c", 12)):
        for i in range(max(5, n - 3 - 4), n - 3):
            want[s, i] = ([float(v) for v in range(i - 5, i + 1)], i / 10)
    assert got == want


def test_rewriting_a_date_leaves_the_others(spark, tmp_path):
    df = spark.createDataFrame([(d, f"s{i}", [[float(d)]]) for d in range(3) for i in range(4)], "date int, stock_id string, x array<array<float>>")
    path = str(tmp_path / "s")
    io.write_samples(df, path)
    io.write_samples(df.filter("date = 1 and stock_id < 's2'"), path)
    io.write_samples(df.filter("date = 1 and stock_id < 's2'"), path)
    assert Counter(r["date"] for r in io.read_samples(spark, path).collect()) == {0: 4, 1: 2, 2: 4}
    io.write_samples(df.filter("date = 2"), path, "append")
    assert Counter(r["date"] for r in io.read_samples(spark, path).collect()) == {0: 4, 1: 2, 2: 8}
    days = str(tmp_path / "d")
    io.write_days(df, days)
    io.write_days(df.filter("date = 0 and stock_id = 's3'").withColumn("x", F.lit(None).cast("array<array<float>>")), days)
    told = io.read_days(spark, days).groupBy("date").agg(F.count("*").alias("n"), F.count("x").alias("x")).collect()
    assert sorted(map(tuple, told)) == [(0, 4, 3), (1, 4, 4), (2, 4, 4)]


def test_a_large_date_takes_several_tasks(spark, tmp_path):
    """A date with a hundred times the rows of the others is written by many tasks, the others by one each."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    held = spark.conf.get(name)
    spark.conf.set(name, "64k")
    try:
        rows = spark.range(0, 100_000, 1, 40).select(F.when(F.col("id") < 200, F.col("id") % 2).otherwise(2).cast("int").alias("date"), F.array(F.array(F.rand(1), F.rand(2), F.rand(3))).alias("x"))
        io.write_samples(rows, str(tmp_path / "s"))
    finally:
        spark.conf.set(name, held)
    files = {d: len(list((tmp_path / "s" / f"date={d}").glob("*.parquet"))) for d in range(3)}
    assert files[0] == files[1] == 1 and files[2] >= 8
