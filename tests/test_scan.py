"""Scans of large groups on two levels, against the window over whole groups."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from microbook.functions import book as B
from microbook.operators import bars, features, intraday, scan
from microbook.operators.clean import DAY



def values():
    return {"seen": ("last", F.col("v")), "total": ("sum", F.col("q")), "before": ("lag", F.col("v")), "no": ("number", None)}


def told(df, columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=str)


@pytest.mark.parametrize("most", [0, 5, 60, 10_000])
def test_two_levels_equal_the_window(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(20), i, rng.choice([None, None, rng.randrange(99)]), rng.choice([None, 1, 5])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t int, ord long, v int, q long").repartition(5)
    for order in ([F.col("t"), F.col("ord")], [F.desc("t"), F.desc("ord")]):
        hot = scan.find_hot([df], ["k"], most)
        assert (hot.keys is None) == (most == 10_000)
        got = scan.running(df, ["k"], order, values(), hot)
        assert told(got, ["k", "ord", *values()]) == told(scan.running(df, ["k"], order, values(), scan.Hot()), ["k", "ord", *values()])


def market(spark, trades=6000, snapshots=900, one_time=False):
    """One stock-day with nearly all rows, and a quiet one."""
    at = dt.datetime(2024, 3, 4)
    rng = random.Random(3)
    when = lambda: at + dt.timedelta(milliseconds=0 if one_time else rng.randrange(80_000_000))
    own = [("1", at.date(), when(), rng.uniform(90, 110), rng.choice([0, 5, 7]), "NORMAL", i) for i in range(trades)]
    own += [("2", at.date(), when(), 50.0, 3, "NORMAL", i) for i in range(9)]
    ticks = sorted({at + dt.timedelta(milliseconds=rng.randrange(80_000_000)) for _ in range(snapshots)} | {at})
    level = [c for i in range(10) for c in (100.0 + i, 10.0 + i)]
    quotes = [(s, at.date(), t, *[v + rng.random() for v in level]) for s in ("1", "2") for t in (ticks if s == "1" else ticks[:7])]
    book = spark.createDataFrame(quotes, f"stock_id string, date date, t timestamp, {', '.join(f'{c} double' for c in B.BOOK)}")
    return spark.createDataFrame(own, "stock_id string, date date, t timestamp, price double, quantity long, flag string, ord long"), book


@pytest.mark.parametrize("one_time", [False, True])
def test_bars_of_a_hot_day_equal_those_of_the_window(spark, one_time):
    trades, book = market(spark, one_time=one_time)
    hot = scan.find_hot([trades, book], DAY, 100)
    assert [r["stock_id"] for r in hot.keys.collect()] == ["1"]
    names = [*DAY, "ord", "bar_t"]
    assert told(bars.asof_forward(trades, book, hot), names) == told(bars.asof_forward(trades, book), names)
    shown = [*DAY, "t", *[F.round(c, 9).alias(c) for c in B.BARS]]
    assert told(bars.trade_bars(trades, book, most=100), shown) == told(bars.trade_bars(trades, book), shown)


def test_features_of_a_hot_day_equal_those_of_the_window(spark):
    trades, book = market(spark, 300)
    own = bars.trade_bars(trades, book)
    auctions = spark.createDataFrame([(s, dt.date(2024, 3, 4), 100.0, 50, 101.0, 9) for s in ("1", "2")], "stock_id string, date date, open_price double, open_qty long, close_price double, close_qty long")
    names = [*DAY, "t", *B.CLOSING_FEATURES]
    assert told(features.closing_rows(book, own, auctions, most=50), names) == told(features.closing_rows(book, own, auctions), names)
    assert told(intraday.intraday_rows(book, most=50), [*DAY, "t", "mid_chg", "tvol_chg"]) == told(intraday.intraday_rows(book), [*DAY, "t", "mid_chg", "tvol_chg"])


@pytest.mark.parametrize("spread", [1, 1000])
def test_parts_of_one_group_are_even(spark, spread):
    """A single group fills all parts about evenly, even where all its rows have one time."""
    df = spark.range(200_000).select(F.lit("a").alias("k"), (F.col("id") % spread).alias("t"), F.col("id").alias("ord"), F.lit(1).alias("v"), F.lit(1).alias("q"))
    hot = scan.find_hot([df], ["k"], 1000)
    assert hot.rows == 200_000
    got = scan._two_levels(df, ["k"], [F.col("t"), F.col("ord")], {"no": ("number", None)}, 16)
    assert got.agg(F.max("no"), F.countDistinct("no")).first() == (200_000, 200_000)
    # what each task of the local scans holds
    parts = df.repartitionByRange(16, "k", "t", "ord").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(parts) == 16 and parts.max() < 2 * parts.mean()
