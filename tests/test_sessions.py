"""Session bars from a stream against those of a table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from microbook.functions import book as B
from microbook.streaming import sessions

SCHEMA = "stock_id string, date date, t timestamp, price double, quantity long, flag string, ord long"


def made(days=2, stocks=3, n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for d in range(days):
        at = dt.datetime(2024, 5, 6 + d, 9)
        for s in range(stocks):
            for i in range(n):
                second = rng.choice([60 * rng.randrange(40), rng.randrange(2400)])
                rows.append((f"s{s}", at.date(), at + dt.timedelta(seconds=second, microseconds=rng.choice([0, 1, 999_999])), round(rng.uniform(90, 110), 2), rng.choice([0, 1, 7, 100]), rng.choice(["NORMAL"] * 4 + ["AUCTION"]), i))
    return rows


def told(df):
    columns = ["stock_id", "date", F.col("t").cast("string").alias("t"), *[F.round(c, 6).alias(c) for c in B.BARS]]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name)
    spark.conf.set(name, sessions.ROCKSDB)
    yield
    spark.conf.set(name, held)


def run(spark, tmp_path, batches, **more):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = sessions.session_bars(stream, **more).writeStream.format("memory").queryName(f"sessions_{tmp_path.name}").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(f"sessions_{tmp_path.name}")


def test_streamed_sessions_equal_those_of_the_table(spark, tmp_path, rocksdb):
    rows = made()
    end = 9 * 3600 + 45 * 60
    rng = random.Random(2)
    # a little out of order; a last trade of another stock moves the watermark past both sessions
    ordered = sorted(rows, key=lambda r: (r[2] + dt.timedelta(seconds=rng.randrange(100)), r[0], r[6]))
    batches = [ordered[i : i + 90] for i in range(0, len(ordered), 90)]
    last = dt.datetime(2024, 5, 9, 9)
    batches += [[("z", last.date(), last, 1.0, 1, "NORMAL", 0)], [("z", last.date(), last + dt.timedelta(seconds=1), 1.0, 1, "NORMAL", 1)]]
    got = run(spark, tmp_path, batches, interval=60, session_end=end).filter("stock_id <> 'z'")
    want = sessions.session_bars(spark.createDataFrame(rows, SCHEMA), interval=60, session_end=end)
    assert told(got) == told(want) and got.filter("quantity = 0 and vwap is not null").count() > 10
    assert got.count() == got.select("stock_id", "date", "t").distinct().count()


def test_bars_of_a_table_by_hand(spark):
    day = dt.datetime(2023, 1, 2, 9)
    rows = [("1", day.date(), day + dt.timedelta(seconds=s), float(p), q, "NORMAL", s) for s, p, q in ((10, 10, 100), (60, 12, 50), (61, 9, 10), (200, 5, 0))]
    got = {r["t"]: r for r in sessions.session_bars(spark.createDataFrame(rows, SCHEMA), 60, 9 * 3600 + 240).collect()}
    assert len(got) == 4
    a, b, c, d = (got[day + dt.timedelta(minutes=m)] for m in (1, 2, 3, 4))
    assert (a.open, a.close, a.quantity) == (10, 12, 150) and a.vwps == pytest.approx(0.9459675, abs=1e-6)
    assert (b.vwap, b.quantity) == (9, 10) and (c.open, c.vwps, c.quantity) == (9, 0, 0) and (d.close, d.quantity) == (9, 0)


def test_merging_trades_one_by_one_gives_the_moments():
    rng = random.Random(5)
    rows = [(rng.randrange(50), i, 1e6 + rng.random(), rng.choice([0, 1, 9])) for i in range(200)]
    bar = None
    for r in rows:
        bar = sessions.merged(bar, *r)
    total = sum(q for *_, q in rows)
    mean = sum(p * q for _, _, p, q in rows) / total
    assert bar[2] == min(rows)[2] and bar[5] == max(rows)[2] and bar[6:9] == (max(r[2] for r in rows), min(r[2] for r in rows), total)
    assert bar[9] == pytest.approx(mean, rel=1e-12) and bar[10] == pytest.approx(sum(q * (p - mean) ** 2 for _, _, p, q in rows), rel=1e-6)
