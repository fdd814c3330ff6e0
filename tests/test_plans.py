"""Whole plans: raw files to samples to predictions, the stream of bars, and the entry points."""

import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from microbook.functions import book as B
from microbook.models import scoring
from microbook.operators import dataset, metrics
from microbook.plans import catalogue, market
from microbook.sources import fixtures
from microbook.streaming.bars import stream_bars


def raw_files(spark, path):
    """gzip CSV files as an exchange would send them, one per stock and kind."""
    for kind, df, columns in (("trade", fixtures.mock_trades(spark, 2, 9, expected=60), ["t", "price", "quantity", "flag"]), ("quote", fixtures.mock_book(spark, 2, 9), ["t", "nature", *B.BOOK_COLUMNS_MOCK])):
        (path / kind).mkdir()
        rows = df.withColumn("t", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).orderBy("stock_id", "date", *(["ord"] if kind == "trade" else ["t"])).toPandas()
        for stock, own in rows.groupby("stock_id"):
            with gzip.open(path / kind / f"stock_{stock}.gz", "wt") as f:
                own[columns].to_csv(f, index=False)


def test_raw_files_to_predictions(spark, tmp_path):
    raw_files(spark, tmp_path)
    market.process(spark, str(tmp_path / "trade"), str(tmp_path / "quote"), str(tmp_path / "p"))
    data = market.closing_dataset(spark, str(tmp_path / "p"), str(tmp_path / "c"), (2023, 1), (2023, 1), sequence=20, horizon=5, days=2)
    # nine days, the first has no previous one, the next two only feed the normalisation
    assert data.count() == 2 * 6
    split = dataset.date_split(dataset.select_features(data, 10, use_trading=True, use_exogenous=True), 3, 1, 2)
    model, history = scoring.fit(split, scoring.seeded("lstm", 29, 10, exogenous=2, hidden_size=4, lstm_size=1), epochs=2, rate=1e-3)
    told = scoring.predict(split.filter("split = 'test'"), model)
    assert told.count() == 4 and len(history) == 2
    assert 0 <= metrics.accuracy(told).first()[0] <= 100 and metrics.daily_returns(told).count() == 2
    again = market.intraday_dataset(spark, str(tmp_path / "p"), str(tmp_path / "i"), (2023, 1), (2023, 1), sequence=20, horizon=5, keep=2, days=2)
    assert again.count() == 2 * 2 * 7 and len(again.first()["x"]) == 20


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    day = dt.datetime(2023, 1, 2, 9)
    rows = [("1", day + dt.timedelta(seconds=s), float(p), q, "NORMAL", s) for s, p, q in ((10, 10, 100), (60, 12, 50), (61, 9, 10), (150, 5, 0))]
    trades = spark.createDataFrame(rows, "stock_id string, t timestamp, price double, quantity long, flag string, ord long")
    trades.write.parquet(str(tmp_path / "in"))
    batch = {(r.stock_id, r.t): r for r in stream_bars(trades).collect()}
    first = batch["1", day + dt.timedelta(minutes=1)]
    assert (first.open, first.close, first.quantity) == (10, 12, 150) and first.vwps == pytest.approx(0.9459675, abs=1e-6)
    assert batch["1", day + dt.timedelta(minutes=3)].vwap is None
    stream = spark.readStream.schema(trades.schema).parquet(str(tmp_path / "in"))
    q = stream_bars(stream).writeStream.format("memory").queryName("bars_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.stock_id, r.t): r for r in spark.table("bars_out").collect()} == batch


def test_entry_points():
    import __spark_entry__ as entry

    names = entry.queries()
    assert len(names) >= 55 and set(entry.oracle_sql()) <= set(names)


def test_mock_queries_generate_the_reference_market(spark):
    for name in ("mock_trades", "mock_book"):
        assert catalogue.QUERIES[name](spark, "").select("stock_id", "date").distinct().count() == 10 * 60
