"""Operators on hand-computed stock-days."""

import datetime as dt
import math

import time

import pytest
from pyspark.sql import functions as F

from microbook.functions import book as B
from microbook.functions import numeric as N
from microbook.operators import auction, bars, clean, dataset, features, intraday, metrics, normalize

D = dt.date(2023, 1, 3)


def at(text, day=D):
    h, m, *s = map(int, text.split(":"))
    return dt.datetime(day.year, day.month, day.day, h, m, *s)


def trades(spark, rows, day=D):
    """rows: (time, price, quantity, flag)"""
    data = [("1", day, at(t, day), float(p) if p is not None else None, q, f, i) for i, (t, p, q, f) in enumerate(rows)]
    return spark.createDataFrame(data, "stock_id string, date date, t timestamp, price double, quantity long, flag string, ord long")


def book(spark, times, day=D, **columns):
    """columns override the default levels: one value or one per snapshot."""
    rows = []
    for k, t in enumerate(times):
        v = {}
        for i in range(1, 6):
            v |= {f"bb{i}": 101.0 - i, f"bbvol{i}": 10.0, f"ba{i}": 100.0 + i, f"bavol{i}": 10.0}
        v |= {c: (x[k] if isinstance(x, list) else x) for c, x in columns.items()}
        rows.append(("1", day, at(t, day), "q", *[v[c] for c in B.BOOK]))
    return spark.createDataFrame(rows, "stock_id string, date date, t timestamp, nature string, " + ", ".join(f"{c} double" for c in B.BOOK))


def rows_of(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


CLOCK = ["09:00:00", "09:01:00", "09:02:00"]
TICKS = [("09:00:30", 10, 100, "NORMAL"), ("09:01:00", 12, 50, "NORMAL"), ("09:02:30", 9, 10, "NORMAL")]


def test_bars_bin_to_the_next_snapshot(spark):
    a, b, c = rows_of(bars.trade_bars(trades(spark, TICKS), book(spark, CLOCK)), "t")
    assert a["vwap"] is None and a["open"] is None and a["vwps"] == 0 and a["quantity"] == 0
    assert (b["open"], b["close"], b["high"], b["low"], b["quantity"]) == (10, 12, 12, 10, 150)
    assert b["vwap"] == pytest.approx(10.6666667) and b["vwps"] == pytest.approx(0.9459675, abs=1e-6)
    assert [c[x] for x in B.BAR_PRICES] == pytest.approx([10.6666667] * 5) and c["vwps"] == 0 and c["quantity"] == 0


def test_zero_volume_is_an_empty_bar(spark):
    rows = [(t, p, 0 if t != "09:02:30" else q, f) for t, p, q, f in TICKS]
    assert all(x["vwap"] is None for x in rows_of(bars.trade_bars(trades(spark, rows), book(spark, CLOCK)), "t"))


def test_bars_do_not_depend_on_partitioning(spark):
    t, b = trades(spark, TICKS), book(spark, CLOCK)
    assert rows_of(bars.trade_bars(t.repartition(7).orderBy(F.rand(1)), b.repartition(3)), "t") == rows_of(bars.trade_bars(t, b), "t")


def test_duplicate_bar_times_fail(spark):
    with pytest.raises(Exception, match="duplicate bar"):
        clean.assert_unique_times(book(spark, ["09:00:00", "09:00:00"])).collect()


def test_capped_trades_reject_the_day_on_normal_prices_only(spark):
    ok = trades(spark, [("09:00:00", 2000, 1, "AUCTION"), ("09:01:00", 5, 1, "NORMAL")])
    assert clean.capped_trades(ok, 1000).count() == 1
    bad = trades(spark, [("09:00:00", 5, 1, "NORMAL"), ("09:01:00", 2000, 1, "NORMAL")])
    assert clean.capped_trades(bad, 1000).count() == 0
    nan = trades(spark, [("09:00:00", float("nan"), 1, "NORMAL"), ("09:01:00", 5, 1, "NORMAL")])
    assert clean.capped_trades(nan, 1000).count() == 2


def test_levels_are_repaired_in_a_cascade(spark):
    b = book(spark, ["09:00:00"], bb1=100.0, bb2=0.0, bb3=None, bbvol3=None, bavol2=-5.0)
    (x,) = rows_of(clean.repair_levels(b), "t")
    assert (x["bb2"], x["bb3"], x["bbvol3"], x["bavol2"]) == (100, 100, 0, -5) and "nature" not in x


@pytest.mark.parametrize("broken", [{"ba1": 0.0}, {"bb4": -1.0}, {"ba3": 2e6}, {"bb1": None}])
def test_one_bad_price_rejects_the_day(spark, broken):
    (name, value) = next(iter(broken.items()))
    b = book(spark, CLOCK, **{name: [101.0, value, 101.0]})
    assert clean.clean_book(b).count() == 0 and clean.rejected_days(b).count() == 1


def test_missing_level_one_volume_survives_cleaning_but_not_features(spark):
    b = book(spark, CLOCK, bbvol1=[10.0, None, 10.0])
    assert clean.clean_book(b).count() == 3 and clean.clean_book(b, strict=True).count() == 0
    assert features.complete_days(intraday.intraday_rows(clean.clean_book(b)), B.INTRADAY_FEATURES).count() == 0


def phases(spark, flags, prices=None):
    rows = [(f"09:{i:02d}:00", (prices or range(5, 5 + len(flags)))[i], 1, {"A": "AUCTION", "N": "NORMAL"}[f]) for i, f in enumerate(flags)]
    return auction.auction_prices(trades(spark, rows))


def test_auctions_by_row_order(spark):
    (x,) = rows_of(phases(spark, "AANANAA"), "date")
    assert (x["open_price"], x["open_qty"], x["close_price"], x["close_qty"]) == (5, 2, 10, 2)


@pytest.mark.parametrize("flags", ["NA", "AN", "A", "N", "ANNN"])
def test_days_without_both_auctions_have_none(spark, flags):
    assert phases(spark, flags).count() == 0


def one_day(spark):
    b = book(spark, CLOCK[:2], bb1=[100.0, 100.5], ba1=[101.0, 101.5])
    a = spark.createDataFrame([("1", D, 100.0, 500, 102.0, 10)], "stock_id string, date date, open_price double, open_qty long, close_price double, close_qty long")
    own = spark.createDataFrame([("1", D, at(t), *[None] * 5, 0.0, q) for t, q in zip(CLOCK, (0, 150))], "stock_id string, date date, t timestamp, open double, close double, high double, low double, vwap double, vwps double, quantity long")
    return b, own, a


def test_closing_features(spark):
    x, y = rows_of(features.closing_rows(*one_day(spark)), "t")
    assert x["ret_bb1"] == pytest.approx(-0.00498754, abs=1e-7) and x["ret_ba1"] == pytest.approx(0.00496279, abs=1e-7)
    assert x["mid_chg"] == pytest.approx(0.00498754, abs=1e-7) and y["mid_chg"] == pytest.approx(math.log(101 / 100.5))
    assert x["cumvol_chg"] == 0 and y["cumvol_chg"] == pytest.approx(0.26236426) and x["tvol_chg"] == 0
    assert x["ret_open"] == pytest.approx(math.log(100 / 100.5))


def test_closing_label(spark):
    b, _, a = one_day(spark)
    (x,) = rows_of(features.closing_label(b, a, 2), "date")
    assert x["y"] == pytest.approx(0.01233061, abs=1e-7)
    assert features.closing_label(b, a, 3).count() == 0


def test_exogenous_inputs(spark):
    days = [dt.date(2023, 1, 5), dt.date(2023, 1, 6), dt.date(2023, 1, 9), dt.date(2023, 1, 11)]
    a = spark.createDataFrame([("1", d, 100.0, 1, 99.0, 1) for d in days], "stock_id string, date date, open_price double, open_qty long, close_price double, close_qty long")
    labels = spark.createDataFrame([("1", d, float(i)) for i, d in enumerate(days)], "stock_id string, date date, y double")
    got = rows_of(features.exogenous(labels, a), "date")
    # Thursday -> Friday, Friday -> Monday; Wednesday misses Tuesday
    assert [(x["date"], x["z1"]) for x in got] == [(days[1], 0.0), (days[2], 1.0)]
    assert got[0]["z2"] == pytest.approx(0.01005034, abs=1e-7)


def test_previous_business_day(spark):
    d = spark.createDataFrame([(dt.date(2023, 1, 9),), (dt.date(2023, 1, 8),), (dt.date(2023, 1, 10),)], "date date")
    assert [r.p for r in d.select(B.prev_business_day(F.col("date")).alias("p")).collect()] == [dt.date(2023, 1, 6), dt.date(2023, 1, 7), dt.date(2023, 1, 9)]


def test_intraday_label(spark):
    mids = [100.0, 101.0, 102.0, 103.0]
    b = book(spark, ["09:00:00", "09:01:00", "09:02:00", "09:03:00"], bb1=[m - 1 for m in mids], ba1=[m + 1 for m in mids])
    got = rows_of(intraday.rolling_label(intraday.intraday_rows(b), 2), "t")
    assert [g["y"] for g in got] == [None, pytest.approx(0.01970507, abs=1e-7), None, None]
    (x,) = rows_of(intraday.intraday_samples(b, sequence=2, horizon=2, keep=5), "anchor_t")
    assert len(x["x"]) == 2 and len(x["x"][0]) == 22 and x["y"] == pytest.approx(0.0197051, abs=1e-6)


def test_trailing_normalisation(spark):
    rows = [(d, v) for d, pool in enumerate([(1.0, 2.0), (3.0, 4.0), (5.0, 6.0), (7.0,)]) for v in pool]
    v = spark.createDataFrame(rows, "date int, value double")
    got = rows_of(normalize.trailing_normalize(v, 3, []), "date")
    assert len(got) == 1 and got[0]["date"] == 3 and got[0]["value"] == pytest.approx(1.87082869)


def test_all_zero_deviation_fails(spark):
    s = spark.createDataFrame([(d, str(i), [[1.0, 2.0]], 0.1) for d in range(3) for i in range(2)], "date int, stock_id string, x array<array<float>>, y double")
    with pytest.raises(Exception, match="standard deviations"):
        normalize.normalize_samples(s, 2).collect()


PREDICTIONS = [(D, 2.0, 0.01), (D, -1.0, -0.02), (D, 0.5, 0.03)]


def predictions(spark, rows=PREDICTIONS):
    return spark.createDataFrame(rows, "date date, logit double, y double")


def test_positions_and_returns(spark):
    p = predictions(spark)
    assert [x["pos"] for x in rows_of(metrics.positions(p, 0.6, parity=True), F.desc("logit"))] == [1, 1, 0]
    assert metrics.daily_returns(p, 0.6, parity=True).first()["ret"] == pytest.approx(0.01333333)
    assert metrics.daily_returns(p, 0.6, weighted=True, parity=True).first()["ret"] == pytest.approx(0.01364851)
    assert metrics.daily_returns(p, 0.99, parity=True).first()["ret"] == 1.0
    assert metrics.mean_loss(p).first()["loss"] == pytest.approx(0.30475556)
    assert [x["pos"] for x in rows_of(metrics.positions(p, 0.6), F.desc("logit"))] == [1, 1, -1]


def test_profit_metrics(spark):
    r = spark.createDataFrame([(D + dt.timedelta(i), x) for i, x in enumerate((1.02, 0.97, 1.01))], "date date, ret double")
    assert metrics.win_rate(r).first()[0] == pytest.approx(0.66666667)
    assert metrics.expected_return(r).first()[0] == pytest.approx(-0.00023542, abs=1e-7)
    assert metrics.sharpe_ratio(r).first()[0] == pytest.approx(-0.00883891, abs=1e-6)
    assert metrics.maximum_drawdown(r).first()[0] == pytest.approx(0.03045921, abs=1e-7)
    assert metrics.total_return(r).first()[0] == pytest.approx(-0.000706, abs=1e-7)
    assert rows_of(metrics.cumulative_return(r), "date")[1]["cum_return"] == pytest.approx(1.02 * 0.97 - 1)


def test_losing_gross_returns_are_nan(spark):
    r = spark.createDataFrame([(D, -0.5)], "date date, ret double")
    assert math.isnan(metrics.expected_return(r).first()[0])


def test_date_split(spark):
    s = spark.createDataFrame([(d, "a") for d in range(1, 7)], "date int, stock_id string")
    got = {x["date"]: x["split"] for x in rows_of(dataset.date_split(s, 3, 1, 1, start=1), "date")}
    assert got == {2: "train", 3: "train", 4: "train", 5: "validation", 6: "test"}
    assert rows_of(dataset.date_split(s, 2, 1), "date")[-1]["split"] == "test"
    assert len(rows_of(dataset.date_split(s, 2, 1, parity=True), "date")) == 3
    with pytest.raises(ValueError):
        dataset.date_split(s, 5, 1, 1)
    with pytest.raises(ValueError):
        dataset.date_split(s.limit(0), 1, 1, 1)


def test_feature_selection(spark):
    s = spark.createDataFrame([("a", [[float(t * 100 + f) for f in range(29)] for t in range(5)], 1.0, 2.0)], "stock_id string, x array<array<double>>, z1 double, z2 double")
    x = dataset.select_features(s, 2, horizon=1).first()
    assert [r[0] for r in x["x"]] == [200.0, 300.0] and len(x["x"][0]) == 22 and "z1" not in x.asDict()
    x = dataset.select_features(s, 9, use_trading=True, use_exogenous=True).first()
    assert len(x["x"]) == 5 and len(x["x"][0]) == 29 and x["z1"] == 1.0


def test_ieee_helpers(spark):
    d = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 1.0)], "a double, b double")
    q = [r[0] for r in d.select(N.ieee_div(F.col("a"), F.col("b"))).collect()]
    assert q[:2] == [math.inf, -math.inf] and math.isnan(q[2]) and q[3:] == [2.0, None]
    g = [r[0] for r in d.select(N.ieee_ln(F.col("a"))).collect()]
    assert g[0] == 0 and math.isnan(g[1]) and g[2] == -math.inf and g[4] is None


def test_binary_target_treats_missing_as_zero(spark):
    d = spark.createDataFrame([(0.1,), (0.0,), (float("nan"),), (None,), (-1.0,)], "y double")
    assert [r.target for r in dataset.with_target(d).collect()] == [1, 0, 0, 0, 0]


def test_early_stopping_replay(spark):
    losses = spark.createDataFrame(list(enumerate([5.0, 4.0, 4.0, 4.5, 3.0], 1)), "epoch long, loss double")
    got = rows_of(metrics.early_stopping(losses, 2), "epoch")
    assert [(x["epoch"], x["best_epoch"], x["waited"]) for x in got] == [(1, 1, 0), (2, 2, 0), (3, 2, 1), (4, 2, 2)]


def test_empty_inputs_stay_empty(spark):
    t, b = trades(spark, TICKS).limit(0), book(spark, CLOCK).limit(0)
    assert bars.trade_bars(t, b).count() == 0 and clean.clean_book(b).count() == 0 and auction.auction_prices(t).count() == 0


def test_predictions_without_targets_are_an_error(spark):
    p = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "date int, stock_id string")
    metrics.assert_aligned(p, p.orderBy("stock_id"))
    for other in (p.limit(2), p.unionAll(p.limit(1))):
        with pytest.raises(ValueError, match="differ"):
            metrics.assert_aligned(p, other)


def test_the_as_of_join_is_linear_in_a_stock_day(spark):
    def seconds(n):
        trades = spark.range(n).selectExpr("'s' as stock_id", "date'2023-01-02' as date", "timestamp_seconds(1672650000 + id / 100) as t", "id as ord")
        book = spark.range(5).selectExpr("'s' as stock_id", "date'2023-01-02' as date", f"timestamp_seconds(1672650000 + id * {n} / 400) as t")
        began = time.time()
        assert bars.asof_forward(trades, book).selectExpr("count(*) as n", "count_if(bar_t < t) as early").first() == (n, 0)
        return time.time() - began

    seconds(1000)
    assert seconds(80_000) < 10
