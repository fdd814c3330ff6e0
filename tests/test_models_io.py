"""Sources, fixtures, networks, training and trials."""

import datetime as dt
import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from microbook.functions import book as B
from microbook.models import networks, sampler, scoring, training
from microbook.operators import auction, bars, clean, features, normalize
from microbook.sources import fixtures, io


def test_raw_files_round_trip(spark, tmp_path):
    rows = "t,price,quantity,flag\n2023-01-02T09:00:00.123456+00:00,10.5,3,AUCTION\n2023-01-02 09:00:01,11,4,NORMAL\nnot a time,1,1,NORMAL\n"
    with gzip.open(tmp_path / "stock_1001.gz", "wt") as f:
        f.write(rows)
    got = io.read_raw_trades(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.stock_id for r in got] == ["1001"] * 3 and got[0].t.microsecond == 123456 and got[2].t is None
    assert got[1].date == dt.date(2023, 1, 2) and got[1].quantity == 4


def test_raw_book_is_read_by_name(spark, tmp_path):
    names = ["t", "nature", *B.BOOK_COLUMNS_MOCK]
    with gzip.open(tmp_path / "stock_7.gz", "wt") as f:
        f.write(",".join(names) + "\n" + ",".join(["2023-01-02T09:00:00.000000+00:00", "q", *map(str, range(20))]) + "\n")
    (x,) = io.read_raw_book(spark, str(tmp_path)).collect()
    assert x.ba1 == 2.0 and x.bb2 == 4.0 and x.stock_id == "7"


def test_raw_books_of_several_column_orders(spark, tmp_path):
    names = ["t", "nature", *B.BOOK_COLUMNS_MOCK]
    for stock, order in (("1", names), ("2", names[:2] + names[:1:-1])):
        with gzip.open(tmp_path / f"stock_{stock}.gz", "wt") as f:
            value = {n: str(k) for k, n in enumerate(names)} | {"t": "2023-01-02T09:00:00.000000+00:00", "nature": "q"}
            f.write(",".join(order) + "\n" + ",".join(value[n] for n in order) + "\n")
    a, b = io.read_raw_book(spark, str(tmp_path), mixed=True).orderBy("stock_id").select(*B.BOOK).collect()
    assert a == b
    with pytest.raises(Exception, match="CSV|header"):
        io.read_raw_book(spark, str(tmp_path)).collect()


def test_day_tables_prune_by_month_and_stock(spark, tmp_path):
    rows = fixtures.mock_trades(spark, stocks=2, days=40, expected=5)
    io.write_days(rows, str(tmp_path / "t"))
    got = io.read_days(spark, str(tmp_path / "t"), (2023, 2), stocks=["1002"])
    assert {r.stock_id for r in got.collect()} == {"1002"} and got.agg(F.min("date")).first()[0] == dt.date(2023, 2, 1)
    assert {r.stock_id for r in io.read_days(spark, str(tmp_path / "t"), stocks=["1001"]).select("stock_id").distinct().collect()} == {"1001"}
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString()


def test_month_range(spark):
    assert [r.month for r in io.month_range(spark, (2022, 12), (2023, 2)).collect()] == ["2022-12", "2023-01", "2023-02"]


def test_config_and_trials(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"lstm": {"hidden_size": 4}}))
    assert io.load_config(str(tmp_path / "c.json"), "lstm", {"lstm_size": 1}) == {"hidden_size": 4, "lstm_size": 1}
    with pytest.raises(KeyError):
        io.load_config(str(tmp_path / "c.json"), "cnn")
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("lstm:\n  hidden_size: 4\n  kernel_size: [3, 2]\nlinear:\n")
    assert io.load_config(str(tmp_path / "c.yaml"), "lstm") == {"hidden_size": 4, "kernel_size": [3, 2]} and io.load_config(str(tmp_path / "c.yaml"), "linear") == {}
    t = spark.createDataFrame([(1, 0.5), (2, 0.4)], "trial int, loss double")
    assert io.append_trials(t, str(tmp_path / "s")).count() == 2
    assert io.append_trials(t.unionAll(spark.createDataFrame([(3, 0.3)], t.schema)), str(tmp_path / "s")).count() == 3
    other = io.append_trials(t, str(tmp_path / "s"), study="other")
    assert other.count() == 2
    io.write_trials_csv(other, str(tmp_path / "csv"))
    assert [r.trial for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["1", "2"]


def test_missing_samples_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.read_samples(spark, str(tmp_path / "none"))


def test_mock_market_runs_end_to_end(spark):
    trades, book = fixtures.mock_trades(spark, 2, 9, expected=60), clean.clean_book(fixtures.mock_book(spark, 2, 9))
    assert book.count() == 2 * 9 * 120
    own = bars.trade_bars(clean.normal_trades(clean.on_book_days(trades, book)), book)
    samples = features.closing_samples(book, own, auction.auction_prices(trades), sequence=20, horizon=5)
    got = samples.collect()
    # the first day and the days after a missing one have no previous day; weekends are days as well here, but Monday looks back to Friday
    assert len(got) == 2 * 8 and len(got[0].x) == 20 and len(got[0].x[0]) == 29
    scaled = normalize.normalize_samples(samples, 3).collect()
    assert {r.date for r in scaled} == {dt.date(2023, 1, 3) + dt.timedelta(d) for d in range(3, 8)}


def test_mock_rows_do_not_depend_on_partitions(spark):
    a = fixtures.mock_trades(spark, 2, 3).orderBy("stock_id", "date", "ord").collect()
    assert a == fixtures.mock_trades(spark, 2, 3).repartition(5).orderBy("stock_id", "date", "ord").collect()


@pytest.mark.parametrize("family,p", [("cnn", {"conv_channels": [3], "kernel_size": [3]}), ("lstm", {"hidden_size": 4, "lstm_size": 1}), ("transformer", {"embedding_size": 6, "num_heads": 2, "dim_feedforward": 8, "num_layers": 1})])
def test_dropout_acts_in_training_only(family, p):
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((400, 5, 3)), rng.integers(0, 2, 400).astype(float)
    plain, dropped = (networks.build(family, 3, 5, seed=1, **p, dropout=d) for d in (0, 0.5))
    assert np.array_equal(networks.logits(plain, x), networks.logits(dropped, x))
    assert abs((networks.encode(dropped, x, np.random.default_rng(0)) == 0).mean() - (networks.encode(plain, x) == 0).mean()) > 0.15
    a, b, c = (training.train(m, [(x, None, y)], [(x, None, y)], 3, 0.01)[0]["weights"] for m in (plain, dropped, dropped))
    assert all(np.array_equal(b[k], c[k]) for k in b) and not np.array_equal(a["head.w"], b["head.w"])
    with pytest.raises(ValueError, match="dropout"):
        networks.build("linear", 3, 5, dropout=0.5)


@pytest.mark.parametrize("family,p", [("linear", {}), ("cnn", {"conv_channels": [3, 2], "kernel_size": [3, 2]}), ("lstm", {"hidden_size": 4, "lstm_size": 2}), ("transformer", {"embedding_size": 6, "num_heads": 2, "dim_feedforward": 8, "num_layers": 1})])
@pytest.mark.parametrize("exogenous", [0, 2])
def test_networks_score_samples_alike_in_any_batch(family, p, exogenous):
    m = networks.build(family, 5, 7, exogenous, seed=1, **p)
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=(6, 7, 5)), rng.normal(size=(6, exogenous)) if exogenous else None
    whole = networks.logits(m, x, z)
    assert whole.shape == (6,)
    for i in range(6):
        assert networks.logits(m, x[i], z[i : i + 1] if exogenous else None)[0] == pytest.approx(whole[i])


def test_convolution_against_loops():
    m = networks.build("cnn", 2, 6, 0, seed=3, conv_channels=[2], kernel_size=[3], stride=2, padding=1)
    x = np.random.default_rng(1).normal(size=(1, 6, 2))
    w, b = m["weights"]["conv0.w"], m["weights"]["conv0.b"]
    padded = np.pad(x[0].T, ((0, 0), (1, 1)))
    want = [max(0.0, (padded[:, s : s + 3] * w[o]).sum() + b[o]) for o in range(2) for s in (0, 2, 4)]
    assert networks.encode(m, x)[0] == pytest.approx(want)
    with pytest.raises(ValueError):
        networks.build("cnn", 2, 2, conv_channels=[2], kernel_size=[5])


def test_lstm_cell_by_hand():
    m = networks.build("lstm", 1, 1, 0, seed=5, hidden_size=1, lstm_size=1)
    w = m["weights"]
    i, f, g, o = w["lstm0.x"][:, 0] * 0.7 + w["lstm0.b"]
    want = 1 / (1 + np.exp(-o)) * np.tanh(1 / (1 + np.exp(-i)) * np.tanh(g))
    assert networks.encode(m, np.array([[[0.7]]]))[0, 0] == pytest.approx(want) and f is not None


def test_linear_training_learns():
    rng = np.random.default_rng(2)
    days = [(x := rng.normal(size=(40, 3, 2)), None, (x[:, 0, 0] > 0).astype(float)) for _ in range(5)]
    best, history = training.train(networks.build("linear", 2, 3), days[:4], days[4:], epochs=60, rate=0.05)
    assert history[-1][1] < history[0][1] and training.evaluate(best, days[4:]) < 0.45
    _, short = training.train(networks.build("linear", 2, 3), days[:4], [(days[0][0], None, 1 - days[0][2])], epochs=60, rate=0.05, patience=3)
    assert len(short) < 60


def test_scoring_and_linear_expression_agree(spark):
    m = networks.build("linear", 2, 2, 0, seed=7)
    s = spark.createDataFrame([("a", [[1.0, 2.0], [3.0, -4.0]])], "stock_id string, x array<array<double>>")
    a = scoring.score(s, m).first()["logit"]
    b = scoring.linear_logit(s, m["weights"]["head.w"].tolist(), float(m["weights"]["head.b"][0])).first()["logit"]
    assert a == pytest.approx(b)


def test_parameter_draws_stay_in_range():
    got = [sampler.draw({"a": [2, 8, 2], "r": [0.1, 0.3, 0.1]}, t) for t in range(20)]
    assert {g["a"] for g in got} <= {2, 4, 6, 8} and all(0.1 <= g["r"] <= 0.3 + 1e-9 for g in got)


FAMILIES = [
    ("linear", {}),
    ("cnn", {"conv_channels": [3, 2], "kernel_size": [3, 2], "stride": 2, "padding": 1, "dilation": 2}),
    ("lstm", {"hidden_size": 4, "lstm_size": 2}),
    ("transformer", {"embedding_size": 6, "num_heads": 2, "dim_feedforward": 8, "num_layers": 2}),
]


@pytest.mark.parametrize("dropout", [0, 0.3])
@pytest.mark.parametrize("family,p", FAMILIES)
def test_gradients_against_finite_differences(family, p, dropout):
    if family == "linear" and dropout:
        pytest.skip("none there")
    m = networks.build(family, 5, 12, 2, seed=1, **p, **({"dropout": dropout} if dropout else {}))
    rng = np.random.default_rng(0)
    x, z, y = rng.normal(size=(4, 12, 5)), rng.normal(size=(4, 2)), rng.integers(0, 2, 4).astype(float)
    loss = lambda: networks.loss_of(networks.logits(m, x, z, np.random.default_rng(5)), y)
    got = training.gradients(m, x, z, y, np.random.default_rng(5))
    assert set(got) == set(m["weights"])
    for k, w in m["weights"].items():
        flat, own = w.reshape(-1), got[k].reshape(-1)
        for i in rng.integers(0, len(flat), 4):
            held, size = flat[i], 1e-6
            flat[i] = held + size
            up = loss()
            flat[i] = held - size
            down = loss()
            flat[i] = held
            assert own[i] == pytest.approx((up - down) / (2 * size), abs=1e-6), (k, i)


@pytest.mark.parametrize("family,p", FAMILIES)
def test_every_family_learns(family, p):
    rng = np.random.default_rng(4)
    days = [(x := rng.normal(size=(60, 12, 5)), None, (x[:, :, 0].sum(1) > 0).astype(float)) for _ in range(4)]
    best, history = training.train(networks.build(family, 5, 12, seed=2, **p), days[:3], days[3:], epochs=40, rate=0.02)
    assert training.evaluate(best, days[:3]) < 0.8 * history[0][1]


@pytest.mark.parametrize("dropout", [0, 0.3])
def test_training_on_the_executors_gives_the_same_model(spark, dropout):
    """One job over rows dealt to several tasks, against plain training over whole days; dropout is drawn by row."""
    rng = np.random.default_rng(6)
    rows = [(d, f"s{i}", rng.normal(size=(3, 2)).tolist(), float(rng.normal()), 0.1, "train" if d < 3 else "validation") for d in range(4) for i in range(15)]
    split = spark.createDataFrame(rows, "date int, stock_id string, x array<array<double>>, y double, z1 double, split string")
    m = networks.build("lstm", 2, 3, 1, seed=3, hidden_size=3, lstm_size=1, dropout=dropout)
    keys = {(r["date"], r["stock_id"]): r["key"] for r in split.select("date", "stock_id", scoring.row_key().alias("key")).collect()}
    days = []
    for d in range(4):
        own = [r for r in rows if r[0] == d]
        days.append((np.array([r[2] for r in own]), np.full((15, 1), 0.1), np.array([float(r[3] > 0) for r in own]), np.array([keys[d, r[1]] for r in own])))
    want, history = training.train(m, days[:3], days[3:], 4, 0.01, seed=5)
    for tasks, segment in ((1, 50), (4, 3)):
        got, told = scoring.fit(split, m, 4, 0.01, seed=5, tasks=tasks, segment=segment)
        assert np.allclose(told, history) and all(np.allclose(got["weights"][k], want["weights"][k]) for k in want["weights"])
    losses = {r.split: r for r in scoring.evaluate_splits(split, got).collect()}
    assert losses["validation"].loss == pytest.approx(min(h[2] for h in told)) and losses["train"].rows == 45


def test_search_spaces_are_checked():
    with pytest.raises(ValueError, match="hidden_size"):
        sampler.draw({"hidden_size": [1, 2, 1]}, 0, family="cnn")
    got = sampler.draw({"layers": [3, 3, 1], "conv_channels": [2, 9, 1], "kernel_size": [2, 3, 1], "sequence_size": [5, 7, 1]}, 0, family="cnn")
    assert len(got["conv_channels"]) == len(got["kernel_size"]) == 3 and 5 <= got["sequence_size"] <= 7
    assert sampler.draw({"embedding_size": [5, 5, 1], "num_heads": [2, 2, 1]}, 0, family="transformer")["embedding_size"] == 6
