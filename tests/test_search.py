"""The Parzen sampler, studies that runs share and resume, walk-forward over streamed days, reading of nested lists."""

import threading

import numpy as np
import pyarrow as pa
import pytest

from microbook.models import networks, sampler, scoring, search, training
from microbook.sources.studies import Study, create_new


def best_of(propose, f, trials=60):
    finished = []
    for t in range(trials):
        flat = propose(t, finished)
        finished.append((flat, f(flat)))
    return min(loss for _, loss in finished)


def test_parzen_sampler_beats_random_draws():
    space = {"a": [0, 199, 1], "b": [0.0, 1.0, 0.005], "c": [-50, 50, 1]}
    f = lambda p: abs(p["a"] - 137) / 200 + abs(p["b"] - 0.31) + (p["c"] / 50 + 0.4) ** 2
    own = [best_of(lambda t, seen, s=s: sampler.propose(space, seen, [], t, s), f) for s in range(12)]
    plain = [best_of(lambda t, seen, s=s: sampler.propose(space, [], [], t, s), f) for s in range(12)]
    assert np.mean(own) < 0.6 * np.mean(plain) and np.median(own) < np.median(plain)


def test_proposals_are_repeatable_and_in_range():
    space = {"layers": [1, 3, 1], "conv_channels": [2, 8, 2], "kernel_size": [1, 3, 1], "dropout": [0.0, 0.5, 0.1], "stride": [1, 1, 1]}
    rng = np.random.default_rng(1)
    finished = [(sampler.propose(space, [], [], t, 9, "cnn"), float(rng.random()) if t % 5 else float("nan")) for t in range(40)]
    for t in range(40, 60):
        flat = sampler.propose(space, finished, [finished[0][0]], t, 9, "cnn")
        assert flat == sampler.propose(space, finished, [finished[0][0]], t, 9, "cnn")
        p = sampler.parameters(flat)
        assert len(p["conv_channels"]) == len(p["kernel_size"]) and set(p["conv_channels"]) <= {2, 4, 6, 8} and 0 <= p["dropout"] <= 0.5 + 1e-9 and p["stride"] == 1
        networks.build("cnn", 3, 12, **p)
    assert len({str(sampler.propose(space, finished, [], t, 9, "cnn")) for t in range(40, 60)}) > 1


@pytest.mark.parametrize(("k", "at"), [(1, [0]), (5, []), (5, [2]), (100, [0, 99, 50, 50])])
def test_densities_add_up_and_peak_where_values_are(k, at):
    p = sampler.density(k, np.array(at))
    assert p.shape == (k,) and p.sum() == pytest.approx(1) and (p > 0).all()
    if at == [2]:
        assert p.argmax() == 2


def test_pending_trials_push_a_round_apart():
    """With nothing but pending copies of the best value, the sampler moves away from it."""
    finished = [({"a": 50 if i < 3 else 90}, 0.0 if i < 3 else 1.0) for i in range(20)]
    alone = [sampler.propose({"a": [0, 99, 1]}, finished, [], t)["a"] for t in range(30)]
    crowded = [sampler.propose({"a": [0, 99, 1]}, finished, [{"a": 50}] * 60, t)["a"] for t in range(30)]
    assert np.mean([abs(a - 50) for a in crowded]) > np.mean([abs(a - 50) for a in alone])


# studies


def numbers(study):
    return [(r["trial"], r["loss"], r["state"]) for r in study.trials().orderBy("trial").collect()]


def test_a_file_is_created_once(spark, tmp_path):
    assert create_new(spark, f"file://{tmp_path}/s", "a", "one") and not create_new(spark, f"{tmp_path}/s", "a", "two")
    assert (tmp_path / "s" / "a").read_text() == "one" and [p.name for p in (tmp_path / "s").iterdir()] == ["a"]


def test_a_study_is_resumed(spark, tmp_path):
    first = Study(spark, str(tmp_path), "x", owner="me")
    propose = lambda n, finished, pending: {"a": n, "seen": len(finished), "running": len(pending)}
    claimed = first.claim(3, 5, propose)
    assert [c["trial"] for c in claimed] == [0, 1, 2] and claimed[2]["parameters"] == {"a": 2, "seen": 0, "running": 2}
    assert first.tell({0: 0.5, 1: 0.25, 9: 1.0}) == 2 and first.tell({0: 0.1}) == 0
    # killed here: another owner leaves the claim of trial 2 alone, the same one takes it over with its values
    other = Study(spark, str(tmp_path), "x", owner="you")
    assert [c["trial"] for c in other.claim(1, 5, propose)] == [3]
    resumed = Study(spark, str(tmp_path), "x", owner="me")
    again = resumed.claim(2, 5, propose)
    assert [(c["trial"], c["parameters"]["a"]) for c in again] == [(2, 2), (4, 4)] and again[1]["parameters"]["seen"] == 2
    assert [c["trial"] for c in Study(spark, str(tmp_path), "x", owner="late", lease=0).claim(9, 5, propose)] == [2, 3, 4]
    assert numbers(resumed) == [(0, 0.5, "finished"), (1, 0.25, "finished"), (2, None, "claimed"), (3, None, "claimed"), (4, None, "claimed")]


def test_concurrent_writers_share_the_trials(spark, tmp_path):
    got: dict[str, list] = {}

    def work(owner):
        study = Study(spark, str(tmp_path), "c", owner=owner)
        while claimed := study.claim(2, 11, lambda n, finished, pending: {"a": n}):
            got.setdefault(owner, []).extend(c["trial"] for c in claimed)
            study.tell({c["trial"]: float(c["trial"]) for c in claimed})

    threads = [threading.Thread(target=work, args=(o,)) for o in ("p", "q", "r")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(n for own in got.values() for n in own) == list(range(11))
    assert numbers(Study(spark, str(tmp_path), "c")) == [(n, float(n), "finished") for n in range(11)]


# walk-forward


def samples(spark, dates=7, stocks=9, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(d, f"s{i}", rng.normal(size=(4, 2)).tolist(), float(rng.normal())) for d in range(dates) for i in range(stocks + d)]
    return rows, spark.createDataFrame(rows, "date int, stock_id string, x array<array<double>>, y double").repartition(5)


def by_loops(rows, keys, flat, trial, family, first, train, validation, sequence, seed):
    p = sampler.parameters(flat)
    steps, epochs, rate = min(p.pop("sequence_size", sequence), sequence), p.pop("epochs", 5), p.pop("learning_rate", 1e-3)

    def day(d):
        own = sorted((r for r in rows if r[0] == d), key=lambda r: r[1])
        return np.array([r[2] for r in own])[:, -steps:], None, np.array([float(r[3] > 0) for r in own]), np.array([keys[d, r[1]] for r in own])

    days = [day(first + i) for i in range(train + validation + 1)]
    model = networks.build(family, 2, steps, 0, seed + trial, **p)
    best, _ = training.train(model, days[:train], days[train : train + validation], epochs, rate, seed=seed)
    return training.evaluate(best, days[-1:])


@pytest.mark.parametrize(("family", "space"), [("linear", {"learning_rate": [0.01, 0.3, 0.05], "epochs": [1, 4, 1], "sequence_size": [2, 4, 1]}), ("lstm", {"hidden_size": [2, 3, 1], "lstm_size": [1, 1, 1], "epochs": [2, 3, 1], "dropout": [0.2, 0.2, 0.1]})])
def test_streamed_trials_equal_plain_training(spark, family, space):
    rows, df = samples(spark)
    keys = {(r["date"], r["stock_id"]): r["key"] for r in df.select("date", "stock_id", scoring.row_key().alias("key")).collect()}
    jobs = {t: sampler.propose(space, [], [], t, 3, family) for t in range(5)}
    for groups in (1, 3):
        got = {(r["trial"], r["set"]): r["loss"] for r in search.validate(df, jobs, 3, 3, 1, 2, 4, family, 3, groups).collect()}
        assert len(got) == 15
        for (trial, number), loss in got.items():
            assert loss == pytest.approx(by_loops(rows, keys, jobs[trial], trial, family, number, 3, 1, 4, 3))


@pytest.mark.parametrize(("family", "space"), [("linear", {"learning_rate": [0.1, 0.1, 0.1], "epochs": [2, 2, 1]}), ("lstm", {"hidden_size": [2, 2, 1], "lstm_size": [1, 1, 1], "epochs": [2, 2, 1]}), ("transformer", {"embedding_size": [4, 4, 1], "num_heads": [2, 2, 1], "dim_feedforward": [4, 4, 1], "num_layers": [1, 1, 1], "epochs": [1, 1, 1]})])
def test_a_literal_reset_keeps_what_cannot_be_reset(spark, family, space):
    """Split after split by hand: fresh weights, but the head (and more of a transformer) of the split before."""
    rows, df = samples(spark, dates=5)
    flat = sampler.propose(space, [], [], 0, 3, family)
    got = {r["set"]: r["loss"] for r in search.validate(df, {0: flat}, 3, 1, 1, 2, 4, family, 3, parity=True).collect()}
    p = sampler.parameters(flat)
    epochs, rate = p.pop("epochs"), p.pop("learning_rate", 1e-3)

    def day(d):
        own = sorted((r for r in rows if r[0] == d), key=lambda r: r[1])
        return np.array([r[2] for r in own]), None, np.array([float(r[3] > 0) for r in own])

    kept = {"linear": ["head.w", "head.b"], "lstm": ["head.w", "head.b"]}.get(family)
    before: dict = {}
    for s in range(3):
        model = networks.build(family, 2, 4, 0, 3, **p)
        names = kept or [k for k in model["weights"] if not k.startswith("embed")]
        model["weights"] |= {k: before[k] for k in names if before}
        best, _ = training.train(model, [day(s)], [day(s + 1)], epochs, rate, seed=3)
        before = best["weights"]
        assert got[s] == pytest.approx(training.evaluate(best, [day(s + 2)])), s


def test_rows_are_dealt_by_splits_and_tasks_not_by_trials(spark):
    """Four days in three splits of two dates and a test date: the inner days are in more splits."""
    rows, df = samples(spark, dates=6)
    of_day = {d: sum(d == r[0] for r in rows) for d in range(6)}
    for groups in (1, 2):
        dealt = search.deal(df, 3, 1, 1, groups)
        assert dealt.count() == groups * (of_day[0] + 2 * of_day[1] + 3 * of_day[2] + 2 * of_day[3] + of_day[4])
    told = search.validate(df, {t: {"epochs": 1} for t in range(30)}, 2, 2, 1, 2, 4, groups=2)
    assert told.count() == 2 * 30
    with pytest.raises(ValueError, match="too few"):
        search.validate(df, {0: {}}, 9, 2, 1, 2, 4)


def test_a_search_is_resumed_and_each_trial_runs_once(spark, tmp_path, monkeypatch):
    _, df = samples(spark)
    space = {"learning_rate": [0.01, 0.2, 0.01], "epochs": [1, 2, 1]}
    ran: list[int] = []
    real = search.validate

    def counted(samples, jobs, *a, **k):
        if len(ran) >= 4 and not counted.mended:
            raise KeyboardInterrupt
        ran.extend(jobs)
        return real(samples, jobs, *a, **k)

    counted.mended = False
    monkeypatch.setattr(search, "validate", counted)
    args = (space, 8, 2, 2, 1, 2, 4)
    with pytest.raises(KeyboardInterrupt):
        search.optimize(df, Study(spark, str(tmp_path), "s", owner="me"), *args, batch=2)
    counted.mended = True
    told = search.optimize(df, Study(spark, str(tmp_path), "s", owner="me"), *args, batch=2).collect()
    assert sorted(ran) == list(range(8)) and len(told) == 8 and all(r["state"] == "finished" and r["loss"] > 0 for r in told)
    # the study is complete: nothing runs again
    search.optimize(df, Study(spark, str(tmp_path), "s"), *args, batch=2)
    assert len(ran) == 8


# nested lists


def test_nested_lists_become_one_matrix():
    x = np.arange(24.0).reshape(3, 4, 2)
    assert np.array_equal(scoring.tensor(pa.array(x.tolist())), x)
    column = pa.array([[[0.0, 0.0]] * 4, *x.tolist()], pa.list_(pa.list_(pa.float32()))).slice(1)
    held = scoring.tensor(column)
    assert np.array_equal(held, x) and held.base is not None
    assert np.isnan(scoring.tensor(pa.array([[[1.0, None]]]))[0, 0, 1]) and scoring.tensor(pa.array([], pa.list_(pa.list_(pa.float64())))).shape == (0, 1, 1)
    for wrong in ([[[1.0]], [[1.0], [2.0]]], [[[1.0], [2.0, 3.0]]], [None], [[None]]):
        with pytest.raises(ValueError, match="samples|NULL"):
            scoring.tensor(pa.array(wrong, pa.list_(pa.list_(pa.float64()))))
