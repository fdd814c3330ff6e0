"""Walk-forward validation of many trials, and the search for hyper-parameters over a resumable study."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import is_up
from ..sources.io import stored
from ..sources.studies import Study
from . import networks, sampler, training
from .scoring import row_key, tensor

PATIENCE = 10
STATE = "task int, trial long, set int, done boolean, loss double, state binary"


#: Weights that a literal reset leaves as they are, by the beginnings of their names: those of the head always, and of layers that have no reset of their own.
NOT_RESET = {"linear": ("head",), "cnn": ("head",), "lstm": ("head",), "transformer": ("head", "place", "enc")}


class Walk:
    """A trial on one set: days stream by in order; those of training are learnt, the others add up its losses.

    ``before``: the weights that the trial ended its last set with, of which the literal reset keeps some.
    """

    def __init__(self, trial: int, number: int, flat: sampler.Flat, family: str, features: int, sequence: int, seed: int, before: dict | None = None):
        p = sampler.parameters(flat)
        self.steps = min(int(p.pop("sequence_size", sequence)), sequence)
        self.epochs, rate = int(p.pop("epochs", 5)), float(p.pop("learning_rate", 1e-3))
        self.trial, self.set, self.seed, self.loss = trial, number, seed, float("nan")
        model = networks.build(family, features, self.steps, 0, seed + trial, **p)
        model["weights"] |= {k: w for k, w in (before or {}).items() if k.startswith(NOT_RESET[family])}
        self.state = training.State.of(model, rate)
        self.sums: dict[str, list] = {}

    def see(self, role: str, day: training.Day) -> None:
        own = (day[0][:, -self.steps :], *day[1:])
        if role == "train":
            self.state.learn(training.gradients(self.state.model, *own[:3], training.draws(self.state.model, self.seed, self.state.epoch, own)))
        else:
            total, n = training.losses(self.state.model, [own])
            held = self.sums.setdefault(role, [0.0, 0])
            held[0], held[1] = held[0] + total, held[1] + n

    def close(self) -> None:
        """The end of an epoch. The loss of a trial is that of the test date under the weights of the best validation loss (NaN if none is a number)."""
        means = {role: total / n for role, (total, n) in self.sums.items() if n}
        if self.state.close(float("nan"), means.get("validation", float("nan"))):
            self.loss = means.get("test", float("nan"))
        self.sums = {}

    @property
    def done(self) -> bool:
        return self.state.ended(self.epochs, PATIENCE)


def _epoch(rows: DataFrame, states: DataFrame, tasks: int, train: int, validation: int) -> DataFrame:
    """One pass over the days of every set: each task streams its set's days, holding one at a time, past its trials."""
    first = states.filter("not done").select("task", F.lit(-1).alias("day"), F.lit(0).alias("role_at"), "trial", "state")
    stream = first.unionByName(rows, allowMissingColumns=True)
    dealt = stream.repartitionById(tasks, "task").sortWithinPartitions("task", "day", "stock_id", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: list[Walk] = []
        task, at, held = None, None, []

        def told() -> pa.RecordBatch:
            for w in walks:
                w.close()
            columns = [[task] * len(walks), [w.trial for w in walks], [w.set for w in walks], [w.done for w in walks], [w.loss for w in walks], [pickle.dumps(w) for w in walks]]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.float64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["task", "trial", "set", "done", "loss", "state"])

        def pass_day() -> None:
            if held:
                day = (np.concatenate([h[0] for h in held]), None, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
                role = "train" if at[1] < train else "validation" if at[1] < train + validation else "test"
                for w in walks:
                    w.see(role, day)
                held.clear()

        for batch in batches:
            place = list(zip(batch.column("task").to_pylist(), batch.column("day").to_pylist(), batch.column("role_at").to_pylist(), strict=True))
            lo = 0
            while lo < len(place):
                hi = lo
                while hi < len(place) and place[hi] == place[lo]:
                    hi += 1
                own, day, role_at = place[lo]
                if (own, day, role_at) != (task, *(at or (None, None))):
                    pass_day()
                if own != task and walks:
                    yield told()
                    walks = []
                task, at = own, (day, role_at)
                part = batch.slice(lo, hi - lo)
                if day < 0:
                    walks += [pickle.loads(s) for s in part.column("state").to_pylist()]
                else:
                    held.append((tensor(part.column("x")), part.column("target").to_numpy(), part.column("key").to_numpy()))
                lo = hi
        pass_day()
        if walks:
            yield told()

    return dealt.mapInArrow(run, STATE)


def deal(samples: DataFrame, sets: int, train: int, validation: int, groups: int) -> DataFrame:
    """Rows of the splits for ``groups`` tasks each: (task, day, role_at, stock_id, x, target, key)."""
    dates = samples.select("date").distinct().withColumn("day", F.row_number().over(Window.orderBy("date")) - 1).filter(F.col("day") < train + validation + sets)
    if dates.count() < train + validation + sets:
        raise ValueError("too few dates")
    of_day = F.sequence(F.greatest(F.col("day") - (train + validation), F.lit(0)), F.least(F.col("day"), F.lit(sets - 1)))
    rows = samples.join(F.broadcast(dates), "date").select("date", "stock_id", "x", "y", "day", F.explode(of_day).alias("set"))
    rows = rows.withColumn("task", F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: (F.col("set") * groups + g).cast("int"))))
    return rows.select("task", F.col("day").cast("int").alias("day"), (F.col("day") - F.col("set")).cast("int").alias("role_at"), F.col("stock_id").cast("string").alias("stock_id"), "x", is_up(F.col("y")).alias("target"), row_key().alias("key"))


def validate(samples: DataFrame, jobs: dict[int, sampler.Flat], sets: int, train: int, validation: int, features: int, sequence: int, family: str = "linear", seed: int = 0, groups: int | None = None, parity: bool = False) -> DataFrame:
    """(trial, set, loss) of each trial of ``jobs`` on ``sets`` consecutive splits, each with fresh weights.

    With ``parity`` the splits come one after the other, and between them only the layers that can be reset are: heads
    (and a transformer's encoder and positions) go on with the best weights of the split before.

    A split is ``train`` and ``validation`` dates and the test date behind them. The samples are dealt to the splits,
    each to ``groups`` tasks (as many as give every core one, by default) that share its trials, and stream by in
    date order, once an epoch; a task holds one day and its trials' states. So what is shuffled grows with the splits,
    the cores and the epochs, not with the trials. States are stored after each epoch.
    """
    spark = samples.sparkSession
    groups = max(1, min(len(jobs), groups or -(-spark.sparkContext.defaultParallelism // sets)))
    rows = deal(samples, sets, train, validation, groups)
    walks = [[Walk(trial, s, flat, family, features, sequence, seed) for trial, flat in sorted(jobs.items())] for s in range(sets)]
    if not parity:
        return _walked(rows, [w for own in walks for w in own], groups, sets * groups, train, validation).select("trial", "set", "loss")
    told, ended = [], None
    for s in range(sets):
        if told:  # a row for each trial
            before = {r["trial"]: pickle.loads(r["state"]).state.best["weights"] for r in told}
            walks[s] = [Walk(trial, s, flat, family, features, sequence, seed, before[trial]) for trial, flat in sorted(jobs.items())]
        own = _walked(rows.filter(F.col("task").between(s * groups, s * groups + groups - 1)), walks[s], groups, sets * groups, train, validation)
        told = own.select("trial", "state").collect() if s + 1 < sets else []
        ended = own if ended is None else ended.unionByName(own)
    return ended.select("trial", "set", "loss")


def _walked(rows: DataFrame, walks: list[Walk], groups: int, tasks: int, train: int, validation: int) -> DataFrame:
    """The states at the end of all epochs; a set's walks share ``groups`` tasks."""
    spark, place = rows.sparkSession, {t: i for i, t in enumerate(sorted({w.trial for w in walks}))}
    begun = [(w.set * groups + place[w.trial] % groups, w.trial, w.set, False, float("nan"), bytearray(pickle.dumps(w))) for w in walks]
    states = spark.createDataFrame(begun, STATE)
    ended = None
    while True:
        states = stored(_epoch(rows, states, tasks, train, validation), "walk_states")
        now = states.filter("done")
        ended = now if ended is None else ended.unionByName(now)
        live = [r["task"] for r in states.filter("not done").select("task").distinct().collect()]  # at most one row a task
        if not live:
            return ended
        rows = rows.filter(F.col("task").isin(live))


def mean_losses(told: DataFrame) -> DataFrame:
    return told.groupBy("trial").agg(F.count("*").alias("sets"), F.avg("loss").alias("loss"))


def walk_forward(samples: DataFrame, space: dict, trials: int, sets: int, train: int, validation: int, features: int, sequence: int, family: str = "linear", seed: int = 0) -> DataFrame:
    """(trial, parameters, sets, loss): the mean loss of trials at random over ``sets`` splits."""
    jobs = {t: sampler.propose(space, [], [], t, seed, family) for t in range(trials)}
    told = samples.sparkSession.createDataFrame([(t, json.dumps(sampler.parameters(f))) for t, f in jobs.items()], "trial long, parameters string")
    losses = mean_losses(validate(samples, jobs, sets, train, validation, features, sequence, family, seed))
    return losses.join(F.broadcast(told), "trial").select("trial", "parameters", "sets", "loss")


def optimize(samples: DataFrame, study: Study, space: dict, trials: int, sets: int, train: int, validation: int, features: int, sequence: int, family: str = "linear", seed: int = 0, batch: int = 4) -> DataFrame:
    """Search for the lowest mean loss with ``trials`` trials in all, ``batch`` at a time; the study's trials.

    Only trials that the study lacks are run. Trials are proposed by the Parzen estimator from those that the study
    holds. Trials that another live run has claimed are left to it.
    """

    def propose(trial: int, finished: list, pending: list) -> sampler.Flat:
        return sampler.propose(space, finished, pending, trial, seed, family)

    sampler.check_space(space, family)
    while claimed := study.claim(batch, trials, propose):
        jobs = {c["trial"]: c["parameters"] for c in claimed}
        told = mean_losses(validate(samples, jobs, sets, train, validation, features, sequence, family, seed)).collect()  # a row a trial
        study.tell({r["trial"]: float(r["loss"]) for r in told})
    return study.trials()
