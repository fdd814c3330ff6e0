"""Models over DataFrames: scoring from Arrow buffers, training in one job, losses of splits."""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterator
from multiprocessing.connection import Client, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bce_with_logits, is_up
from . import networks, training

#: Epochs of one job of ``fit``: what a lost executor costs at most.
SEGMENT = 50


def seeded(family: str, features: int, sequence: int, seed: int = 0, exogenous: int = 0, **p) -> dict:
    return networks.build(family, features, sequence, exogenous, seed, **p)


def tensor(x: pa.Array) -> np.ndarray:
    """Nested lists as (samples, steps, features), a view of Arrow's buffer of values; NULL values are NaN.

    All samples must have as many steps, and all steps as many features; a NULL sample or step is an error.
    """
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    if not len(x):
        return np.zeros((0, 1, 1))
    steps = x.flatten()
    if x.null_count or steps.null_count:
        raise ValueError("a sample or one of its steps is NULL")
    shape = []
    for lengths in (x.value_lengths().to_numpy(), steps.value_lengths().to_numpy()):
        if len(lengths) and (lengths != lengths[0]).any():
            raise ValueError("samples must have equal numbers of steps and features")
        shape.append(int(lengths[0]) if len(lengths) else 0)
    return steps.flatten().to_numpy(zero_copy_only=False).reshape(len(x), *shape)


def score(samples: DataFrame, model: dict) -> DataFrame:
    """``samples`` with ``logit``; the model's weights are broadcast, their size does not depend on the data."""
    held = samples.sparkSession.sparkContext.broadcast(model)
    zs = [f"z{i + 1}" for i in range(model["spec"]["exogenous"])]

    @F.arrow_udf("double")
    def logit(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, z in columns:
            own = z.flatten().to_numpy(zero_copy_only=False).reshape(len(z), -1) if zs else None
            yield pa.array(networks.logits(held.value, tensor(x), own) if len(x) else np.zeros(0))

    return samples.withColumn("logit", logit("x", F.array(*[F.col(z).cast("double") for z in zs])))


def linear_logit(samples: DataFrame, weights: list[float], bias: float) -> DataFrame:
    """The linear model as an expression: dot product of the flattened steps."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    products = F.zip_with(F.transform(F.flatten("x"), lambda v: v.cast("double")), w, lambda a, b: a * b)
    return samples.withColumn("logit", F.aggregate(products, F.lit(float(bias)), lambda a, v: a + v))


def predict(samples: DataFrame, model: dict) -> DataFrame:
    """(date, stock_id, logit, y, probability)."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit")))
    return score(samples, model).select("date", "stock_id", "logit", "y", p.alias("probability"))


def row_key():
    """What a row's dropout is drawn by."""
    return F.xxhash64(F.col("date").cast("string"), F.col("stock_id").cast("string"))


class Gathered:
    """Sums over the tasks of a barrier stage: task 0 adds what the others send it, in their order, and sends it back.

    The tasks meet once through Spark, to learn where task 0 listens (its barrier takes about a second each time,
    too long for every step), and then speak over sockets under a secret of the job. A task that ends breaks its
    connection, which fails the others, and Spark runs the stage again as a whole.
    """

    def __init__(self, ctx: BarrierTaskContext, secret: bytes):
        self.me, tasks = ctx.partitionId(), ctx.getTaskInfos()
        listener = Listener(("", 0), backlog=max(1, len(tasks)), authkey=secret) if self.me == 0 else None
        port = ctx.allGather(str(listener.address[1] if listener else 0))[0]
        if listener:
            met = {int(c.recv_bytes()): c for c in (listener.accept() for _ in tasks[1:])}
            self.others = [met[i] for i in sorted(met)]
            listener.close()
        else:
            self.others = [Client((tasks[0].address.rpartition(":")[0], int(port)), authkey=secret)]
            self.others[0].send_bytes(str(self.me).encode())

    def sums(self, n: int, arrays: dict) -> tuple[int, dict]:
        """The sums of all tasks' counts and arrays, the same in all; a task without rows has no arrays."""
        if self.me:
            self.others[0].send_bytes(pickle.dumps((n, arrays)))
            return pickle.loads(self.others[0].recv_bytes())
        for other in self.others:
            m, more = pickle.loads(other.recv_bytes())
            n, arrays = n + m, {k: arrays[k] + v for k, v in more.items()} if arrays and more else arrays or more
        told = pickle.dumps((n, arrays))
        for other in self.others:
            other.send_bytes(told)
        return n, arrays

    def close(self) -> None:
        for other in self.others:
            other.close()


def _segment(rows: DataFrame, state: training.State, days: int, zs: list[str], epochs: int, patience: int, seed: int) -> training.State:
    """One job that trains up to epoch ``epochs``: each task holds its rows and its copy of the state; gradients are gathered day by day."""
    held, secret = rows.sparkSession.sparkContext.broadcast(pickle.dumps(state)), os.urandom(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, own = BarrierTaskContext.get(), pickle.loads(held.value)
        batches = [b for b in batches if b.num_rows]
        parts: dict[tuple[bool, int], list] = {}
        for b in batches:
            x, target, key = tensor(b.column("x")), b.column("target").to_numpy(), b.column("key").to_numpy()
            z = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in zs], 1).astype(float) if zs else None
            day, learns = b.column("day").to_numpy(), b.column("learns").to_numpy(zero_copy_only=False).astype(bool)
            for kind, d in sorted({(bool(t), int(d)) for t, d in zip(learns, day, strict=True)}):
                at = np.flatnonzero((learns == kind) & (day == d))
                parts.setdefault((kind, d), []).append((x[at], None if z is None else z[at], target[at], key[at]))
        batches.clear()

        def joined(held: list) -> training.Day:
            """A day's rows in the order of their keys, however they arrived."""
            order = np.argsort(np.concatenate([p[3] for p in held]), kind="stable")
            return tuple(None if held[0][i] is None else np.concatenate([p[i] for p in held])[order] for i in range(4))

        mine = {k: joined(v) for k, v in parts.items()}
        parts.clear()
        tasks = Gathered(ctx, secret)
        while not own.ended(epochs, patience):
            for d in range(days):
                n, grad = 0, {}
                if day := mine.get((True, d)):
                    n = len(day[2])
                    grad = {k: n * g for k, g in training.gradients(own.model, *day[:3], training.draws(own.model, seed, own.epoch, day)).items()}
                n, grad = tasks.sums(n, grad)
                own.learn({k: g / n for k, g in grad.items()})
            sums = [training.losses(own.model, [day for (learns, _), day in sorted(mine.items()) if learns == kind]) for kind in (True, False)]
            _, told = tasks.sums(1, {"loss": np.array([s for s, _ in sums]), "n": np.array([n for _, n in sums])})
            own.close(*[float(s / n) if n else float("nan") for s, n in zip(told["loss"], told["n"], strict=True)])
        tasks.close()
        if ctx.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)])], ["state"])

    return pickle.loads(rows.mapInArrow(run, "state binary", barrier=True).collect()[0]["state"])


def fit(split: DataFrame, model: dict, epochs: int, rate: float, patience: int = 10, seed: int = 0, tasks: int | None = None, segment: int = SEGMENT) -> tuple[dict, list[tuple]]:
    """Train on the rows of split 'train', stop by those of 'validation': the best weights, and each epoch's losses.

    The rows stay on the executors, dealt once to ``tasks`` tasks that run side by side (barrier mode; as many as the
    cluster's cores at most, the default). A task adds up the gradient of its rows of a day, the tasks gather each
    other's sums, and each takes the same step; so weights and gradients travel, rows do not, and the result is that
    of ``training.train`` to rounding, whatever the size. Should an executor be lost, Spark runs the job of up to
    ``segment`` epochs again. The rows must fit into the executors' memory together.
    """
    kept = split.filter(F.col("split").isin("train", "validation")).withColumn("learns", F.col("split") == "train")
    zs = [f"z{i + 1}" for i in range(model["spec"]["exogenous"])]
    dates = kept.filter("learns").select("date").distinct().orderBy("date").collect()  # a row for each date
    spark = split.sparkSession
    days = spark.createDataFrame([(r["date"], i) for i, r in enumerate(dates)], kept.select("date", F.lit(0).alias("day")).schema)
    placed = kept.join(F.broadcast(days), "date", "left").withColumn("day", F.coalesce("day", F.lit(-1)))
    rows = placed.select("day", "learns", "x", is_up(F.col("y")).alias("target"), row_key().alias("key"), *[F.col(z).cast("double").alias(z) for z in zs])
    rows = rows.repartition(tasks or spark.sparkContext.defaultParallelism, "key")
    state = training.State.of(model, rate)
    while not state.ended(epochs, patience):
        state = _segment(rows, state, len(dates), zs, min(epochs, state.epoch + segment), patience, seed)
    return state.best, state.history


def evaluate_splits(split: DataFrame, model: dict) -> DataFrame:
    """(split, rows, loss, accuracy) of every split: ``split`` has x, y (or target) and split."""
    rows = split if "target" in split.columns else split.withColumn("target", is_up(F.col("y")))
    told = score(rows, model).groupBy("split")
    right = (F.col("logit") > 0) == (F.col("target") > 0)
    return told.agg(F.count("*").alias("rows"), F.avg(bce_with_logits(F.col("logit"), F.col("target"))).alias("loss"), (F.avg(right.cast("double")) * 100).alias("accuracy"))


def train_linear(split: DataFrame, features: int, sequence: int, epochs: int = 10, rate: float = 1e-3) -> DataFrame:
    """(epoch, train_loss, validation_loss) of a linear model."""
    _, history = fit(split, seeded("linear", features, sequence), epochs, rate)
    return split.sparkSession.createDataFrame(history, "epoch long, train_loss double, validation_loss double")
