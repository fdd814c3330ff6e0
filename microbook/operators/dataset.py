"""Splits by date and projections of samples for a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import is_up


def date_split(df: DataFrame, train: int, validation: int, test: int = 0, start: int = 0, parity: bool = False) -> DataFrame:
    """``df`` with ``split`` for its dates, in order from the ``start``-th: train, validation, test; other dates are dropped.

    ``test=0`` means all dates that are left (with ``parity``, none). The dates, not the rows, are ranked,
    so the ranking window sees one row per date.
    """
    dates = df.select("date").distinct()
    available = dates.count()
    if not available:
        raise ValueError("no dates")
    if start + train + validation + test > available:
        raise ValueError(f"{train} + {validation} + {test} dates from {start} asked for, {available} available")
    rank = F.row_number().over(Window.orderBy("date")) - 1 - start
    rest = (test if test or parity else available) + train + validation
    split = F.when(rank < 0, None).when(rank < train, "train").when(rank < train + validation, "validation").when(rank < rest, "test")
    return df.join(dates.withColumn("split", split).filter("split is not null"), "date")


def last_steps(x: str, sequence: int, horizon: int = 0):
    """The last ``sequence`` steps before the last ``horizon`` ones (all of them where there are fewer)."""
    cut = F.slice(F.col(x), 1, F.greatest(F.size(x) - horizon, F.lit(0)))
    n = F.least(F.size(cut), F.lit(sequence))
    return F.slice(cut, F.size(cut) - n + 1, n)


def select_features(samples: DataFrame, sequence: int, use_trading: bool = False, use_exogenous: bool = False, horizon: int = 0) -> DataFrame:
    """Samples as a model reads them: the last steps; the 22 book features, or all with ``use_trading``; z only with ``use_exogenous``."""
    x = last_steps("x", sequence, horizon)
    if not use_trading:
        x = F.transform(x, lambda row: F.slice(row, 1, 22))
    out = samples.withColumn("x", x)
    return out if use_exogenous else out.drop("z1", "z2")


def with_target(samples: DataFrame, y: str = "y") -> DataFrame:
    return samples.withColumn("target", is_up(F.col(y)))
