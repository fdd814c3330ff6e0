"""From predictions to positions, daily returns and profit metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import numeric as N


def of_date() -> WindowSpec:
    return Window.partitionBy("date")


def positions(predictions: DataFrame, threshold: float, parity: bool = False) -> DataFrame:
    """``pos``: 1 where sigmoid(logit) > threshold; -1 below 1 - threshold or, with ``parity``, literally below -threshold (never, for a sigmoid)."""
    p = N.sigmoid(F.col("logit"))
    low = -threshold if parity else 1 - threshold
    return predictions.withColumn("pos", F.when(p > threshold, 1).when(p < low, -1).otherwise(0))


def assert_aligned(predictions: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("date", "stock_id")) -> None:
    """An error where a prediction has no target or a target no prediction, or one has more rows of a key than the other."""
    counts = [df.groupBy(*keys).agg(F.count("*").alias(c)) for df, c in ((predictions, "__p"), (targets, "__t"))]
    both = counts[0].join(counts[1], list(keys), "full").filter(~F.col("__p").eqNullSafe(F.col("__t")))
    if wrong := both.take(1):
        raise ValueError(f"predictions and targets differ at {wrong[0].asDict()}")


def weights(placed: DataFrame, weighted: bool = False) -> DataFrame:
    """``w``: one over all stocks of the day, or the softmax of |logit| among the day's entered positions."""
    if not weighted:
        return placed.withColumn("w", F.lit(1.0) / F.count("*").over(of_date()))
    entered = F.when(F.col("pos") != 0, F.abs("logit"))
    return placed.withColumn("w", F.coalesce(N.softmax_over(entered, of_date()), F.lit(0.0)))


def daily_returns(predictions: DataFrame, threshold: float = 0.5, weighted: bool = False, parity: bool = False, gross: bool = False) -> DataFrame:
    """(date, ret): the weighted sum of y times position; exactly 1 on a day without positions.

    That mixes a gross 1 with net sums, as the literal definition does; ``gross`` adds 1 to the sums.
    """
    rows = weights(positions(predictions, threshold, parity), weighted)
    idle = F.bool_and(F.col("pos") == 0)
    earned = F.sum(F.col("y") * F.col("pos") * F.col("w")) + (1.0 if gross else 0.0)
    return rows.groupBy("date").agg(F.when(idle, 1.0).otherwise(earned).alias("ret"))


def win_rate(returns: DataFrame) -> DataFrame:
    return returns.agg(F.avg((F.col("ret") > 1).cast("double")).alias("win_rate"))


def expected_return(returns: DataFrame) -> DataFrame:
    """Mean log return."""
    return returns.agg(F.avg(N.ieee_ln(F.col("ret"))).alias("expected_return"))


def sharpe_ratio(returns: DataFrame) -> DataFrame:
    """Mean over sample deviation of log returns, not annualised."""
    r = N.ieee_ln(F.col("ret"))
    return returns.agg(N.ieee_div(F.avg(r), F.stddev_samp(r)).alias("sharpe"))


def cumulative_log(returns: DataFrame) -> DataFrame:
    """(date, cum): running sum of log returns. One row per date enters the window."""
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return returns.select("date", F.sum(N.ieee_ln(F.col("ret"))).over(upto).alias("cum"))


def maximum_drawdown(returns: DataFrame) -> DataFrame:
    """Largest fall of the running log sum below its maximum so far; the maximum starts at the first day."""
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fall = cumulative_log(returns).withColumn("fall", F.max("cum").over(upto) - F.col("cum"))
    return fall.agg(F.max("fall").alias("max_drawdown"))


def total_return(returns: DataFrame) -> DataFrame:
    return returns.agg((F.product("ret") - 1).alias("total_return"))


def cumulative_return(returns: DataFrame) -> DataFrame:
    """(date, cum_return): running product minus 1; signs are kept, as no logarithm is taken."""
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return returns.select("date", (F.product("ret").over(upto) - 1).alias("cum_return"))


def mean_loss(predictions: DataFrame) -> DataFrame:
    """Binary cross-entropy over all rows, which is the mean of the days weighted by their rows."""
    return predictions.agg(F.avg(N.bce_with_logits(F.col("logit"), N.is_up(F.col("y")))).alias("loss"))


def accuracy(predictions: DataFrame) -> DataFrame:
    """Share of rows, in percent, where logit and y agree in being above zero."""
    return predictions.agg((F.avg(((F.col("logit") > 0) == (F.col("y") > 0)).cast("double")) * 100).alias("accuracy"))


def early_stopping(losses: DataFrame, patience: int) -> DataFrame:
    """Replay of early stopping over (epoch, loss): for each epoch that runs, the best loss so far, its epoch and the epochs since."""
    upto = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best = losses.withColumn("__new", F.coalesce(F.col("loss") < F.min("loss").over(earlier), F.lit(True)))
    best = best.withColumns({"best_epoch": F.max(F.when(F.col("__new"), F.col("epoch"))).over(upto), "best_loss": F.min("loss").over(upto)})
    best = best.withColumn("waited", F.col("epoch") - F.col("best_epoch"))
    stopped = F.coalesce(F.max((F.col("waited") >= patience).cast("int")).over(earlier), F.lit(0))
    return best.withColumn("__stopped", stopped).filter("__stopped = 0").select("epoch", "loss", "best_epoch", "best_loss", "waited")
