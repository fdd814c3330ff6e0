"""Trade bars on the book's clock: forward as-of join, OHLC and VWAP aggregates, repair of empty bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import book as B
from .clean import DAY, assert_unique_times
from .scan import HOT_ROWS, Hot, find_hot, running


def asof_forward(trades: DataFrame, book: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Each trade with ``bar_t``, the time of the earliest snapshot of its stock-day at or after it; without one it is dropped.

    Both sides are unioned and scanned once, in falling order, so what lies ahead lies behind; trades come before a
    snapshot of the same time. There is one shuffle and one sort instead of a range join, and stock-days of any size
    spread over the tasks (``hot``; see ``scan``).
    """
    extra = [c for c in trades.columns if c not in (*DAY, "t")]
    ticks = book.select(*DAY, "t", *[F.lit(None).cast(trades.schema[c].dataType).alias(c) for c in extra], F.lit(1).alias("__src"))
    both = trades.select(*DAY, "t", *extra, F.lit(0).alias("__src")).unionByName(ticks)
    next_tick = ("last", F.when(F.col("__src") == 1, F.col("t")))
    found = running(both, DAY, [F.desc("t"), F.desc("__src"), *([F.desc("ord")] if "ord" in extra else [])], {"bar_t": next_tick}, hot or find_hot([trades, book], DAY))
    return found.filter((F.col("__src") == 0) & F.col("bar_t").isNotNull()).drop("__src")


def aggregate_bars(binned: DataFrame) -> DataFrame:
    """One row per (stock_id, date, bar_t) with trades: first, last, highest, lowest price, VWAP, VWPS and volume.

    A bar whose volume is zero has no prices. VWPS is the volume-weighted spread around the VWAP with
    n - 1 in the denominator (1 at least), computed around the mean, not from raw squares. "First" and
    "last" follow (t, ord).
    """
    # in time order, so sums do not depend on how rows arrived; the window needs no other sort
    binned = binned.sortWithinPartitions(*DAY, "bar_t", "t", "ord")
    bar = Window.partitionBy(*DAY, "bar_t")
    p, q = F.col("price"), F.col("quantity")
    volume = F.sum(q).over(bar)
    mean = F.try_divide(F.sum(p * q).over(bar), volume)
    spread = binned.withColumn("__dev", q * (p - mean) * (p - mean))
    at = F.struct("t", "ord")
    sums = spread.groupBy(*DAY, "bar_t").agg(
        F.min_by("price", at).alias("open"),
        F.max_by("price", at).alias("close"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.sum(p * q).alias("__pq"),
        F.sum("__dev").alias("__dev"),
        F.sum(q).cast("long").alias("quantity"),
    )
    traded = F.col("quantity") != 0
    vwps = F.sqrt(F.col("__dev") / F.greatest(F.col("quantity") - 1, F.lit(1)))
    return sums.select(
        *DAY,
        F.col("bar_t").alias("t"),
        *[F.when(traded, F.col(c)).alias(c) for c in ("open", "close", "high", "low")],
        F.when(traded, F.try_divide(F.col("__pq"), F.col("quantity"))).alias("vwap"),
        F.when(traded, vwps).alias("vwps"),
        "quantity",
    )


def bars_on_clock(trades: DataFrame, book: DataFrame, hot: Hot | None = None) -> DataFrame:
    """A bar for every snapshot; snapshots without trades have NULL prices and quantity 0."""
    ticks = book.select(*DAY, "t")
    bars = aggregate_bars(asof_forward(trades, book, hot))
    return ticks.join(bars, [*DAY, "t"], "left").withColumn("quantity", F.coalesce("quantity", F.lit(0)))


def fill_bars(bars: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Empty bars take the last known VWAP for all prices, and 0 for VWPS and quantity; leading ones stay without prices."""
    filled = running(bars, DAY, [F.col("t")], {"vwap": ("last", F.col("vwap"))}, hot or find_hot([bars], DAY))
    prices = {c: F.coalesce(F.col(c), F.col("vwap")) for c in ("open", "close", "high", "low")}
    return filled.withColumns({**prices, "vwps": F.coalesce("vwps", F.lit(0.0)), "quantity": F.coalesce("quantity", F.lit(0))})


def trade_bars(trades: DataFrame, book: DataFrame, check_unique: bool = False, most: int = HOT_ROWS) -> DataFrame:
    """From NORMAL trades to repaired bars on the book's clock; stock-days of over ``most`` rows are scanned by several tasks."""
    hot = find_hot([trades, book], DAY, most)
    out = fill_bars(bars_on_clock(trades, book, hot), hot).select(*DAY, "t", *B.BARS)
    return assert_unique_times(out) if check_unique else out
