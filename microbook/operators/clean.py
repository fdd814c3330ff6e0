"""Cleaning of order-book snapshots and trades: repair, rejection of whole stock-days, semi joins."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import book as B
from ..functions.numeric import nan_to_null

DAY = ["stock_id", "date"]


def with_day(df: DataFrame, time: str = "t") -> DataFrame:
    """Adds the day key ``date`` (UTC)."""
    return df.withColumn("date", F.to_date(time))


def repair_levels(df: DataFrame) -> DataFrame:
    """Levels 2..5: a price of zero or NULL takes the repaired price of the level before; a missing volume becomes 0.

    Level 1 is left alone, as are zero and negative volumes and negative prices.
    """
    out: dict[str, Column] = {}
    for side in ("bb", "ba"):
        last = nan_to_null(F.col(f"{side}1"))
        out[f"{side}1"], out[f"{side}vol1"] = last, nan_to_null(F.col(f"{side}vol1"))
        for i in range(2, B.LEVELS + 1):
            last = F.coalesce(F.nullif(nan_to_null(F.col(f"{side}{i}")), F.lit(0.0)), last)
            out[f"{side}{i}"] = last
            out[f"{side}vol{i}"] = F.coalesce(nan_to_null(F.col(f"{side}vol{i}")), F.lit(0.0))
    return df.drop("nature").withColumns(out)


def bad_price(max_price: float) -> Column:
    """Whether any of the row's ten prices is missing, not positive or above ``max_price``."""
    return reduce(or_, [F.col(p).isNull() | (F.col(p) <= 0) | (F.col(p) > max_price) for p in B.PRICES])


def level1_invalid(strict: bool = False) -> Column:
    """The reference's first check asks for a value that is missing and zero at once, which never holds; ``strict`` asks for either."""
    if not strict:
        return F.lit(False)
    return reduce(or_, [F.col(c).isNull() | (F.col(c) == 0) for c in ("bb1", "bbvol1", "ba1", "bavol1")])


def rejected_days(df: DataFrame, max_price: float = 1e6) -> DataFrame:
    """Stock-days with at least one bad price after repair."""
    return repair_levels(df).groupBy(*DAY).agg(F.bool_or(bad_price(max_price)).alias("bad")).filter("bad").select(*DAY)


def clean_book(df: DataFrame, max_price: float = 1e6, strict: bool = False) -> DataFrame:
    """Repaired snapshots of the stock-days without a bad price; one shuffle, which later windows share."""
    day = Window.partitionBy(*DAY)
    bad = F.bool_or(bad_price(max_price) | level1_invalid(strict)).over(day)
    return repair_levels(df).withColumn("__bad", bad).filter("not __bad").drop("__bad")


def normal_trades(df: DataFrame) -> DataFrame:
    return df.filter(F.col("flag") == "NORMAL")


def capped_trades(df: DataFrame, max_price: float = 1e6) -> DataFrame:
    """NORMAL trades of the stock-days whose NORMAL prices all stay within ``max_price``; other flags' prices do not count."""
    day = Window.partitionBy(*DAY)
    over = F.coalesce(F.bool_or(nan_to_null(F.col("price")) > max_price).over(day), F.lit(False))
    return normal_trades(df).withColumn("__over", over).filter("not __over").drop("__over")


def on_book_days(trades: DataFrame, book: DataFrame) -> DataFrame:
    """Trades of the stock-days that have a book."""
    return trades.join(book.select(*DAY).distinct(), DAY, "left_semi")


def assert_unique_times(bars: DataFrame) -> DataFrame:
    """Fails at run time where a stock has two bars at one time; otherwise the same rows.

    A time lies in one day, so the day is among the keys and the bars' partitioning serves.
    """
    n = F.count("*").over(Window.partitionBy(*DAY, "t"))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate bar of stock "), F.col("stock_id"), F.lit(" at "), F.col("t").cast("string")))).otherwise(F.lit(True))
    return bars.withColumn("__one", checked).filter("__one").drop("__one")
