"""Opening and closing auctions, told from continuous trading by row order, not by clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clean import DAY

ORDER = ("t", "ord")


def auction_phases(trades: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """NORMAL and AUCTION rows with ``rn`` and ``phase``: ``open`` before the first NORMAL row, ``close`` after the last, else NULL.

    A stock-day without continuous trading, or without rows on both sides of it, has no auctions and no rows.
    """
    day = Window.partitionBy(*DAY)
    flagged = trades.filter(F.col("flag").isin("NORMAL", "AUCTION")).withColumn("rn", F.row_number().over(day.orderBy(*order)))
    normal = F.when(F.col("flag") == "NORMAL", F.col("rn"))
    marked = flagged.withColumns({"__first": F.min(normal).over(day), "__last": F.max(normal).over(day), "__n": F.count("*").over(day)})
    kept = marked.filter((F.col("__first") > 1) & (F.col("__last") < F.col("__n")))
    phase = F.when(F.col("rn") < F.col("__first"), "open").when(F.col("rn") > F.col("__last"), "close")
    return kept.withColumn("phase", phase).drop("__first", "__last", "__n")


def auction_prices(trades: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """(stock_id, date, open_price, open_qty, close_price, close_qty): the price of an auction's first row, the sum of its quantities."""
    rows = auction_phases(trades, order)

    def first(phase: str):
        return F.min_by("price", F.when(F.col("phase") == phase, F.col("rn")))

    def volume(phase: str):
        return F.sum(F.when(F.col("phase") == phase, F.col("quantity"))).cast("long")

    return rows.groupBy(*DAY).agg(
        first("open").alias("open_price"), volume("open").alias("open_qty"), first("close").alias("close_price"), volume("close").alias("close_qty")
    )
