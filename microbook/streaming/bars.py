"""Volume-weighted bars from a stream of trades, on a clock of fixed intervals.

The batch bars follow the book's snapshots; a stream has no complete book to look ahead in, so its bars are
right-closed intervals. Trades later than the watermark are dropped, as a batch run would place them in a
bar that is already out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(trades: DataFrame, interval: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(stock_id, t, open, close, high, low, vwap, vwps, quantity) of the NORMAL trades of each interval; t is its end.

    A trade exactly at an interval's end belongs to it, so event times move back by a microsecond before
    they are windowed. Works on batches as well.
    """
    rows = trades.filter(F.col("flag") == "NORMAL").withColumn("__w", F.col("t") - F.expr("interval 1 microsecond"))
    if rows.isStreaming:
        rows = rows.withWatermark("__w", late)
    p, q, at = F.col("price"), F.col("quantity"), F.struct("t", "ord")
    sums = rows.groupBy("stock_id", F.window("__w", interval).alias("w")).agg(
        F.min_by("price", at).alias("open"),
        F.max_by("price", at).alias("close"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.sum(p * q).alias("pq"),
        F.sum(q).cast("long").alias("quantity"),
        F.collect_list(F.struct("price", "quantity")).alias("__rows"),
    )
    vwap = F.try_divide(F.col("pq"), F.col("quantity"))
    around = F.aggregate("__rows", F.lit(0.0), lambda a, r: a + r["quantity"] * (r["price"] - F.col("vwap")) * (r["price"] - F.col("vwap")))
    out = sums.withColumn("vwap", vwap).withColumn("vwps", F.sqrt(around / F.greatest(F.col("quantity") - 1, F.lit(1))))
    traded = F.col("quantity") != 0
    return out.select("stock_id", F.col("w.end").alias("t"), *[F.when(traded, F.col(c)).alias(c) for c in ("open", "close", "high", "low", "vwap", "vwps")], "quantity")
