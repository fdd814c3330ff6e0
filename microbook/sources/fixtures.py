"""Generated trades and snapshots of a mock market, for examples and property tests.

All randomness comes from hashes of the row's key and the seed, so the rows do not depend on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import book as B

START, OPEN_HOUR, MINUTES = "2023-01-02", 9, 120


def _uniform(seed: int, *keys: str | Column) -> Column:
    """In (0, 1)."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)


def _normal(seed: int, *keys: str | Column) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed, *keys))) * F.cos(2 * F.pi() * _uniform(seed + 7919, *keys))


def _days(spark: SparkSession, stocks: int, days: int) -> DataFrame:
    ids = spark.range(stocks).select((F.col("id") + 1001).cast("string").alias("stock_id"))
    dates = F.sequence(F.lit(START).cast("date"), F.date_add(F.lit(START).cast("date"), days - 1))
    return ids.select("stock_id", F.explode(dates).alias("date"))


def mock_trades(spark: SparkSession, stocks: int = 10, days: int = 60, expected: int = 200, price: float = 100.0, price_std: float = 2.0, volume: float = 50.0, volume_std: float = 15.0, seed: int = 42) -> DataFrame:
    """(stock_id, date, t, ord, price, quantity, flag): about ``expected`` trades a day at uniform seconds of two hours.

    Prices and volumes are normal, cut at zero, and zero becomes the expected value. A day's first and last
    rows are auctions. The number of trades is normal with the mean and variance of a Poisson count.
    """
    n = F.greatest(F.round(F.lit(expected) + _normal(seed, "stock_id", "date") * expected**0.5), F.lit(2)).cast("int")
    rows = _days(spark, stocks, days).select("stock_id", "date", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    key = ("stock_id", "date", "i")
    second = F.floor(_uniform(seed + 1, *key) * (2 * 60 * 60)).cast("int")
    cost = F.greatest(price + _normal(seed + 2, *key) * price_std, F.lit(0.0))
    size = F.greatest(volume + _normal(seed + 3, *key) * volume_std, F.lit(0.0))
    rows = rows.select(
        "stock_id", "date", F.timestamp_seconds(F.unix_timestamp(F.col("date").cast("timestamp")) + OPEN_HOUR * 3600 + second).alias("t"), "i",
        F.bround(F.when(cost == 0, price).otherwise(cost), 2).alias("price"), F.when(size == 0, volume).otherwise(size).cast("long").alias("quantity"),
    )
    day = Window.partitionBy("stock_id", "date")
    rows = rows.withColumns({"ord": F.row_number().over(day.orderBy("t", "i")).cast("long"), "__n": F.count("*").over(day)})
    flag = F.when((F.col("ord") == 1) | (F.col("ord") == F.col("__n")), "AUCTION").otherwise("NORMAL")
    return rows.select("stock_id", "date", "t", "ord", "price", "quantity", flag.alias("flag"))


def mock_book(spark: SparkSession, stocks: int = 10, days: int = 60, price: float = 100.0, price_std: float = 0.5, volume: float = 500.0, volume_std: float = 50.0, seed: int = 43) -> DataFrame:
    """(stock_id, date, t, nature, levels): one snapshot a minute, up to 100 ms off, levels ``price_std`` apart around the mid."""
    rows = _days(spark, stocks, days).select("stock_id", "date", F.explode(F.sequence(F.lit(0), F.lit(MINUTES - 1))).alias("i"))
    key = ("stock_id", "date", "i")
    jitter = F.floor(_uniform(seed, *key) * 200) - 100
    millis = (F.unix_timestamp(F.col("date").cast("timestamp")) + OPEN_HOUR * 3600 + F.col("i") * 60) * 1000 + jitter
    middle = price + _normal(seed + 1, *key) * price_std
    levels = {}
    for side, sign in (("bb", -1), ("ba", 1)):
        for k in range(1, B.LEVELS + 1):
            levels[f"{side}{k}"] = F.bround(middle + sign * price_std * k, 2)
            levels[f"{side}vol{k}"] = volume + _normal(seed + 10 * k + (sign > 0), *key) * volume_std
    return rows.select("stock_id", "date", F.timestamp_millis(millis).alias("t"), F.lit("q").alias("nature"), *[c.alias(n) for n, c in levels.items()])


def write_raw(df: DataFrame, path: str) -> None:
    """gzip CSV files with ISO times, one folder entry per stock as ``stock_<id>`` parts in row order."""
    rows = df.drop("date").withColumn("t", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    order = [c for c in ("stock_id", "t", "ord") if c in rows.columns]
    out = rows.repartition("stock_id").sortWithinPartitions(*order).drop("ord")
    out.withColumn("stock", F.col("stock_id")).drop("stock_id").write.partitionBy("stock").option("header", True).option("compression", "gzip").csv(path)
