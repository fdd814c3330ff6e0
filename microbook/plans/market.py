"""The stages from raw files to model-ready samples, as one plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import auction, bars, clean, features, intraday, normalize
from ..sources import io


def process(spark: SparkSession, raw_trades: str, raw_book: str, out: str, max_price: float = 1e6) -> None:
    """Raw gzip CSV files to day tables ``out``/lob, /trades and /auctions."""
    book = clean.clean_book(io.read_raw_book(spark, raw_book).drop("ord"), max_price)
    io.write_days(book, f"{out}/lob")
    trades = io.read_raw_trades(spark, raw_trades)
    held = io.read_days(spark, f"{out}/lob")
    own = bars.trade_bars(clean.capped_trades(clean.on_book_days(trades, held), max_price), held, check_unique=True)
    io.write_days(own, f"{out}/trades")
    io.write_days(auction.auction_prices(trades, ("ord",)), f"{out}/auctions")


def closing_dataset(spark: SparkSession, processed: str, out: str, start: tuple[int, int], end: tuple[int, int], sequence: int = 360, horizon: int = 5, days: int = 5, stocks: list[str] | None = None) -> DataFrame:
    """Day tables of a range of months to normalised closing samples, written by date and returned."""
    book, own, auctions = (io.read_days(spark, f"{processed}/{x}", start, end, stocks) for x in ("lob", "trades", "auctions"))
    io.write_samples(features.closing_samples(book, own, auctions, sequence, horizon), f"{out}/engineered")
    samples = io.read_samples(spark, f"{out}/engineered")
    io.write_samples(normalize.normalize_samples(samples, days), f"{out}/dataset")
    return io.read_samples(spark, f"{out}/dataset")


def intraday_dataset(spark: SparkSession, processed: str, out: str, start: tuple[int, int], end: tuple[int, int], sequence: int = 360, horizon: int = 5, keep: int = 1, days: int = 5, stocks: list[str] | None = None) -> DataFrame:
    """The same for intraday samples, which read the book alone."""
    book = io.read_days(spark, f"{processed}/lob", start, end, stocks)
    io.write_samples(intraday.intraday_samples(book, sequence, horizon, keep), f"{out}/engineered")
    samples = io.read_samples(spark, f"{out}/engineered")
    io.write_samples(normalize.normalize_samples(samples, days), f"{out}/dataset")
    return io.read_samples(spark, f"{out}/dataset")
