"""Sources and sinks: raw gzip CSV per stock, day tables, samples, configurations, trials."""

from __future__ import annotations

import io
import json
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import csv as pacsv
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import book as B

TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``.

    Where the setting is absent in local mode (tests) a folder of this machine is made and set; on a cluster
    that is an error, as each executor would write to its own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shared_")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parse_time(text: Column) -> Column:
    """The first of the known formats that fits; NULL where none does. The session time zone should be UTC."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])


def stock_of_file(path: Column) -> Column:
    """What stands between the last ``_`` and the first ``.`` after it in a file's name."""
    return F.regexp_extract(path, r"_([^_/.]+)\.[^/]*$", 1)


def _read_raw(spark: SparkSession, path: str | list[str], schema: T.StructType | None) -> DataFrame:
    """All stocks' files in one read. A gzip file is one partition, so ``ord`` keeps its row order."""
    # without a schema the first file's header names the columns; a file with another header is an error
    reader = spark.read.option("header", True).option("enforceSchema", schema is not None)
    rows = reader.schema(schema).csv(path) if schema else reader.csv(path)
    rows = rows.withColumns({"stock_id": stock_of_file(F.col("_metadata.file_path")), "ord": F.monotonically_increasing_id()})
    return rows.withColumn("t", parse_time(F.col("t"))).withColumn("date", F.to_date("t"))


def read_raw_trades(spark: SparkSession, path: str) -> DataFrame:
    """(t, price, quantity, flag, stock_id, ord, date) from ``stock_<id>.gz`` CSV files."""
    return _read_raw(spark, path, B.TRADES_SCHEMA)


def _by_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of all files, each read by the names of its own header, in one scan.

    A gzip file is read by one task from its first line on, so its header is at hand when its rows come; ``ord``
    counts the lines, file by file. Columns that a file lacks are NULL, others are left out. Files that are not
    compressed could be split behind their header and are an error.
    """
    columns = ["t", "nature", *B.BOOK]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")

    def parsed(rows: list[str], head: str, file: str, first: int) -> pa.RecordBatch:
        kinds = {c: pa.float64() for c in B.BOOK} | {"t": pa.string(), "nature": pa.string()}
        options = pacsv.ConvertOptions(column_types=kinds, include_columns=columns, include_missing_columns=True, strings_can_be_null=True)
        own = pacsv.read_csv(io.BytesIO("\n".join([head, *rows]).encode()), convert_options=options).combine_chunks()
        ords = pa.array(range(first, first + own.num_rows))
        return pa.RecordBatch.from_arrays([*[own.column(c).combine_chunks() for c in columns], pa.array([file] * own.num_rows), ords], [*columns, "file", "ord"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = head = None
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            files, values, starts = (batch.column(c).to_pylist() for c in ("file", "value", "start"))
            lo = 0
            while lo < len(files):
                hi = lo
                while hi < len(files) and files[hi] == files[lo]:
                    hi += 1
                if files[lo] != file:
                    if starts[lo]:
                        raise ValueError(f"{files[lo]} is read in parts, and not all hold its header; compress it with gzip")
                    file, head, lo = files[lo], values[lo], lo + 1
                rows = [v for v in values[lo:hi] if v]
                if rows:
                    yield parsed(rows, head, file, at)
                at, lo = at + len(rows), hi

    kinds = ", ".join(f"{c} {'string' if c in ('t', 'nature') else 'double'}" for c in columns)
    rows = lines.mapInArrow(run, f"{kinds}, file string, ord long").withColumn("stock_id", stock_of_file(F.col("file"))).drop("file")
    return rows.withColumn("t", parse_time(F.col("t"))).withColumn("date", F.to_date("t"))


def read_raw_book(spark: SparkSession, path: str, mixed: bool = False, stocks: list[str] | None = None) -> DataFrame:
    """Snapshots with their levels by name.

    All files must have the columns in one order, whatever it is; another order is an error. With ``mixed`` each
    file is read by its own header, in the same single scan. With ``stocks`` only their files are listed and opened;
    a folder without any of them is an error.
    """
    where = f"{path.rstrip('/')}/*_{{{','.join(stocks)}}}.*" if stocks else path
    rows = _by_header(spark, where) if mixed else _read_raw(spark, where, None)
    return rows.withColumns({c: F.col(c).cast("double") for c in B.BOOK}).select("t", "nature", *B.BOOK, "stock_id", "ord", "date")


def _replace(df: DataFrame, path: str, by: list[str], mode: str) -> None:
    """Write ``df`` partitioned by ``by``; with ``overwrite`` only the partitions it holds are replaced, so a rewrite is idempotent.

    Rows are rebalanced by those columns: small partitions share a task, and adaptive execution splits a large one
    into files of the advisory size, each written by a task of its own, so no date or stock-day is a single task's.
    """
    df.hint("rebalance", *by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_days(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table partitioned by stock and date; the stock-days in ``df`` replace those in the table, others stay."""
    _replace(df, path, ["stock_id", "date"], mode)


def read_days(spark: SparkSession, path: str, start: tuple[int, int] | None = None, end: tuple[int, int] | None = None, stocks: list[str] | None = None) -> DataFrame:
    """A day table, pruned to a range of months and to stocks; files of other kinds are skipped."""
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(path).withColumn("stock_id", F.col("stock_id").cast("string"))
    if start:
        return in_months(rows, start, end or start, stocks)
    return rows.filter(F.col("stock_id").isin(list(stocks))) if stocks else rows


def month_range(spark: SparkSession, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """(month) as yyyy-MM, both ends included."""
    first, last = (F.make_date(F.lit(y), F.lit(m), F.lit(1)) for y, m in (start, end))
    months = spark.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("m"))
    return months.select(F.date_format("m", "yyyy-MM").alias("month"))


def in_months(df: DataFrame, start: tuple[int, int], end: tuple[int, int], stocks: list[str] | None = None) -> DataFrame:
    """Rows of the months from start to end, as a range of dates that prunes partitions."""
    y, m = (end[0] + 1, 1) if end[1] == 12 else (end[0], end[1] + 1)
    out = df.filter((F.col("date") >= F.make_date(F.lit(start[0]), F.lit(start[1]), F.lit(1))) & (F.col("date") < F.make_date(F.lit(y), F.lit(m), F.lit(1))))
    return out.filter(F.col("stock_id").isin(list(stocks))) if stocks else out


def ordered_dates(df: DataFrame) -> DataFrame:
    """(date, rank) from 0, in order; one row per date is ranked."""
    return df.select("date").distinct().withColumn("rank", F.row_number().over(Window.orderBy("date")) - 1)


def write_samples(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Samples with array columns, by date; the dates in ``df`` replace those in the table, others stay."""
    _replace(df, path, ["date"], mode)


def read_samples(spark: SparkSession, path: str, dates: list | None = None, columns: list[str] | None = None, horizon: int = 0) -> DataFrame:
    """Samples of the given dates; a missing path or column is an error. ``horizon`` drops the last steps of x."""
    rows = spark.read.parquet(path)
    if dates is not None:
        rows = rows.filter(F.col("date").isin(list(dates)))
    if horizon:
        rows = rows.withColumn("x", F.slice("x", 1, F.greatest(F.size("x") - horizon, F.lit(0))))
    return rows.select(*columns) if columns else rows


def load_config(path: str, family: str, overrides: dict | None = None) -> dict:
    """The parameters of a model family (``linear``, ``cnn``, ``lstm``, ``transformer``) from a YAML or JSON file, with overrides."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ModuleNotFoundError as e:
            raise ValueError("YAML files need PyYAML; JSON files do not") from e
        held = yaml.safe_load(text) or {}
    else:
        held = json.loads(text)
    if family not in held:
        raise KeyError(f"no {family} in {path}")
    return {**(held[family] or {}), **(overrides or {})}


def append_trials(trials: DataFrame, path: str, study: str = "default") -> DataFrame:
    """Adds the trials that ``path`` does not hold yet, by (study, trial); returns those of the study."""
    spark = trials.sparkSession
    own = trials.withColumn("study", F.lit(study))
    try:
        known = spark.read.parquet(path).select("study", "trial")
    except Exception as e:  # the store does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = own.select("study", "trial").limit(0)
    own.join(known, ["study", "trial"], "left_anti").write.mode("append").parquet(path)
    return spark.read.parquet(path).filter(F.col("study") == study)


def write_trials_csv(trials: DataFrame, path: str) -> None:
    """A study's trials in order, as one CSV file with a header: a row for each trial."""
    trials.orderBy("trial").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
