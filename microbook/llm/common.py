"""Shared plumbing: durable intermediate tables, hot-key joins, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.io import fresh_path

#: A key is hot when it holds more than this share of the rows; so at most 1/share keys are hot.
HOT_SHARE = 1 / 1000
#: Edges of a graph that one task may hold; rounds over more are shuffled.
FEW_EDGES = 100_000


def stored(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that no plan reads any more: those of a loop's earlier rounds."""
    for df in tables:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup_left(rows: DataFrame, facts: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """``rows LEFT JOIN facts`` on ``keys`` where ``facts`` has one row per key and some keys may hold most of the rows.

    Keys with over HOT_SHARE of the rows (at most 1000, so their facts may be broadcast) are looked up
    in place; only the other rows are shuffled. ``counts`` may give the rows per key (keys, ``n_rows``)
    where they are known already. Null keys find nothing.
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    total, most = counts.agg(F.sum("n_rows"), F.max(F.when(known, F.col("n_rows")))).first()
    least = max(64, int((total or 0) * HOT_SHARE))
    if (most or 0) <= least:
        return rows.join(facts, keys, "left")
    hot = counts.filter((F.col("n_rows") > least) & known).select(*keys)
    value_cols = [c for c in facts.columns if c not in keys]
    hot_facts = hot.join(facts, keys).withColumn("__hot", F.lit(True))
    marked = rows.join(F.broadcast(hot_facts), keys, "left")
    cols = list(dict.fromkeys([*rows.columns, *facts.columns]))
    here = marked.filter(F.col("__hot").isNotNull()).select(*cols)
    rest = marked.filter(F.col("__hot").isNull()).drop("__hot", *value_cols)
    return here.unionByName(rest.join(facts, keys, "left").select(*cols))


def checksum(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u long, v long)``: (node, comp), comp the smallest node reachable.

    Alternating large-star and small-star steps. Each step is a grouped minimum (combined before the
    shuffle) and a look-up that treats hubs apart, and is stored in the shared folder, so neither a hub
    nor a long lineage ends in one task. The steps over up to FEW_EDGES edges are a task each, without a shuffle:
    a step never adds edges, and dealing so few to all partitions costs the driver more than the step itself.
    Nodes without an edge do not occur.
    """
    e = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc_edges")
    before = checksum(e)
    few = before[0] <= FEW_EDGES

    def held(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    def lowest(rows: DataFrame, low: DataFrame, facts: DataFrame) -> DataFrame:
        return rows.join(facts.hint("merge"), ["u"], "left") if few else lookup_left(rows, facts, ["u"], low.select("u", "n_rows"))

    while True:
        both = held(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows"))
        large = lowest(both, low, low.select("u", F.least("u", "m").alias("m"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), "cc_large")
        # every edge now points from the larger node u to a smaller node v
        rows = held(large)
        low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows"))
        small = lowest(rows, low, low.select("u", "m"))
        small = held(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))))
        old, e = e, stored(small.filter("u <> v").distinct(), "cc_small")
        forget(old, large)
        now = checksum(e)
        if now == before:
            break
        before = now
    members = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    roots = held(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
    return members.unionByName(roots)


def ranked(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``__at``, a row's place from 0 among those of equal ``by`` in ``order`` (nulls first), and ``__n``, how many these are.

    One range sort over all rows, so no group meets in one task, however large; then each partition's rows of a
    group are counted, and the places go on from those of the partitions before. The sorted rows are stored, and
    so are the counts: a row per partition and group in it, which are joined back by broadcast only where they are
    small. ``df`` is read twice and should be a stored table. Equal rows are told apart by where they stand.
    """
    keys = [*by, *order, "__tie"]
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    rows = stored(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie").withColumn("__gid", F.monotonically_increasing_id()), f"{name}_sorted")
    rows = rows.withColumn("__part", F.shiftright("__gid", 33))
    counted = rows.groupBy("__part", *by).agg(F.count("*").alias("__rows"), F.min("__gid").alias("__first"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__rows").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = stored(counted.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__by_{c}") for c in by], "__first", before.alias("__before"), F.sum("__rows").over(group).alias("__n")), f"{name}_counts")
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    out = rows.join(counted, same)
    return out.withColumn("__at", F.col("__before") + F.col("__gid") - F.col("__first")).select(*df.columns, "__gid", "__at", "__n")
