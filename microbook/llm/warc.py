"""WARC archives: write one record per page, read archives back by boundary-chain verification.

Writing. A record is a string (WARC header, HTTP header, payload); Spark's text writer puts the blank
lines that end a record between records, so files are committed by Spark and survive lost executors.
Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id becomes a
response, the others revisits of it.

Reading. The text reader cuts the files, split by split, wherever the magic ``WARC/1.`` stands; each piece
that goes on with the rest of a version line (``WARC/1.0`` or ``WARC/1.1``) is a candidate record. Its place in the file follows from the lengths before it. A
candidate's header names its content's length, and so the offset of its successor. From the start of
each file the chain of successors is followed by pointer jumping (each round doubles the distance), one
join on (file, offset) per round, so a long file is no single task's work. Candidates that no chain
reaches are magic inside payloads; their bytes go back to the record that holds them.

Rows: a null html is an empty payload; a null url is written as an empty target. Repeated pages each get
their record; rows that share a page_id with the largest one of their payload are all responses. A null
page_id loses against any other. An empty table makes an archive without records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, fresh_path, lookup_left, stored, table
from .url_filter import split_by

#: What records are found by; a version's last digit and a line end follow it.
MAGIC = "WARC/1."
VERSION = r"^[01]\r\n"
END = "\r\n\r\n"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_DATE = "2024-01-01T00:00:00Z"


def with_digest(df: DataFrame, payload: Column, name: str) -> DataFrame:
    """``df`` with the bare upper-case base32 of a binary column's SHA-1 as ``name``: 40 hexadecimal digits are 32 letters, ten digits eight of them.

    The hash is a column of its own that the letters are read from, so each payload is hashed once: an
    expression that names the hash for every letter hashes again for each inside a lambda or a branch.
    """
    eights = [F.lpad(F.conv(F.substring(name, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return df.withColumn(name, F.sha1(payload)).withColumn(name, F.translate(F.concat(*eights), _DIGITS, _ALPHABET))


def record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, same, bytes, record_type, refers_to) of every page, without its html. Payloads are equal by ``same``, their SHA-256."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = stored(pages.select("page_id", F.unhex(F.sha2(body, 256)).alias("same"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("bytes")), "payloads")
    kept = rows.groupBy("same", "bytes").agg(F.max("page_id").alias("winner"), F.count("*").alias("n_rows"))
    kept = stored(kept.filter(F.col("bytes") >= min_bytes), "winners")
    out = lookup_left(rows, kept.drop("n_rows"), ["same", "bytes"], kept.select("same", "bytes", "n_rows"))
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return out.select("page_id", "same", "bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("winner")).alias("refers_to"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files into the folder ``path``.

    Only pages that may be revisits (a Bloom filter of fixed size tells) are shuffled to learn what they
    refer to; all others are written where they are read.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).alias("bytes"))
    same = F.unhex(F.sha2(F.col("html").cast("binary"), 256))
    revisits = stored(record_types(pages, min_bytes).filter("record_type = 'revisit'").select("page_id", "same", "refers_to").distinct(), "revisits")
    plain, asks = split_by(rows, [F.col("page_id"), same], revisits.select("page_id", "same"))
    equal = F.col("a.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("a.same") == F.col("r.same"))
    asks = asks.withColumn("same", same).alias("a").join(revisits.alias("r"), equal, "left").select("a.*", "r.refers_to", F.col("r.same").isNotNull().alias("again")).drop("same")
    rows = plain.withColumns({"refers_to": F.lit(None).cast("long"), "again": F.lit(False)}).unionByName(asks)
    rows = with_digest(rows, F.col("html").cast("binary"), "digest")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(F.col("again"), "").otherwise(F.col("html")))
    url = F.replace(F.replace(_text("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    refers = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), _text("refers_to"), F.lit(">\r\n"))
    header = F.concat(
        F.lit(MAGIC + "1\r\nWARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), _text("page_id"),
        F.lit(f">\r\nWARC-Date: {_DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), "digest", F.lit("\r\n"), F.when(F.col("again"), refers).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    rows.select(F.concat(header, block)).write.option("lineSep", END).text(path)


def _head() -> Column:
    return F.substring_index("piece", END, 1)


def _content_length() -> Column:
    return F.nullif(F.regexp_extract(_head(), r"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*\r?$", 1), F.lit("")).cast("long")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, no, piece, h) of what follows each magic up to the next (and, with no magic, precedes the first).

    ``file`` is a hash of the file's path, so offsets travel without it; ``block`` and ``no`` order the pieces
    of one scan; ``h``, a hash of the piece, finds it again in another.
    """
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("no"), F.col("value").alias("piece"), F.xxhash64("value", F.octet_length("value")).alias("h"),
    )


def verified(found: DataFrame, *carried: str) -> DataFrame:
    """(file, start, owner, pieces, h, carried columns) of the pieces of all real records: those of one record share ``owner``,
    the offset of its magic, and ``pieces`` is their number."""
    bytes_ = (F.octet_length("piece") + len(MAGIC)).cast("long")
    span = F.octet_length(_head()) + len(MAGIC) + len(END) + _content_length() + len(END)
    # a piece without a version line is no candidate: its start is no record's, and no chain goes on from it
    span = F.when(F.col("piece").rlike(VERSION), F.coalesce(span, F.lit(0)))
    cells = stored(found.select("file", "block", "no", "h", bytes_.alias("bytes"), span.alias("span"), *carried), "pieces")
    # offsets: inside a split by a running sum, and the splits of a file one after the other
    splits = cells.groupBy("file", "block").agg(F.sum("bytes").alias("all"))
    one_by_one = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", (F.coalesce(F.sum("all").over(one_by_one), F.lit(0)) - len(MAGIC)).alias("base"))
    within = Window.partitionBy("file", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("start", F.coalesce(F.sum("bytes").over(within), F.lit(0))).join(splits, ["file", "block"])
    # a file's first piece stands before its first magic
    placed = placed.withColumn("start", F.col("start") + F.col("base")).filter("start >= 0")
    placed = stored(placed.select("file", "start", "span", "h", *carried), "places")
    ahead = F.when(F.col("span") > 0, F.col("start") + F.col("span")).alias("next")
    reached = reachable(placed.filter("span is not null").select("file", "start", ahead))
    owned = placed.join(reached.withColumn("real", F.lit(True)), ["file", "start"], "left")
    owned = stored(owned.drop("span"), "owned")
    # nearly all files hold no magic but that of records: there each piece is a record
    false = owned.filter("real is null").select("file").distinct()
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    mixed = owned.join(false, "file", "left_semi").withColumn("owner", F.last(F.when(F.col("real"), F.col("start")), ignorenulls=True).over(upto))
    mixed = mixed.filter("owner is not null").withColumn("pieces", F.count("*").over(Window.partitionBy("file", "owner")))
    plain = owned.join(false, "file", "left_anti").withColumns({"owner": F.col("start"), "pieces": F.lit(1).cast("long")})
    return plain.unionByName(mixed).drop("real")


def _records(texts: DataFrame) -> DataFrame:
    """(file, start, header, body) from (file, start, piece): body has exactly the content's bytes."""
    body = F.substring(F.col("piece").cast("binary"), F.octet_length(_head()) + len(END) + 1, _content_length().cast("int"))
    return texts.select("file", "start", F.regexp_replace(_head(), VERSION, "").alias("header"), body.alias("body"))


def _glued(found: DataFrame, owners: DataFrame) -> DataFrame:
    """(file, start, piece) with the pieces of each record put together again."""
    texts = found.select("file", "h", "piece").dropDuplicates(["file", "h"])
    texts = owners.select("file", "h", "start", "owner").join(texts, ["file", "h"])
    parts = texts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("p"))
    return parts.select("file", F.col("owner").alias("start"), F.array_join(F.col("p.piece"), MAGIC).alias("piece"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, header, body) of every record: the header without its magic, the body binary."""
    found = pieces(spark, path)
    return _records(_glued(found, verified(found)))


def reachable(nodes: DataFrame) -> DataFrame:
    """(file, start) of the candidates that the chain from offset 0 of their file reaches.

    ``nodes`` has file, start and next (null or beyond the file's last candidate: the chain ends). After
    round k the jump of a node leads 2**k records on, and all records up to that distance are reached.
    """
    here = nodes.select("file", F.col("start").alias("next"))
    # all joins shuffle: neither the jumps nor what they reach has a bounded size
    jump = stored(nodes.filter("next is not null").join(here.hint("shuffle_merge"), ["file", "next"], "left_semi").select("file", "start", "next"), "jump")
    reached = stored(nodes.filter("start = 0").select("file", "start"), "reached_0")
    n = reached.count()
    while True:
        further = reached.join(jump.hint("shuffle_merge"), ["file", "start"]).select("file", F.col("next").alias("start"))
        old, reached = reached, stored(reached.unionByName(further).distinct(), "reached_k")
        forget(old)
        now = reached.count()
        if now == n:
            return reached
        n = now
        on = jump.select("file", F.col("start").alias("next"), F.col("next").alias("far"))
        old, jump = jump, stored(jump.join(on.hint("shuffle_merge"), ["file", "next"]).select("file", "start", F.col("far").alias("next")), "jump_k")
        forget(old)


def _described(records: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept``, and page_id, payload_bytes, payload_digest, record_type, refers_to from ``header`` and ``body``.

    A response's payload is measured; a revisit holds none: its header tells the full payload's digest
    and, in its HTTP header, length.
    """
    h = F.col("header")
    page = F.nullif(F.regexp_extract(h, r"(?im)^WARC-Record-ID:[ \t]*<urn:page:([^>\r\n]*)>", 1), F.lit(""))
    kind = F.regexp_extract(h, r"(?im)^WARC-Type:[ \t]*([a-z]+)", 1)
    refers = F.nullif(F.regexp_extract(h, r"(?im)^WARC-Refers-To:[ \t]*<urn:page:([^>\r\n]*)>", 1), F.lit(""))
    stated = F.regexp_extract(h, r"(?im)^WARC-Payload-Digest:[ \t]*sha1:([A-Z2-7]+)", 1)
    http = F.substring_index(F.col("body").cast("string"), END, 1)
    stated_bytes = F.regexp_extract(http, r"(?im)^Content-Length:[ \t]*(\d{1,18})", 1).try_cast("long")
    payload = F.substring(F.col("body"), F.octet_length(http) + len(END) + 1, F.octet_length("body"))
    return with_digest(records.withColumn("payload", payload), F.col("payload"), "digest").select(
        *kept,
        page.try_cast("long").alias("page_id"),
        F.when(kind == "revisit", stated_bytes).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(kind == "revisit", stated).otherwise(F.col("digest")).alias("payload_digest"),
        kind.alias("record_type"),
        refers.try_cast("long").alias("refers_to"),
    )


def describe_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives in ``path``.

    Each piece is described as it is scanned, as if it were a whole record; that holds for the real records
    of one piece. Only the texts of records in several pieces are read again and put together.
    """
    found = pieces(spark, path)
    body = F.substring(F.col("piece").cast("binary"), F.octet_length(_head()) + len(END) + 1, _content_length().cast("int"))
    told = _described(found.withColumns({"header": _head(), "body": body}), "file", "block", "no", "h", "piece")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    owners = stored(verified(told, *names), "owners")
    single = owners.filter("pieces = 1").select(*names)
    several = owners.filter("pieces > 1")
    if not several.take(1):
        return single
    return single.unionByName(_described(_records(_glued(found, several))))


def op8_warc(spark, sf_dir):
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return describe_warc(spark, path)


ORACLE = {
    "op8_warc": r"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as d from pages),
c as (select *, max(page_id) over (partition by h) as winner,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(d, 1 + 5 * (i // 4), 5) as int) >> (15 - 5 * (i % 4))) & 31), 1) for i in range(32)], '') as b from p)
select page_id, strlen(h) as payload_bytes, b as payload_digest,
  case when page_id = winner then 'response' else 'revisit' end as record_type, case when page_id <> winner then winner end as refers_to from c"""
}
