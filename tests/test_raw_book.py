"""Raw books whose files differ in their headers: one scan, by name, in file order, and only the stocks asked for."""

import gzip
import random

import pytest

from microbook.functions import book as B
from microbook.sources import io

NAMES = ["t", "nature", *B.BOOK]


def write(folder, stock, order, rows, ending=".gz"):
    with gzip.open(folder / f"stock_{stock}{ending}", "wt") as f:
        f.write("\n".join([",".join(order), *[",".join(str(r.get(c, "")) for c in order) for r in rows]]) + "\n")


def made(stock, n):
    rng = random.Random(stock)
    rows = [{c: round(rng.uniform(90, 110), 3) for c in B.BOOK} | {"t": f"2023-01-02T09:{i // 60:02d}:{i % 60:02d}.000000+00:00", "nature": "q", "other": "x,"[:1]} for i in range(n)]
    rows[0]["bb2"] = ""
    return rows


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    held = {}
    for k in range(9):
        order = NAMES + ["other"]
        random.Random(k).shuffle(order)
        if k == 4:
            order.remove("ba5")
        held[str(k)] = made(k, 3 + 40 * k)
        write(tmp_path, k, order, held[str(k)], ".csv.gz" if k % 2 else ".gz")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = io.read_raw_book(spark, str(tmp_path), mixed=True).orderBy("stock_id", "ord").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == sum(map(len, held.values())) and len({r["ord"] for r in got}) == len(got)
    for stock, rows in held.items():
        own = [r for r in got if r["stock_id"] == stock]
        assert [r["t"].strftime("%M:%S") for r in own] == [r["t"][14:19] for r in rows]
        for r, want in zip(own, rows, strict=True):
            assert [r[c] for c in B.BOOK] == [None if want[c] == "" or (stock, c) == ("4", "ba5") else want[c] for c in B.BOOK]


@pytest.mark.parametrize("mixed", [False, True])
def test_only_the_stocks_asked_for_are_opened(spark, tmp_path, mixed):
    for k in (1, 2, 3):
        write(tmp_path, k, NAMES, made(k, 4))
    (tmp_path / "stock_9.gz").write_bytes(b"no gzip file at all")
    got = io.read_raw_book(spark, str(tmp_path), mixed=mixed, stocks=["1", "3", "77"]).collect()
    assert sorted({r["stock_id"] for r in got}) == ["1", "3"] and len(got) == 8
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.read_raw_book(spark, str(tmp_path), mixed=mixed, stocks=["77"]).collect()


def test_files_read_in_parts_are_an_error(spark, tmp_path):
    rows = made(1, 2000)
    (tmp_path / "stock_1.csv").write_text("\n".join([",".join(NAMES), *[",".join(str(r[c]) for c in NAMES) for r in rows]]) + "\n")
    assert io.read_raw_book(spark, str(tmp_path), mixed=True).count() == 2000  # in one piece
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        with pytest.raises(Exception, match="in parts"):
            io.read_raw_book(spark, str(tmp_path), mixed=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_files_and_headers_alone(spark, tmp_path):
    write(tmp_path, 1, NAMES, [])
    write(tmp_path, 2, NAMES, made(2, 2))
    with gzip.open(tmp_path / "stock_3.gz", "wt"):
        pass
    assert [r["stock_id"] for r in io.read_raw_book(spark, str(tmp_path), mixed=True).collect()] == ["2", "2"]
