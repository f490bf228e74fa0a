"""Headers are read where tasks run; arriving files of any header land as one table."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marketspark.sources import files


def write(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_header_lines(tmp_path):
    write(tmp_path / "a b%20.csv", "﻿id,price\n1,2\n")
    write(tmp_path / "empty.csv", "")
    write(tmp_path / "long.csv", "x" * 200_000)
    assert files.header_line(f"file:{tmp_path}/a b%20.csv") == "﻿id,price"
    assert files.header_line(f"file://{tmp_path}/empty.csv") == "" and files.header_line(f"{tmp_path}/long.csv") == "x" * files.HEADER_BYTES


def test_groups_and_missing_files(spark, tmp_path):
    write(tmp_path / "A_1.csv", "id,price,qty,time,is_buyer_maker\n1,2.5,1,1704067200000,true\n")
    write(tmp_path / "B_1.csv", '"price","id","extra","time"\n"3.5","2","z","1704067200001"\n')
    write(tmp_path / "C_1.csv", "")
    groups = files.header_groups(files.listed(spark, f"{tmp_path}/*.csv"))
    assert sorted(groups) == [("id", "price", "qty", "time", "is_buyer_maker"), ("price", "id", "extra", "time")]
    got = {r["symbol"]: (r["id"], r["price"], r["qty"]) for r in files.scan_ticks(spark, f"{tmp_path}/*.csv").collect()}
    assert got == {"A": (1, 2.5, 1.0), "B": (2, 3.5, None)}
    assert files.scan_ticks(spark, f"{tmp_path}/none/*.csv").count() == 0


def test_landing_keeps_a_registry(spark, tmp_path):
    base, landed, mark = tmp_path / "in", str(tmp_path / "landed"), str(tmp_path / "mark")
    write(base / "A_1.csv", "id,price,time\n1,2.5,1704067200000\n2,2.75,1704067200000\n")
    files.land_ticks(spark, f"{base}/*.csv", landed, mark).awaitTermination()
    write(base / "A_2.csv", "time,price,id\n1704067200001,3.5,3\n")
    write(base / "B_1.csv", "id,price,time\n4,1.0,1704067200001\n")
    files.land_ticks(spark, f"{base}/*.csv", landed, mark, files_per_trigger=1).awaitTermination()
    assert sorted((r["symbol"], r["id"], r["price"]) for r in spark.read.parquet(landed).collect()) == [("A", 1, 2.5), ("A", 2, 2.75), ("A", 3, 3.5), ("B", 4, 1.0)]
    known = {(r["batch"], r["header"], r["files"]) for r in spark.read.json(f"{landed}-headers").collect()}
    assert {h for _, h, _ in known} == {"id,price,time", "time,price,id"} and len({b for b, *_ in known}) == 3


def test_few_headers_are_few_tasks(spark, tmp_path):
    """The tasks follow the files, so a batch of three files is not a task for each shuffle partition."""
    for i in range(40):
        write(tmp_path / f"S{i}_1.csv", f"id,price,c{i % 2}\n1,2.5,1\n")
    found = files.headers_of(files.listed(spark, f"{tmp_path}/*.csv"))
    assert found.rdd.getNumPartitions() == 3 and found.count() == 40
    assert files.headers_of(files.listed(spark, f"{tmp_path}/S3_*.csv")).rdd.getNumPartitions() == 1
    assert sorted(len(p) for p in files.header_groups(files.listed(spark, f"{tmp_path}/*.csv")).values()) == [20, 20]


def test_symbol_of_a_path(spark):
    """The symbol of each row without a pattern; the values are those of the pattern that was used before."""
    pattern = r"([^/_]+)_[^/]*\.csv(?:/[^/]*)?$"
    paths = ["file:/d/click_trades.csv/part-00000-a_b-c000.csv", "file:///d_e/BTC_1.csv", "/x_y.csv", "x_y.csv", "_x_y.csv", "/d/__x__y.csv", "/d/x.csv", "/d/x_.csv", "/d/_.csv", "/d/_x.csv", "/a_b.csv/c/d.csv",
             "/a_b.csv/c/e_d.csv", "/a_b.csv/e_d.csv", "/_a.csv/e_d.csv", "/a_b/c.csv", "/d/a_b.csv.gz", "/d/a b%20c_d.csv", "/d/\u00e4\u00f6_1.csv", "a_b.csv/", "", "/", "__.csv/_.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = df.select("path", files.tick_symbol("path").alias("got"), F.regexp_extract("path", pattern, 1).alias("want")).collect()
    assert [(r["path"], r["got"]) for r in got] == [(r["path"], r["want"]) for r in got] and got[0]["got"] == "click"


def test_unknown_scheme_is_told():
    with pytest.raises(KeyError):
        files.header_line("odd://host/file.csv")
