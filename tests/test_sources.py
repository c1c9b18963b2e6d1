"""Scans with faults by file, and rewrites of stages that fail half-way."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from roadflow.sources import files, stages

WESTERN = ("utf-8", "cp1252", "latin-1")


def _folder(tmp_path):
    year = tmp_path / "raw" / "2014"
    year.mkdir(parents=True)
    (year / "VSDATA_1.csv").write_bytes("site,name,V00\n1,café,5\n2,\"a, b\",6\n".encode())
    (year / "VSDATA_2 two+%.csv").write_bytes("name,site,V00,extra\n“café”,3,7,x\n".encode("cp1252"))
    (year / "VSDATA_3.csv").write_bytes(b"site,name,V00\n4,ok,8\n5,\"torn")
    (year / "VSDATA_4.csv").write_bytes(b"")
    (year / "VSDATA_5.csv").write_bytes(b"site,name,V00\n6,too,many,fields\n")
    (year / "VSDATA_6.csv").write_bytes(b"site,name,V00\n7,nul\x00,1\n")
    (year / "VSDATA_7.csv").write_bytes(b"site,name,V00\n8,\x81high,9\n")
    (year / "VSDATA_8.csv").write_bytes(b"site,name,V00\r\n9,few\r\n\r\n")
    (year / "other.csv").write_bytes(b"not,read\n")
    return str(tmp_path / "raw")


def test_faults_by_file(spark, tmp_path):
    root = _folder(tmp_path)
    paths = [f"{root}/2014/{n}" for n in ("VSDATA_1.csv", "VSDATA_2 two+%.csv", "VSDATA_7.csv")]
    assert {r["path"].rsplit("/", 1)[-1]: r["encoding"] for r in files.inspect_files(spark, paths, WESTERN).collect()} == {"VSDATA_1.csv": "utf-8", "VSDATA_2 two+%.csv": "cp1252", "VSDATA_7.csv": "latin-1"}
    rows, skipped = files.scan_year(spark, root, "2014")
    assert sorted(map(tuple, skipped.collect())) == [
        ("VSDATA_3.csv", "a quote is never closed"), ("VSDATA_4.csv", "no line in it"), ("VSDATA_5.csv", "a row has more fields than the header"), ("VSDATA_6.csv", "a NUL byte is in it"),
    ]
    got = {r["site"]: (r["name"], r["V00"], r["extra"]) for r in rows.collect()}
    assert got["1"] == ("café", "5", None) and got["2"] == ("a, b", "6", None) and got["9"] == ("few", None, None)
    assert got["3"][1:] == ("7", "x") and set(got) == {"1", "2", "3", "8", "9"}
    western, _ = files.scan_files(spark, paths, encodings=WESTERN)
    assert {r["site"]: r["name"] for r in western.collect()}["3"] == "“café”"
    with pytest.raises(ValueError, match="never closed"):
        files.read_year(spark, root, "2014")
    assert files.read_year(spark, root, "2014", skip_corrupt=True).count() == 5
    assert files.read_year(spark, root, "2014", limit=2).count() == 3
    with pytest.raises(FileNotFoundError):
        files.scan_year(spark, root, "2014x") if (tmp_path / "raw" / "2014x").mkdir() is None else None


def test_only_faulty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    rows, skipped = files.scan_files(spark, [str(tmp_path / "a.csv")], "site long")
    assert rows.columns == ["site", "filename"] and rows.count() == 0 and skipped.count() == 1


def test_each_path_has_its_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("n\nä\n".encode())
    (tmp_path / "b.csv").write_bytes("n\nä\n".encode("latin-1"))
    for paths in ([str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")]):
        assert [r["n"] for r in files.read_csv(spark, paths).collect()] == ["ä", "ä"]


def _fails(spark, at):
    return spark.range(20).repartition(4).select(F.when(F.col("id") == at, F.raise_error(F.lit("torn")).cast("long")).otherwise(F.col("id")).alias("cost"), (F.col("id") % 3).alias("day"))


def test_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "stage")
    stages.replace(spark.range(3).select(F.col("id").alias("cost")), path)
    read = lambda: sorted(r[0] for r in spark.read.parquet(path).select("cost").collect())
    with pytest.raises(Exception, match="torn"):
        stages.replace(_fails(spark, 13), path)
    assert read() == [0, 1, 2] and [p.name for p in tmp_path.iterdir()] == ["stage"]
    stages.replace(spark.read.parquet(path).select((F.col("cost") + 10).alias("cost")), path)  # from its own rows
    assert read() == [10, 11, 12] and [p.name for p in tmp_path.iterdir()] == ["stage"]
    (tmp_path / "stage").rename(tmp_path / "stage.old")  # cut off between the renames
    stages.recover(spark, path)
    assert read() == [10, 11, 12]
    stages.replace(spark.range(1).select(F.lit("a,b").alias("cost")), path, "csv", header=True)
    assert spark.read.option("header", True).csv(path).first()["cost"] == "a,b"


def test_replaced_partitions(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(9).select(F.col("id").alias("cost"), (F.col("id") % 3).alias("day")).write.partitionBy("day").parquet(path)
    read = lambda: sorted((r["day"], r["cost"]) for r in spark.read.parquet(path).collect())
    before = read()
    with pytest.raises(Exception, match="torn"):
        stages.replace_partitions(_fails(spark, 7), path, ["day"])
    assert read() == before and [p.name for p in tmp_path.iterdir()] == ["table"]
    stages.replace_partitions(spark.read.parquet(path).where("day = 1").select((F.col("cost") * 100).alias("cost"), "day"), path, ["day"])
    assert read() == sorted([(d, c) for d, c in before if d != 1] + [(1, c * 100) for d, c in before if d == 1])
