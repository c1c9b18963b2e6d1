"""GeoJSON points and CSV counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8", "latin-1", "cp1252")
#: Names that Spark's readers know.  They don't know cp1252: it is read as latin-1, and the signs that differ are put in their places.
_JAVA = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1", "cp1252": "ISO-8859-1"}
_HIGH = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_SIGNS = _HIGH.encode("latin-1").decode("cp1252")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(site_no, site_name, site_type, comments, lon, lat) of a FeatureCollection of points; other geometries are left out."""
    shape = "features array<struct<properties: struct<SITE_NO: string, SITE_NAME: string, SITE_TYPE: string, COMMENTS: string>, geometry: struct<type: string, coordinates: array<double>>>>"
    f = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("features").alias("f")).where("f.geometry.type = 'Point'")
    return f.select(F.col("f.properties.SITE_NO").alias("site_no"), F.col("f.properties.SITE_NAME").alias("site_name"), F.col("f.properties.SITE_TYPE").alias("site_type"), F.col("f.properties.COMMENTS").alias("comments"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


def encoding_of(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The first encoding that every line of the files fits; lines are judged where they are read."""
    lines = spark.read.text(path)
    for name in encodings:
        if not lines.where(~_fits(F.col("value"), name)).limit(1).count():
            return name
    raise ValueError(f"none of {encodings} fits {path}")


def read_csv(spark: SparkSession, path, schema: str | None = None, encoding: str | None = None, infer: bool = False) -> DataFrame:
    """CSV with a header; without a schema all columns are texts, or, with ``infer``, of types that a pass over the data finds.

    ``encoding`` None: the first that fits the bytes; of several paths each has its own, and their columns are matched by name.
    """
    if not isinstance(path, str) and encoding is None and len(path) > 1:
        from roadflow.operators.clean import read_union

        return read_union([read_csv(spark, p, schema, None, infer) for p in path])
    return _csv(spark, path, encoding or encoding_of(spark, path if isinstance(path, str) else path[0]), schema, infer)


def _csv(spark: SparkSession, path, encoding: str, schema: str | None = None, infer: bool = False) -> DataFrame:
    reader = spark.read.option("header", True).option("inferSchema", infer).option("encoding", _JAVA.get(encoding.lower(), encoding))
    df = (reader.schema(schema) if schema else reader).csv(path)
    if encoding.lower() not in ("cp1252", "windows-1252"):
        return df
    named = lambda c: c.translate(str.maketrans(_HIGH, _SIGNS))
    return df.withColumns({c: F.translate(F.col(f"`{c}`"), _HIGH, _SIGNS) for c, kind in df.dtypes if kind == "string"}).withColumnsRenamed({c: named(c) for c in df.columns})


def _children(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(x.getPath().getName() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))


def years(spark: SparkSession, root: str) -> list[str]:
    """Names of the year folders: digits only."""
    return [x for x in _children(spark, root) if x.isdigit()]


def files_of_years(spark: SparkSession, pattern: str, first: int = 2014, last: int = 2025) -> list[str]:
    """Paths of a glob pattern, by name, whose name holds a year from ``first`` to ``last`` (its first run of four digits)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = [x.getPath() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or ()]
    year = lambda p: re.search(r"\d{4}", p.getName())
    return sorted(p.toString() for p in found if (m := year(p)) and first <= int(m[0]) <= last)


def read_years(spark: SparkSession, pattern: str, first: int = 2014, last: int = 2025, schema: str | None = None) -> DataFrame:
    """The CSV files of ``files_of_years``, each in its own encoding, with the file's name; a file that can't be read fails the query."""
    paths = files_of_years(spark, pattern, first, last)
    if not paths:
        raise FileNotFoundError(f"no file of {first} to {last} in {pattern}")
    return _strictly(*scan_files(spark, paths, schema))


def read_year(spark: SparkSession, root: str, year: str, limit: int | None = None, skip_corrupt: bool = False) -> DataFrame:
    """All ``VSDATA_*.csv`` of a year (the first ``limit`` by name), each in its own encoding, with the file's name.

    A file that can't be read fails the query; ``skip_corrupt`` leaves it out: ``scan_year`` also tells why.
    """
    rows, skipped = scan_year(spark, root, year, limit)
    return rows if skip_corrupt else _strictly(rows, skipped)


def scan_year(spark: SparkSession, root: str, year: str, limit: int | None = None, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the readable ``VSDATA_*.csv`` of a year, with the file's name; skipped files as (filename, reason))."""
    names = [x for x in _children(spark, f"{root}/{year}") if x.startswith("VSDATA_") and x.endswith(".csv")][:limit]
    if not names:
        raise FileNotFoundError(f"no VSDATA_*.csv in {root}/{year}")
    return scan_files(spark, [f"{root}/{year}/{x}" for x in names], schema)


def _strictly(rows: DataFrame, skipped: DataFrame) -> DataFrame:
    faults = [f"{r['filename']}: {r['reason']}" for r in skipped.limit(20).collect()]
    if faults:
        raise ValueError("unreadable files: " + "; ".join(faults))
    return rows


def _uri(spark: SparkSession, path: str) -> str:
    """The name that Spark gives a file in its metadata, local ones with one slash."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "file:/", at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString())


def inspect_files(spark: SparkSession, paths: list[str], encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """(path, encoding, reason): for each file the first encoding that all its lines fit, or why it can't be read.

    Lines are judged in the tasks that read them, as bytes, so files are split like any others and one bad file hides no other.  Reasons: no line at
    all, no encoding fits, a row has more fields than the header, a quote is never closed, a NUL byte is in it.  Line breaks inside quotes are not expected in counts.
    """
    names = spark.createDataFrame([(_uri(spark, p), p) for p in paths], "_uri string, path string")
    lines = spark.read.text(paths).select("value", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("_uri"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")).alias("at"))
    raw = F.col("value").cast("binary")
    bare = F.regexp_replace(F.decode(raw, "ISO-8859-1"), '"[^"]*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    fits = [_fits(F.col("value"), name).alias(f"fit{i}") for i, name in enumerate(encodings)]
    blank = F.trim(bare) == ""
    judged = lines.select("_uri", "at", F.when(~blank, fields).alias("fields"), bare.contains('"').alias("open"), bare.contains("\x00").alias("nul"), *fits)
    # a few numbers for each file; the header is its first line
    found = judged.groupBy("_uri").agg(F.min_by("fields", "at").alias("header"), F.max("fields").alias("most"), F.bool_or("open").alias("open"), F.bool_or("nul").alias("nul"), *[F.bool_and(f"fit{i}").alias(f"fit{i}") for i in range(len(encodings))])
    encoding = F.coalesce(*[F.when(F.col(f"fit{i}"), F.lit(name)) for i, name in enumerate(encodings)])
    found = found.select("_uri", F.lit(True).alias("seen"), encoding.alias("encoding"), "header", "most", "open", "nul")
    reason = (
        F.when(F.col("seen").isNull(), "no line in it").when(F.col("encoding").isNull(), "no encoding fits").when(F.col("nul"), "a NUL byte is in it").when(F.col("open"), "a quote is never closed").when(F.col("most") > F.col("header"), "a row has more fields than the header")
    )
    return names.join(found, "_uri", "left").select("path", "encoding", reason.alias("reason"))


def _fits(line: Column, encoding: str) -> Column:
    """Whether every byte of a line, read as it is, has a meaning in the encoding."""
    if encoding.lower() in ("latin-1", "iso-8859-1"):
        return F.lit(True)
    if encoding.lower() == "utf-8":
        return F.is_valid_utf8(line)
    if encoding.lower() in ("cp1252", "windows-1252"):
        return ~F.decode(line.cast("binary"), "ISO-8859-1").rlike("[\\x81\\x8D\\x8F\\x90\\x9D]")  # the five bytes without a sign
    raise ValueError(f"unknown encoding {encoding!r}")


def scan_files(spark: SparkSession, paths: list[str], schema: str | None = None, encodings: tuple[str, ...] = ENCODINGS) -> tuple[DataFrame, DataFrame]:
    """(rows of the readable files with ``filename``; skipped files as (filename, reason)): one scan for each encoding that occurs.

    Columns that a file lacks are null.  Without a schema all columns are texts.
    """
    from roadflow.operators.clean import read_union

    judged = inspect_files(spark, paths, encodings).collect()  # one row for each file
    skipped = spark.createDataFrame([(r["path"].rsplit("/", 1)[-1], r["reason"]) for r in judged if r["reason"]], "filename string, reason string")
    good = [(r["path"], r["encoding"]) for r in judged if not r["reason"]]
    parts = []
    for name in dict.fromkeys(e for _, e in good):
        own = sorted(p for p, e in good if e == name)
        if schema:
            groups = [own]
        else:  # files of one header are one scan: columns are matched by name, not by place
            heads: dict[tuple, list[str]] = {}
            for p in own:
                heads.setdefault(_header(spark, p, name), []).append(p)
            groups = list(heads.values())
        for group in groups:
            parts.append(_csv(spark, group, name, schema).withColumn("filename", F.element_at(F.split(F.input_file_name(), "/"), -1)))
    if not parts:
        return spark.createDataFrame([], (schema + ", " if schema else "") + "filename string"), skipped
    return (parts[0] if len(parts) == 1 else read_union(parts)), skipped


def _header(spark: SparkSession, path: str, encoding: str) -> tuple[str, ...]:
    """Column names of one file, from its first line."""
    return tuple(_csv(spark, path, encoding).columns)


def write_years(df: DataFrame, path: str, date: str = "date") -> None:
    """Parquet, one folder for each year."""
    df.withColumn("year", F.year(date)).write.mode("overwrite").partitionBy("year").parquet(path)


def stage_name(name: Column, old: str = "transformed", new: str = "featured") -> Column:
    """A file's name in the next stage."""
    return F.replace(name, F.lit(old), F.lit(new))


def write_csv(df: DataFrame, path: str, stage: str, year: str | None = None) -> str:
    """A stage's rows as CSV files with a header, in a folder for the stage (and the year); returns the folder."""
    folder = f"{path}/{stage}" + (f"/{year}" if year else "")
    df.write.mode("overwrite").option("header", True).csv(folder)
    return folder


def scats_sheet(df: DataFrame, site: int = 0, date: int = 9, first_time: int = 10, skip_last: int = 3) -> DataFrame:
    """(site, date, time, flow): the long form of a sheet whose times are columns, by position."""
    names = df.columns
    times = names[first_time : len(names) - skip_last]
    return df.select(F.col(names[site]).alias("site"), F.col(names[date]).alias("date"), *[F.col(f"`{t}`").cast("double").alias(t) for t in times]).unpivot(["site", "date"], times, "time", "flow")
