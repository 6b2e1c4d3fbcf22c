"""Readers for the input tables."""

from __future__ import annotations

import csv
import logging
from collections.abc import Callable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cindergrid.functions.temporal import parse_date

log = logging.getLogger(__name__)

# Column names and types of the input files.
STRIKE_SCHEMA = ("fid bigint, date_group string, local_striketime string, gmt_striketime string, "
                 "mst_striketime string, latitude double, longitude double, strength int, multiplicity int")
INCIDENT_COLUMNS = ["fire_start_date", "fire_location_latitude", "fire_location_longitude"]
RAW_DOUBLES = ["10u", "10v", "2d", "2t", "cl", "cvh", "cvl", "fal", "lai_hv", "lai_lv", "lsm", "slt", "sp",
               "src", "stl1", "stl2", "stl3", "stl4", "swvl1", "swvl2", "swvl3", "swvl4", "tvh", "tvl", "z",
               "e", "pev", "slhf", "sshf", "ssr", "ssrd", "str", "strd", "tp"]
RAW_COUNTS = ["is_fire_day", "lightning_count", "absv_strength_sum", "multiplicity_sum", "railway_count",
              "power_line_count", "highway_count", "aeroway_count", "waterway_count"]


def raw_schema() -> StructType:
    """Schema of a raw cell-day file."""
    parts = ["date date", "latitude double", "longitude double"]
    parts += [f"`{c}` double" for c in RAW_DOUBLES + RAW_COUNTS]
    return StructType.fromDDL(", ".join(parts))


def _list_files(spark: SparkSession, path: str, recursive: bool, suffix: str) -> list[str]:
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
              .option("recursiveFileLookup", str(recursive).lower()).load(path).select("path"))
    return sorted(r.path for r in listed.collect())


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str) -> DataFrame:
    """CSV files with headers, matched to ``schema`` by column name; missing columns are NULL.

    Files that share a header are read as one scan, so thousands of monthly files stay one plan.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    paths = [paths] if isinstance(paths, str) else list(paths)
    names = {f.name: f for f in schema.fields}
    by_header: dict[tuple, list[str]] = {}
    for header, group in _headers(spark, paths):
        by_header.setdefault(header, []).extend(group)
    if not by_header:
        raise FileNotFoundError(f"no readable CSV in {paths}")
    parts = []
    for header, group in by_header.items():
        file_schema = StructType([names.get(h) or StructType.fromDDL(f"`{h}` string").fields[0] for h in header])
        part = spark.read.schema(file_schema).csv(group, header=True, mode="PERMISSIVE")
        parts.append(part.select(*[f"`{h}`" for h in header if h in names]))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    missing = {n: F.lit(None).cast(f.dataType) for n, f in names.items() if n not in out.columns}
    return out.withColumns(missing).select(*[f"`{n}`" for n in names]) if missing else out.select(
        *[f"`{n}`" for n in names])


def _headers(spark: SparkSession, paths: Sequence[str]):
    """``header, [path]`` of the files, one pair for all files of one header, found in one job however many files there
    are. Files without a line are logged and hold nothing; a file that can't be read is an error."""
    lines = spark.read.text(list(paths)).select(
        "value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"))
    first = lines.filter("start = 0").groupBy("path").agg(F.min_by("value", "at").alias("header"))
    found = first.groupBy("header").agg(F.collect_list("path").alias("paths")).orderBy("header").collect()
    files = sum(len(r.paths) for r in found)
    if files < len(paths):
        log.warning("%d of %d files are empty", len(paths) - files, len(paths))
    for r in found:
        names = tuple(h.strip() for h in next(csv.reader([r.header.lstrip("\ufeff")]), []))
        if not any(names):
            raise ValueError(f"no header in {sorted(r.paths)[:5]}")
        yield names, sorted(unquote(p) for p in r.paths)


def read_directory(spark: SparkSession, path: str, schema: StructType | str, recursive: bool = False) -> DataFrame:
    """Every ``*.csv`` below a directory as one table; an empty directory is an error."""
    files = _list_files(spark, path, recursive, ".csv")
    if not files:
        raise FileNotFoundError(f"no CSV files in {path}")
    return read_csv(spark, files, schema)


def read_months(spark: SparkSession, base: str, years: Sequence[int], months: Sequence[int] = tuple(range(1, 13)),
                schema: StructType | None = None, missing: str = "log") -> DataFrame:
    """The monthly files (named ``...yyyymm.csv``) of the given years and months.

    Absent months are logged; with ``missing="raise"`` they are an error."""
    if missing not in ("log", "raise"):
        raise ValueError("missing is 'log' or 'raise'")
    wanted = [f"{y}{m:02d}" for y in years for m in months]
    by_month = {f[-10:-4]: f for f in _list_files(spark, base, False, ".csv")}
    absent = [m for m in wanted if m not in by_month]
    if len(absent) == len(wanted) or (absent and missing == "raise"):
        raise FileNotFoundError(f"months {absent} are not in {base}")
    if absent:
        log.warning("months %s are not in %s", absent, base)
    return read_csv(spark, [by_month[m] for m in wanted if m in by_month], schema or raw_schema())


def read_period(spark: SparkSession, path: str, *periods: str) -> DataFrame:
    """Chosen ``yyyymm`` partitions of a table written by period; other partitions are not opened."""
    return spark.read.parquet(path).filter(F.col("period").cast("string").isin([str(p) for p in periods]))


def _is_finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` ran to its end: committers leave the mark last."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at ``path``; when there is none yet, or only a part of one, build and store it first."""
    if not _is_finished(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_strikes(spark: SparkSession, path: str, cache: str | None = None) -> DataFrame:
    """Strike files of all sub-directories, their mixed headers and date formats merged.

    With ``cache`` the merged table is stored, sorted within files, and reused by later calls.
    """
    def build() -> DataFrame:
        rows = read_directory(spark, path, STRIKE_SCHEMA, recursive=True)
        return (rows.withColumn("date", F.to_date(parse_date("date_group")))
                .sortWithinPartitions("date_group", "latitude", "longitude"))

    return reuse_or_build(spark, cache, build) if cache else build()


def incidents(df: DataFrame) -> DataFrame:
    """``date, latitude, longitude`` of dated and located incidents; a missing column is an error."""
    absent = [c for c in INCIDENT_COLUMNS if c not in df.columns]
    if absent:
        raise ValueError(f"incident table lacks {absent}")
    when = F.col("fire_start_date")
    if dict(df.dtypes)["fire_start_date"] == "string":
        when = parse_date(when)
    return df.select(F.to_date(when).alias("date"),
                     F.col("fire_location_latitude").cast("double").alias("latitude"),
                     F.col("fire_location_longitude").cast("double").alias("longitude")).dropna("any")


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incidents from a Parquet or CSV export."""
    if path.endswith(".csv"):
        return incidents(spark.read.csv(path, header=True))
    return incidents(spark.read.parquet(path))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Pre-collected feature points ``category, latitude, longitude`` from CSV."""
    return (read_csv(spark, path, "category string, lat double, lon double")
            .select("category", F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).dropna("any"))


def track_points(df: DataFrame, time="time", lat="latitude", lon="longitude", elevation="elevation") -> DataFrame:
    """Parallel array columns as rows ``Time, Latitude, Longitude, Elevation``."""
    zipped = F.arrays_zip(F.col(time).alias("Time"), F.col(lat).alias("Latitude"),
                          F.col(lon).alias("Longitude"), F.col(elevation).alias("Elevation"))
    keep = [c for c in df.columns if c not in (time, lat, lon, elevation)]
    return df.select(*keep, F.inline(zipped))


def run_parameters(spark: SparkSession, path: str, key: str) -> dict:
    """One named parameter set of a JSON run configuration."""
    row = spark.read.json(path, multiLine=True).select(F.col(f"`{key}`")).first()[0]
    return row.asDict(recursive=True)
