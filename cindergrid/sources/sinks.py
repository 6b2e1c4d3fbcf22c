"""Writers. Each is one distributed write; nothing is gathered first."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from cindergrid.operators.grid import CELL_DAY, period_key

ROWS_PER_FILE = 700_000


def write_periods(df: DataFrame, path: str, fmt: str = "parquet", replace: str = "months") -> None:
    """One ``period=yyyymm`` directory per month with data.

    Only the months in ``df`` are replaced, all at once when the write has succeeded; ``replace="all"`` empties the
    table first. Rows are gathered by period so that files are few; a month with very many rows is split over
    several tasks and files by size.
    """
    if replace not in ("months", "all"):
        raise ValueError("replace is 'months' or 'all'")
    out = df.withColumn("period", period_key()).hint("rebalance", "period")
    mode = "dynamic" if replace == "months" else "static"
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("period")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.parquet(path)


def write_months(df: DataFrame, base: str, prefix: str = "raw_") -> None:
    """One CSV file ``<prefix>yyyymm.csv`` per month with data, as ``readers.read_months`` takes them.

    All months are written aside first. Only when every task has succeeded do the new files take the place of the old
    ones of their months, each in one step; files of other months aren't touched. A month is one file of one task, written as
    it streams by; for months too large for that use :func:`write_periods`.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files, aside = jvm.org.apache.hadoop.fs, f"{base.rstrip('/')}/_new-{uuid.uuid4().hex}"
    root = files.Path(base)
    store, at = root.getFileSystem(conf), files.Path(aside)
    try:
        df.withColumn("period", period_key()).repartition("period").write.partitionBy("period").option("header", "true").csv(aside)
        context = files.FileContext.getFileContext(store.getUri(), conf)
        over = spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
        over[0] = files.Options.Rename.OVERWRITE
        for month in store.globStatus(files.Path(f"{aside}/period=*")) or []:
            (part,) = store.globStatus(files.Path(month.getPath(), "part-*"))
            name = f"{prefix}{month.getPath().getName().removeprefix('period=')}.csv"
            context.rename(part.getPath(), store.makeQualified(files.Path(root, name)), over)
    finally:
        store.delete(at, True)


def write_table(df: DataFrame, path: str, fmt: str = "csv", sort: bool = False) -> None:
    """A processed, scored or report table; ``sort`` orders each file by cell-day."""
    out = df.sortWithinPartitions(*[c for c in CELL_DAY if c in df.columns]) if sort else df
    writer = out.write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.parquet(path)


def write_split_files(df: DataFrame, path: str, rows: int = ROWS_PER_FILE) -> None:
    """CSV files of at most ``rows`` rows."""
    df.write.mode("overwrite").option("header", "true").option("maxRecordsPerFile", rows).csv(path)


def write_train_test(df: DataFrame, path: str, label: str, split: str = "split") -> None:
    """Features and target of each split below ``path/split=train`` and ``path/split=test``.

    Keeping the target in the row replaces four files that only match by position.
    """
    columns = [c for c in df.columns if c not in (label, split)]
    df.select(*[f"`{c}`" for c in columns], label, split).write.mode("overwrite").partitionBy(split).parquet(path)


def write_audit(tables: Mapping[str, DataFrame], path: str | None) -> None:
    """Intermediate tables for inspection, one directory each; nothing happens without a path."""
    if path:
        for name, df in tables.items():
            write_table(df, f"{path.rstrip('/')}/{name}")


def largest_file_rows(df: DataFrame) -> DataFrame:
    """Rows per file of a table just read, to check a split."""
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))
