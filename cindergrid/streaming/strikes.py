"""Strikes per cell and day from a stream. An extension: the batch operator on streaming input."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from cindergrid.operators.grid import CELL, CELL_DAY, Grid


def strike_stream(strikes: DataFrame, grid: Grid, late: str = "1 day", time: str = "ts") -> DataFrame:
    """Running counts and sums of each struck cell-day; strikes later than the watermark are dropped.

    State is one small row per open cell-day. Days without strikes do not appear.
    """
    located = grid.locate(strikes.withWatermark(time, late))
    return (located.groupBy(F.window(time, "1 day"), *CELL)
            .agg(F.count("*").alias("lightning_count"),
                 F.sum(F.abs("strength").cast("double")).alias("absv_strength_sum"),
                 F.sum(F.col("multiplicity").cast("bigint")).alias("multiplicity_sum"))
            .withColumn("date", F.to_date("window.start"))
            .select(*CELL_DAY, "lightning_count", "absv_strength_sum", "multiplicity_sum"))


def write_closed_days(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the cell-days the watermark has closed to a Parquet table, for the data available now.

    Run it again later with the same checkpoint to continue; each cell-day is written exactly once.
    """
    return (counts.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
