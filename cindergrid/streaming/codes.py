"""Fire-weather codes continued day by day from a stream: one small state per cell instead of a recomputed year.

The state of a cell is the last day seen, the three codes (none off season), and the last wet day. Cells are kept in buckets by a
hash: calls to the state store and frames are paid once a bucket and batch, not once a cell. A micro-batch
may hold any number of days of a cell; they are taken in order. A day not later than the last one seen is left out, because its
codes would need those of the days after it to be taken back. Codes restart with the year, by a timer where no day of the
new year has come yet, as in :func:`~cindergrid.functions.fireweather.fire_weather`.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import DoubleType, StructType

from cindergrid.functions import fireweather as fw
from cindergrid.operators.grid import CELL

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: One entry per cell of a bucket; days are numbers, key columns are text.
STATE = "date array<int>, f array<double>, p array<double>, d array<double>, wet array<int>"
BUCKETS = 1024
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fine(f: float, x, moisture: float = fw.MOISTURE) -> float:
    """Fine fuel moisture code after a day of terms ``x``, from the code before it."""
    m = moisture * (101 - f) / (59.5 + f)
    m = min(250.0, m + x.rain * math.exp(-100 / (251 - m)) + (0.0015 * (m - 150) ** 2 * x.root if m > 150 else 0.0))
    if m > x.ed:
        m = x.ed + (m - x.ed) * x.drying
    elif m < x.ew:
        m = x.ew - (x.ew - m) * x.wetting
    return 59.5 * (250 - m) / (moisture + m)


def duff(p: float, x) -> float:
    """Duff moisture code after a day."""
    if x.duff_rain > 0:
        log = math.log(max(p, 1e-9))
        b = 100 / (0.5 + 0.3 * p) if p <= 33 else 14 - 1.3 * log if p <= 65 else 6.2 * log - 17.2
        content = 20 + math.exp(5.6348 - p / 43.43) + 1000 * x.duff_rain / (48.77 + b * x.duff_rain)
        p = max(0.0, 244.72 - 43.43 * math.log(content - 20))
    return p + x.duff_dry


def deep(d: float, x) -> float:
    """Drought code after a day."""
    if x.deep_rain > 0:
        d = max(0.0, 400 * math.log(800 / (800 * math.exp(-d / 400) + 3.937 * x.deep_rain)))
    return d + x.deep_dry


def _text(values) -> tuple:
    return tuple(None if v is None else str(v) for v in values)


class Codes(StatefulProcessor):
    def __init__(self, by: Sequence[str], starts, dry_start: bool, dry_factors):
        self.by, self.starts, self.dry_start, self.dry_factors = list(by), starts, dry_start, dry_factors
        self.keys = [f"cell_key{i}" for i in range(len(self.by))]

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("codes", f"{', '.join(f'{k} array<string>' for k in self.keys)}, {STATE}")

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        """Last day, codes and last wet day by cell."""
        if not self.state.exists():
            return {}
        columns = self.state.get()
        n = len(self.keys)
        return {_text(r[:n]): tuple(r[n:]) for r in zip(*columns)}

    def _store(self, cells: dict) -> None:
        if cells:
            self.state.update(tuple(list(c) for c in zip(*((*k, *v) for k, v in cells.items()))))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        cells = self._load()
        for r in initialState.itertuples(index=False):
            cells[_text(getattr(r, k) for k in self.keys)] = (
                r.date.toordinal(), *(None if pd.isna(v) else float(v) for v in (r.f, r.p, r.d)), None if pd.isna(r.wet) else r.wet.toordinal())
        self._store(cells)
        self._restart_after({d.year for d in initialState["date"]})

    def _restart_after(self, years: set[int]) -> None:
        for year in years:
            turn = dt.datetime(year + 1, 1, 1, tzinfo=dt.timezone.utc)
            self.handle.registerTimer(int(turn.timestamp() * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows)).sort_values("date", kind="stable")
        cells, out, years = self._load(), [], set()
        for cell, x in zip(zip(*(days[k] for k in self.keys)), days.itertuples(index=False)):
            cell, day = _text(cell), x.date.toordinal()
            last, f, p, d, wet = cells.get(cell, (None,) * 5)
            if last is not None and day <= last:
                continue
            if last is None or x.date.year != dt.date.fromordinal(last).year:
                f = None
                years.add(x.date.year)
            if x.on == 0:
                f = p = d = None
            elif x.on == 1:
                if f is None:
                    since = day - wet if self.dry_start and wet is not None else None
                    f = self.starts[0]
                    p, d = self.starts[1:] if since is None else (since * a for a in self.dry_factors)
                f, p, d = fine(f, x), duff(p, x), deep(d, x)
            # A day of unknown weather has no codes and leaves the state as it was.
            out.append((*cell, x.date, x.wind, *((f, p, d) if x.on == 1 else (None,) * 3)))
            cells[cell] = (day, *((float(f), float(p), float(d)) if f is not None else (None,) * 3), day if x.soaked else wet)
        self._store(cells)
        self._restart_after(years)
        yield pd.DataFrame(out, columns=[*self.keys, "date", "wind", "f", "p", "d"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        year = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, dt.timezone.utc).year
        self._store({k: (last, None, None, None, wet) if dt.date.fromordinal(last).year < year else (last, *codes, wet)
                     for k, (last, *codes, wet) in self._load().items()})
        yield pd.DataFrame(columns=[*self.keys, "date", "wind", "f", "p", "d"])


def _active(season: str | None) -> Column:
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in fw.INPUTS])
    return F.when(F.coalesce(F.col(season), F.lit(0)) == 0, 0).when(known, 1) if season else F.when(known, 1)


def last_codes(done: DataFrame, by: Sequence[str] = tuple(CELL), wet: float = fw.WET_DAY) -> DataFrame:
    """The state after the days of ``done``, rows of the batch fold with their weather: where the stream goes on.

    One row per cell, from one aggregation. A cell whose last days had no weather keeps the codes before them.
    """
    six = ["fine_fuel_moisture_code", "duff_moisture_code", "drought_code"]
    unknown = reduce(Column.__or__, [F.col(c).isNull() for c in fw.INPUTS])
    rows = done.withColumn("_codes", F.struct(*[F.col(c).alias(n) for c, n in zip(six, "fpd")]))
    state = rows.groupBy(*by).agg(F.max("date").alias("date"), F.max(F.when(F.col("rain_mm") > wet, F.col("date"))).alias("wet"),
                                  F.max_by("_codes", F.when(~unknown, F.col("date"))).alias("_codes"),
                                  F.max(F.when(~unknown, F.col("date"))).alias("_day"))
    same = F.year("_day") == F.year("date")
    return state.select(*by, "date", *[F.when(same, F.col(f"_codes.{n}")).alias(n) for n in "fpd"], "wet")


def fire_weather_stream(days: DataFrame, by: Sequence[str] = tuple(CELL), season: str | None = None, initial: DataFrame | None = None,
                        starts: tuple[float, float, float] = (fw.FFMC_START, fw.DMC_START, fw.DC_START), dry_start: bool = False,
                        wet: float = fw.WET_DAY, dry_factors: tuple[float, float] = (fw.DMC_DRY_FACTOR, fw.DC_DRY_FACTOR),
                        late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """``by, date`` and the six indices of each new day of the stream ``days`` (columns as for the batch fold).

    ``initial`` is the state to go on from (:func:`last_codes`). Days more than ``late`` behind the newest are dropped.
    Cells are kept in ``buckets`` states, which must stay the same over restarts; some hundred thousand cells a bucket are a few MB.
    """
    terms = fw.day_terms()
    # The day's own terms are computed by built-in functions; only what depends on the day before is left to the state.
    # Key columns travel as text, because pandas would turn whole numbers beside a missing one into floats.
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int").alias("_bucket")
    texts = [F.col(c).cast("string").alias(f"cell_key{i}") for i, c in enumerate(by)]
    rows = days.withColumn("_month", F.month("date")).withColumn("time", F.col("date").cast("timestamp")).withWatermark("time", late).select(
        bucket, *texts, "date", "time", F.col("wind_kmh").alias("wind"), _active(season).alias("on"), (F.coalesce(F.col("rain_mm"), F.lit(0.0)) > wet).alias("soaked"),
        *[v.alias(k) for k, v in terms.items()])
    schema = StructType([rows.schema[c] for c in [*(f"cell_key{i}" for i in range(len(by))), "date"]]).add("wind", DoubleType()).add("f", DoubleType()).add("p", DoubleType()).add("d", DoubleType())
    codes = rows.groupBy("_bucket").transformWithStateInPandas(
        Codes(by, starts, dry_start, dry_factors), outputStructType=schema, outputMode="Append", timeMode="EventTime",
        initialState=initial.select(bucket, *texts, "date", "f", "p", "d", "wet").groupBy("_bucket") if initial is not None else None)
    six = fw.indices(F.col("f"), F.col("p"), F.col("d"), F.col("wind"))
    back = [F.col(f"cell_key{i}").cast(days.schema[c].dataType).alias(c) for i, c in enumerate(by)]
    return codes.select(*back, "date", *[v.alias(k) for k, v in six.items()])


def write_new_days(codes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the codes of all days that have come to a Parquet table; run it again with the same checkpoint to go on."""
    conf, key = codes.sparkSession.conf, PROVIDER
    before = conf.get(key, None)
    conf.set(key, ROCKS)  # the state interface needs this store; a query keeps the settings it was started with
    try:
        return (codes.writeStream.outputMode("append").format("parquet").option("path", path)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        conf.set(key, before) if before else conf.unset(key)
