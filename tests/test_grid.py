import datetime as dt

import pytest
from pyspark.sql import functions as F

from cindergrid import Grid
from cindergrid.operators import grid as g, joins
from cindergrid.operators.aggregates import category_counts, infrastructure, strikes_by_cellday
from helpers import rows

AREA = Grid.over((49, 60), (-120, -110), 0.30)
SMALL = Grid.over((0, 1), (0, 1), 0.2)
DAY = dt.date(2024, 7, 1)


def test_study_area_has_1258_cells(spark):
    assert (AREA.n_rows, AREA.n_cols, AREA.size) == (37, 34, 1258)
    cells = AREA.cells(spark)
    assert cells.count() == 1258
    top = cells.agg(F.max("latitude"), F.min("latitude"), F.max("longitude"), F.min("longitude")).first()
    assert tuple(top) == (59.8, 49.0, -110.1, -120.0)


def test_every_corner_falls_into_its_own_cell(spark):
    cells = AREA.cells(spark).withColumnsRenamed({"cell_r": "r", "cell_c": "c"})
    wrong = AREA.locate(cells).filter("r <> cell_r or c <> cell_c")
    assert AREA.locate(cells).count() == 1258 and wrong.count() == 0


def test_box_edges_are_half_open(spark):
    points = spark.createDataFrame([(0.0, 0.0), (1.0, 0.5), (0.5, 1.0), (-0.0001, 0.5), (0.9999, 0.9999), (0.2, 0.2)],
                                   "latitude double, longitude double")
    assert rows(SMALL.locate(points).select("cell_r", "cell_c"), "cell_r") == [(0, 0), (1, 1), (4, 4)]


def test_calendar_unions_and_clips(spark):
    fires = spark.createDataFrame([("2024-01-02",), ("2024-01-05",), ("2023-12-31",), ("2024-02-01",), (None,)], "date string")
    days = [r[0].isoformat() for r in rows(g.calendar(spark, "2024-01-01", "2024-01-10", 4, fires), "date")]
    assert days == ["2024-01-01", "2024-01-02", "2024-01-05", "2024-01-09"]


def test_smoke_input_five_days_all_cells(spark):
    dates = g.calendar(spark, "2019-01-01", "2019-01-05")
    strikes = spark.createDataFrame(
        [("2019-01-02", 49.0, -120.0, -7, 2), ("2019-01-02", 49.1, -119.9, 5, 1), ("2019-01-02", 48.9, -120.0, 9, 9),
         ("2019-02-02", 49.0, -120.0, 9, 9)], "date string, latitude double, longitude double, strength int, multiplicity int")
    out = strikes_by_cellday(strikes, dates, AREA)
    assert out.count() == 5 * 1258
    hit = out.filter("lightning_count > 0")
    assert rows(hit) == [(dt.date(2019, 1, 2), 0, 0, 2, 12.0, 3)]
    assert set(out.columns) == {*g.CELL_DAY, "lightning_count", "absv_strength_sum", "multiplicity_sum"}


def test_counts_per_category(spark):
    points = spark.createDataFrame([("railway", 0.1, 0.1), ("railway", 0.1, 0.15), ("highway", 0.9, 0.9), ("other", 0.1, 0.1)],
                                   "category string, latitude double, longitude double")
    got = {(r.cell_r, r.cell_c): (r.railway_count, r.highway_count) for r in category_counts(points, SMALL).collect()}
    assert got == {(0, 0): (2, 0), (4, 4): (0, 1)}
    dates = spark.createDataFrame([(DAY,)], "date date")
    all_cells = infrastructure(g.scaffold(dates, SMALL), points, SMALL)
    assert all_cells.count() == 25 and all_cells.agg(F.sum("railway_count")).first()[0] == 2


def test_label_tolerance_is_inclusive(spark):
    cells = g.scaffold(spark.createDataFrame([(DAY,)], "date date"), SMALL)
    fires = spark.createDataFrame([(DAY, 0.4, 0.4), (DAY, 0.4, 0.4), (dt.date(2024, 7, 2), 0.0, 0.0)],
                                  "date date, latitude double, longitude double")
    def labelled(tol):
        out = joins.label_fires(cells, fires, SMALL, tol, tol)
        assert out.count() == 25
        return [(r.cell_r, r.cell_c) for r in out.filter("is_fire_day = 1").orderBy("cell_r", "cell_c").collect()]
    assert labelled(0.0) == [(2, 2)]
    assert labelled(0.2) == [(r, c) for r in (1, 2, 3) for c in (1, 2, 3)]
    assert labelled(0.1999) == [(2, 2)]
    plan = joins.label_fires(cells, fires, SMALL, 0.2, 0.2)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_null_keys_stay_and_are_never_flagged(spark):
    cells = spark.createDataFrame([(None, 0, 0), (DAY, None, 0), (DAY, 0, 0)], "date date, cell_r bigint, cell_c bigint")
    fires = spark.createDataFrame([(DAY, 0.0, 0.0), (None, 0.0, 0.0), (DAY, None, 0.0)],
                                  "date date, latitude double, longitude double")
    out = joins.label_fires(cells, fires, SMALL, 0.0, 0.0)
    assert sorted((r.date is None, r.cell_r is None, r.is_fire_day) for r in out.collect()) == [
        (False, False, 1), (False, True, 0), (True, False, 0)]


def test_empty_sources(spark):
    dates = spark.createDataFrame([(DAY,)], "date date")
    none = spark.createDataFrame([], "date string, latitude double, longitude double, strength int, multiplicity int")
    out = strikes_by_cellday(none, dates, SMALL)
    assert out.count() == 25 and out.filter("lightning_count <> 0 or absv_strength_sum <> 0").count() == 0
    points = spark.createDataFrame([], "category string, latitude double, longitude double")
    assert infrastructure(g.scaffold(dates, SMALL), points, SMALL).filter("railway_count = 0").count() == 25


@pytest.mark.parametrize("tolerance,expected", [(0, 1), (1, 9), (2, 25), (9, 25)])
def test_dilation_of_one_cell(spark, tolerance, expected):
    cells = g.scaffold(spark.createDataFrame([(DAY,)], "date date"), SMALL).withColumn(
        "is_fire_day", ((F.col("cell_r") == 2) & (F.col("cell_c") == 2)).cast("int"))
    out = joins.dilate(cells, tolerance, SMALL)
    assert out.count() == 25 and out.agg(F.sum("fire_region")).first()[0] == expected


def test_images_keep_positions_and_gaps(spark):
    grid = Grid.over((0, 0.4), (0, 0.6), 0.2)
    cells = g.scaffold(spark.createDataFrame([(DAY,), (dt.date(2024, 7, 2),)], "date date"), grid).withColumn(
        "v", (F.col("cell_r") * 10 + F.col("cell_c")).cast("double"))
    holed = cells.filter(~((F.col("date") == F.lit(DAY)) & (F.col("cell_r") == 1)))
    images = {r.date: r for r in g.day_images(holed, ["v"], grid).collect()}
    assert images[DAY].image == [[0, 1, 2], [None, None, None]] and not images[DAY].complete
    second = images[dt.date(2024, 7, 2)]
    assert second.image == [[0, 1, 2], [10, 11, 12]] and second.complete
    assert g.day_images(holed, ["v"], grid, drop_last=True).count() == 1
    back = g.image_rows(g.day_images(cells, ["v"], grid), grid, "v")
    assert back.filter("v <> cell_r * 10 + cell_c").count() == 0 and back.count() == 12
    assert back.filter("abs(latitude - cell_r * 0.2) > 1e-9 or abs(longitude - cell_c * 0.2) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        g.day_images(cells, ["v"], grid, max_cells=5)


def test_assemble_skips_failing_sources(spark):
    dates = spark.createDataFrame([(DAY,)], "date date")

    def broken(*_):
        raise RuntimeError("down")

    def one(_spark, days, grid):
        return g.scaffold(days, grid).filter("cell_r < 2").withColumn("a", F.lit(1))

    def other(_spark, days, grid):
        return g.scaffold(days, grid).filter("cell_r > 0").withColumn("b", F.lit(2))

    out = joins.assemble(spark, dates, SMALL, [("x", broken), ("none", lambda *_: None), ("one", one), ("other", other)], on_error="skip")
    assert out.count() == 25 and out.filter("a is null").count() == 15 and out.filter("b is null").count() == 5
    with pytest.raises(ValueError, match="several sources"):
        joins.outer_fold([one(spark, dates, SMALL), one(spark, dates, SMALL)])
    twice = one(spark, dates, SMALL).unionByName(one(spark, dates, SMALL))
    with pytest.raises(Exception, match="several rows"):
        joins.outer_fold([twice, other(spark, dates, SMALL)]).collect()
    with pytest.raises(ValueError, match="down"):
        joins.assemble(spark, dates, SMALL, [("x", broken)], on_error="skip")
    with pytest.raises(RuntimeError, match="down"):
        joins.assemble(spark, dates, SMALL, [("one", one), ("x", broken)])
    with pytest.raises(ValueError, match="none gave no"):
        joins.assemble(spark, dates, SMALL, [("one", one), ("none", lambda *_: None)])


def test_monthly_join_checks_columns(spark):
    a = spark.createDataFrame([(DAY, 0, 0, 1)], "date date, cell_r bigint, cell_c bigint, lightning_count int")
    with pytest.raises(ValueError):
        joins.monthly_join(a, a.select("cell_r", "date", "cell_c"))
    joined, report = joins.monthly_join(a, a.withColumn("sp", F.lit(1.0)))
    assert joined.columns == ["period", "date", "cell_r", "cell_c", "lightning_count", "sp"]
    assert rows(report) == [("202407", 1, 1, "merged")]
