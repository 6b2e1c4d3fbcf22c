import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cindergrid.session import cut_lineage, shared_folder
from cindergrid.sources import readers, sinks
from helpers import rows


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_directory_merges_by_name_and_skips_bad_files(spark, tmp_path):
    write(tmp_path / "a.csv", "a,b\n1,x\n2,y\n")
    write(tmp_path / "b.csv", "b,a,extra\nz,3,9\n")
    write(tmp_path / "c.txt", "a,b\n9,9\n")
    write(tmp_path / "sub" / "d.csv", "a\n4\n")
    got = rows(readers.read_directory(spark, str(tmp_path), "a int, b string"), "a")
    assert got == [(1, "x"), (2, "y"), (3, "z")]
    deep = rows(readers.read_directory(spark, str(tmp_path), "a int, b string", recursive=True), "a")
    assert deep[-1] == (4, None)
    with pytest.raises(FileNotFoundError):
        readers.read_directory(spark, str(tmp_path / "sub2"), "a int") if (tmp_path / "sub2").mkdir() is None else None


def test_months(spark, tmp_path):
    for key in ("200601", "200602", "200701"):
        write(tmp_path / f"raw_{key}.csv", f"date,latitude,longitude,2t\n{key[:4]}-{key[4:]}-01,49.0,-120.0,280.5\n")
    out = readers.read_months(spark, str(tmp_path), [2006], range(1, 13))
    assert sorted(str(r.date) for r in out.collect()) == ["2006-01-01", "2006-02-01"]
    assert set(readers.RAW_DOUBLES) <= set(out.columns) and out.first()["2t"] == 280.5 and out.first()["tp"] is None
    assert readers.read_months(spark, str(tmp_path), [2007], [1]).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.read_months(spark, str(tmp_path), [1999])


def test_strikes_with_two_headers_and_cache(spark, tmp_path):
    write(tmp_path / "in" / "y1" / "a.csv", "fid,date_group,local_striketime,gmt_striketime,mst_striketime,latitude,longitude,strength,multiplicity\n"
          "1,2023/10/01 00:00:00,a,b,c,55.1,-115.2,-12,1\n")
    write(tmp_path / "in" / "y2" / "b.csv", "date_group,local_striketime,gmt_striketime,mst_striketime,latitude,longitude,strength,multiplicity\n"
          "2023-11-02,a,b,c,55.3,-115.4,20,2\n")
    cache = str(tmp_path / "cache")
    first = readers.read_strikes(spark, str(tmp_path / "in"), cache)
    assert rows(first.select("fid", "date", "strength"), "date") == [(1, dt.date(2023, 10, 1), -12), (None, dt.date(2023, 11, 2), 20)]
    write(tmp_path / "in" / "y3" / "c.csv", "date_group,latitude,longitude,strength,multiplicity\n2023-12-02,55.3,-115.4,20,2\n")
    assert readers.read_strikes(spark, str(tmp_path / "in"), cache).count() == 2
    assert readers.read_strikes(spark, str(tmp_path / "in")).count() == 3


def test_half_written_cache_is_built_again(spark, tmp_path):
    cache = tmp_path / "cache"
    spark.range(3).write.parquet(str(cache))
    assert readers.reuse_or_build(spark, str(cache), lambda: spark.range(5)).count() == 3
    (cache / "_SUCCESS").unlink()
    assert readers.reuse_or_build(spark, str(cache), lambda: spark.range(5)).count() == 5


def test_headers_take_as_many_jobs_for_many_files_as_for_few(spark, tmp_path):
    def jobs(name, n):
        for i in range(n):
            write(tmp_path / name / f"{i} x.csv", "a,b\n1,x\n" if i % 2 else '\ufeffb,"a"\ny,2\n')
        write(tmp_path / name / "none.csv", "")
        spark.sparkContext.setJobGroup(name, name)
        out = readers.read_directory(spark, str(tmp_path / name), "a int, b string")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert sorted(set(rows(out))) == [(1, "x"), (2, "y")] and out.count() == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    assert jobs("few", 4) == jobs("many", 24)


def test_absent_months_can_be_an_error(spark, tmp_path):
    write(tmp_path / "raw_200601.csv", "date,2t\n2006-01-01,280.5\n")
    assert readers.read_months(spark, str(tmp_path), [2006], [1, 2]).count() == 1
    with pytest.raises(FileNotFoundError, match="200602"):
        readers.read_months(spark, str(tmp_path), [2006], [1, 2], missing="raise")


def test_incidents(spark, tmp_path):
    write(tmp_path / "i.csv", "name,fire_start_date,fire_location_latitude,fire_location_longitude\n"
          "a,2023-05-01 10:00:00,55.0,-115.0\nb,never,55.0,-115.0\nc,2023-05-02,,-115.0\n")
    assert rows(readers.read_incidents(spark, str(tmp_path / "i.csv"))) == [(dt.date(2023, 5, 1), 55.0, -115.0)]
    with pytest.raises(ValueError, match="fire_location_longitude"):
        readers.incidents(spark.createDataFrame([("2023-05-01", 1.0)], "fire_start_date string, fire_location_latitude double"))


def test_points_tracks_and_parameters(spark, tmp_path):
    write(tmp_path / "p.csv", "category,lat,lon\nrailway,55.0,-115.0\nhighway,,-115.0\n")
    assert rows(readers.read_points(spark, str(tmp_path / "p.csv"))) == [("railway", 55.0, -115.0)]
    df = spark.createDataFrame([(7, [1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0])],
                               "f int, time array<double>, latitude array<double>, longitude array<double>, elevation array<double>")
    assert rows(readers.track_points(df), "Time") == [(7, 1.0, 3.0, 5.0, 7.0), (7, 2.0, 4.0, 6.0, 8.0)]
    (tmp_path / "run.json").write_text(json.dumps({"default": {"batch_size": 30, "test_range": [2024]}, "other": {"batch_size": 1}}, indent=1))
    assert readers.run_parameters(spark, str(tmp_path / "run.json"), "default") == {"batch_size": 30, "test_range": [2024]}


def test_periods_are_pruned(spark, tmp_path):
    df = spark.range(100).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                                 (F.col("id") % 3).alias("cell_r"))
    sinks.write_periods(df, str(tmp_path / "t"))
    back = readers.read_period(spark, str(tmp_path / "t"), "202402")
    assert back.count() == 29
    assert "PartitionFilters: [" in back._jdf.queryExecution().toString() and len(back.inputFiles()) < 100
    assert sorted(p.name for p in (tmp_path / "t").glob("period=*")) == [f"period=20240{m}" for m in (1, 2, 3, 4)]


def test_split_files_and_audit(spark, tmp_path):
    df = spark.range(95)
    sinks.write_split_files(df.coalesce(1), str(tmp_path / "s"), 20)
    files = list((tmp_path / "s").glob("*.csv"))
    assert len(files) == 5 and spark.read.csv(str(tmp_path / "s"), header=True).count() == 95
    sinks.write_audit({"a": df}, str(tmp_path / "audit"))
    sinks.write_audit({"a": df}, None)
    assert spark.read.csv(str(tmp_path / "audit" / "a"), header=True).count() == 95


def test_train_test(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("y"), F.when(F.col("id") < 8, "train").otherwise("test").alias("split"))
    sinks.write_train_test(df, str(tmp_path / "tt"), "y")
    assert spark.read.parquet(str(tmp_path / "tt" / "split=test")).count() == 2


def test_shared_folder_follows_the_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark).startswith(base) and shared_folder(spark) != shared_folder(spark)
    before = len(list(Path(base).iterdir()))
    assert cut_lineage(spark.range(5)).count() == 5
    assert len(list(Path(base).iterdir())) == before + 1


def month_rows(spark, *months, price=1.0):
    return spark.createDataFrame([(f"2020-{m:02d}-{d:02d}", price) for m in months for d in (1, 15)], "date string, price double").withColumn("date", F.to_date("date"))


def stamps(folder):
    return {str(p.relative_to(folder)): (p.stat().st_mtime_ns, p.read_bytes()) for p in folder.rglob("*") if p.suffix in (".csv", ".parquet") and not p.name.startswith((".", "_"))}


@pytest.mark.parametrize("write, month", [(sinks.write_months, "raw_{}.csv"), (sinks.write_periods, "period={}/")])
def test_one_month_is_replaced_alone(spark, tmp_path, write, month):
    write(month_rows(spark, 1, 2, 3), str(tmp_path))
    before = stamps(tmp_path)
    write(month_rows(spark, 2, 4, price=5.0), str(tmp_path))
    after = stamps(tmp_path)
    for m, same in (("202001", True), ("202002", False), ("202003", True)):
        old, new = ({k: v for k, v in s.items() if k.startswith(month.format(m))} for s in (before, after))
        assert old and new and (old == new) is same
    assert any(k.startswith(month.format("202004")) for k in after)


@pytest.mark.parametrize("write", [sinks.write_months, sinks.write_periods])
def test_a_failed_rewrite_leaves_all_months(spark, tmp_path, write):
    write(month_rows(spark, 1, 2), str(tmp_path))
    before = stamps(tmp_path)
    bad = month_rows(spark, 2, 3).withColumn("price", F.when(F.col("date") == "2020-03-15", F.raise_error(F.lit("lost")).cast("double")).otherwise(9.0))
    with pytest.raises(Exception, match="lost"):
        write(bad, str(tmp_path))
    assert stamps(tmp_path) == before


def test_all_periods_are_replaced_when_asked(spark, tmp_path):
    sinks.write_periods(month_rows(spark, 1, 2), str(tmp_path / "t"))
    sinks.write_periods(month_rows(spark, 2), str(tmp_path / "t"), replace="all")
    assert {r.period for r in spark.read.parquet(str(tmp_path / "t")).select("period").distinct().collect()} == {202002}
    with pytest.raises(ValueError, match="replace"):
        sinks.write_periods(month_rows(spark, 1), str(tmp_path / "t"), replace="some")


def test_monthly_files_are_read_back(spark, tmp_path):
    sinks.write_months(month_rows(spark, 1, 3), str(tmp_path))
    got = readers.read_months(spark, str(tmp_path), [2020], schema="date date, price double")
    assert sorted((str(r.date), r.price) for r in got.collect()) == [("2020-01-01", 1.0), ("2020-01-15", 1.0), ("2020-03-01", 1.0), ("2020-03-15", 1.0)]
    with pytest.raises(FileNotFoundError):
        readers.read_months(spark, str(tmp_path), [2020], schema="date date, price double", missing="raise")
