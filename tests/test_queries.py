"""Every kernel query against its SQL, sources and streams."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.plans import kernels
from quillon.sources import tables
from quillon.streaming import kernels as streaming


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def values(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(repr(r[k]) for k in order) for r in rows])


@pytest.mark.parametrize("name", list(kernels.queries()))
def test_query(spark, duck, sf_dir, name):
    got = kernels.queries()[name](spark, sf_dir).toArrow()
    want = duck.execute(kernels.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.column_names)
    assert values(got.column_names, [tuple(r.values()) for r in got.to_pylist()]) == values(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 6
    assert sum(r.n for r in rows) == tables.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    for kind in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / kind)
        tables.write(df, path, kind)
        assert sorted(map(tuple, tables.read(spark, path, kind, "n int, s string").collect())) == [(1, "a"), (2, "b")]
    tables.write(df, str(tmp_path / "by"), by=["s"])
    assert tables.read(spark, str(tmp_path / "by")).where("s = 'a'").count() == 1
    with pytest.raises(ValueError):
        tables.read(spark, "x", "csv")
    with pytest.raises(ValueError):
        tables.write(df, "x", "xls")


def test_streams(spark, sf_dir, tmp_path):
    events = tables.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = streaming.stream(spark, str(tmp_path / "in"), events.schema)
    up = streaming.with_kernels(source, loud=T.upper(F.col("event_type")))
    run = up.select("event_id", "loud").writeStream.format("memory").queryName("loud").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("loud").count() == events.count()
    counted = streaming.crosstab_windows(source.withColumn("odd", F.col("user_id") % 2), "ts", "event_type", "odd", "1 day", "10 days")
    run = counted.writeStream.format("memory").outputMode("complete").queryName("counted").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == events.count()
