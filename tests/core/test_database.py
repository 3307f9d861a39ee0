"""Scans of databases by key ranges, with filters that the database applies."""

import sqlite3

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, Not, StringContains
from pyspark.sql.types import StructType

from prospect.sources import database


@pytest.fixture(scope="module")
def one(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "one.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "my table" (id INTEGER, "a b" TEXT, v REAL, raw BLOB)')
        db.executemany('INSERT INTO "my table" VALUES (?, ?, ?, ?)', [(i * i if i % 10 else None, f"t{i % 7}" if i % 5 else None, i / 4, bytes([i % 256])) for i in range(300)])
        db.execute("CREATE TABLE other (id INTEGER)")
    return path


def test_every_row_in_ranges_of_keys(spark, one):
    df = database.scan(spark, one, "my table", "id", partitions=5)
    assert df.columns == ["id", "a b", "v", "raw"] and database.tables(one) == ["my table", "other"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(i * i if i % 10 else None, f"t{i % 7}" if i % 5 else None, i / 4, bytes([i % 256])) for i in range(300)], key=str)
    assert df.rdd.getNumPartitions() == 6  # five ranges and the rows without a key
    assert database.scan(spark, one, "other", "id").collect() == []


def test_columns_and_filters_reach_the_database(spark, one):
    df = database.scan(spark, one, "my table", "id", ["id", "v"]).where("v > 10 and v <= 20 and id is not null and id in (1849, 2209, 3481, 9)")
    assert sorted(map(tuple, df.collect())) == [(1849, 10.75), (2209, 11.75), (3481, 14.75)]
    reader = database.Tables({"path": one, "table": "my table", "key": "id", "columns": "id,v"}).reader(database.Tables({"path": one, "table": "my table", "key": "id", "columns": "id,v"}).schema())
    left = list(reader.pushFilters([GreaterThan(("v",), 70.0), Not(IsNull(("id",))), StringContains(("a b",), "t")]))
    assert [type(f) for f in left] == [StringContains]
    parts = reader.partitions()
    assert min(p.start for p in parts) == 281 * 281 and all(p.start is not None for p in parts)
    sql, values = reader.select(parts[0])
    assert sql.startswith('SELECT "id", "v" FROM "my table" WHERE') and 70.0 in values


def test_filters_that_mean_something_else_stay(spark, one):
    known = {"v", "a b"}
    assert database.condition(EqualTo(("v",), float("nan")), known) is None and database.condition(EqualTo(("x", "y"), 1), known) is None
    assert database.condition(In(("v",), (1, None)), known) is None and database.condition(Not(In(("a b",), ("x",))), known) == ('NOT ("a b" IN (?))', ["x"])
    df = database.scan(spark, one, "my table", "id")
    assert df.where("`a b` not in ('t1', 't2')").count() == sum(1 for i in range(300) if i % 5 and i % 7 not in (1, 2))
    assert df.where("`a b` <=> null").count() == 60 and df.where("`a b` like '%3'").count() == sum(1 for i in range(300) if i % 5 and i % 7 == 3)


def test_a_folder_of_databases(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "concat('n', id) as name", "id / 8 as x").repartition(3)
    folder = "file://" + str(tmp_path / "parts")
    assert database.export(df, folder, "t", "id") == 1000 and len(database.files(folder)) == 3
    found = database.scan(spark, folder, "t", "id", partitions=2)
    assert isinstance(found.schema, StructType) and sorted(map(tuple, found.collect())) == sorted(map(tuple, df.collect()))
    assert found.where("id between 500 and 509").count() == 10
    assert database.export(df.limit(0), folder + "-none", "t", "id") == 0
