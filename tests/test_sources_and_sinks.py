import json
import os

import pytest
from pyspark.sql import functions as F

from tierloom.sources import films, pages

SCHEMA = "film string, level double, page int, pos int, review_id long, text string, tags array<string>"


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(f, lv, p, i, p * 10 + i, f"tÃxt {i}" if i else None, ["a", None]) for f in ("one", "two a/b", "drei") for lv in (0.5, 3.0, 5.0) for p in range(1, 9) for i in range(3)]
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.partitionBy("film", "level").parquet(path)
    pages.register(spark)
    return path, rows


def read(spark, path, **options):
    return spark.read.format("review_pages").options(**options).load(path)


def test_pages_come_back(spark, stored):
    path, rows = stored
    found = read(spark, path).select("film", "level", "page", "pos", "review_id", "text", "tags").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, rows))
    assert read(spark, "file://" + path, maxPages=2).count() == 3 * 3 * 2 * 3


@pytest.mark.parametrize(
    ("condition", "keep", "partitions"),
    [
        ("film = 'one' AND level >= 3 AND page <= 2", lambda r: r[0] == "one" and r[1] >= 3 and r[2] <= 2, 2), ("film IN ('drei', 'two a/b', 'zz') AND page > 6", lambda r: r[0] != "one" and r[2] > 6, 6),
        ("page = 3 AND pos < 2 AND text IS NOT NULL", lambda r: r[2] == 3 and r[3] < 2 and r[5] is not None, 9), ("film <> 'one'", lambda r: r[0] != "one", 9), ("film = 'nobody'", lambda r: False, 0),
        ("level = 5.0 OR page = 1", lambda r: r[1] == 5.0 or r[2] == 1, 9), ("film = 'one' AND film = 'drei'", lambda r: False, 0),
    ],
)
def test_conditions_reach_the_scan(spark, stored, condition, keep, partitions):
    path, rows = stored
    found = read(spark, path).filter(condition)
    assert sorted((r.film, r.level, r.page, r.pos) for r in found.collect()) == sorted(r[:4] for r in rows if keep(r))
    scan = read(spark, path).filter(condition).select("film").rdd.getNumPartitions()
    assert scan == partitions or partitions == 0


def test_spark_keeps_no_filter_that_the_scan_takes(spark, stored):
    plan = lambda condition: read(spark, stored[0]).filter(condition)._jdf.queryExecution().executedPlan().toString()
    taken = plan("film = 'one' AND page <= 6")
    assert "BatchScan review_pages" in taken and "Filter" not in taken.replace("RuntimeFilters", "")
    assert "Filter (pos" in plan("film = 'one' AND pos < 2").replace("(isnotnull(pos#", "(pos").replace("Filter ((", "Filter (")  # a column that the scan does not know


def test_pages_without_a_film(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(None, 1.0, 1, 0), ("a", None, 1, 0), ("a", 1.0, None, 0), ("a", 1.0, 2, 0)], "film string, level double, page int, pos int").write.partitionBy("film", "level").parquet(path)
    pages.register(spark)
    assert read(spark, path).count() == 4
    count = lambda condition: read(spark, path).filter(condition).count()
    assert [count(c) for c in ("film = 'a'", "film IS NULL", "level < 2", "page > 0", "page IS NOT NULL", "film IN ('a') AND level IS NOT NULL")] == [3, 1, 3, 3, 3, 2]


def documents(spark):
    rows = [("a-film", "é \"x\"", [("neg", 1)], None), ("two/ö", None, [], 2.5), ("empty", "", None, None)]
    return spark.createDataFrame(rows, "film string, title string, buckets array<struct<bucket:string,n:int>>, share double")


def test_one_file_a_film(spark, tmp_path):
    path = str(tmp_path / "films")
    films.write_films(documents(spark).repartition(3), path)
    assert sorted(os.listdir(path)) == ["a-film.json", "empty.json", "two%2F%C3%B6.json"]
    text = open(f"{path}/a-film.json", encoding="utf-8").read()
    assert text == json.dumps({"film": "a-film", "title": 'é "x"', "buckets": [{"bucket": "neg", "n": 1}], "share": None}, ensure_ascii=False, indent=2)
    back = films.read_films(spark, path, documents(spark).schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, documents(spark).collect()))
    assert {r.version for r in films.read_films(spark, path, "film string, version string", "2").collect()} == {"2"}
    # another run: its film is replaced, the others stay as they are
    before = os.stat(f"{path}/empty.json").st_mtime_ns
    films.write_films(spark.createDataFrame([("a-film", "new")], "film string, title string"), path)
    assert json.load(open(f"{path}/a-film.json")) == {"film": "a-film", "title": "new"} and os.stat(f"{path}/empty.json").st_mtime_ns == before
    assert len(os.listdir(path)) == 3


@pytest.mark.parametrize("bad", ["twice", "failing", "nameless"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    path = str(tmp_path / "films")
    films.write_films(documents(spark), path)
    before = {n: open(f"{path}/{n}").read() for n in os.listdir(path)}
    rows = spark.createDataFrame([("a-film", "changed"), ("next", "x"), ("a-film" if bad == "twice" else "last", "y")], "film string, title string").repartition(3)
    if bad == "failing":
        rows = rows.withColumn("title", F.expr("IF(film = 'last', CAST(raise_error('lost') AS STRING), title)"))
    if bad == "nameless":
        rows = rows.withColumn("film", F.when(F.col("film") != "last", F.col("film")))
    with pytest.raises(Exception, match="two documents|lost|without a film"):
        films.write_films(rows, path)
    assert {n: open(f"{path}/{n}").read() for n in os.listdir(path)} == before
