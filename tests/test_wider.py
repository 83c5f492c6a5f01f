import datetime
import random

import pytest
from pyspark.sql import functions as F

from tierloom.operators import asof, compare, expressions, languages, observed, records, sketches
from tierloom.sources.shared import fresh_path, upsert


def plain_asof(left, right):
    out = []
    for key, at, name in left:
        before = [(t, tie, v) for k, t, tie, v in right if k is not None and k == key and t is not None and at is not None and t <= at]
        out.append((key, at, name, max(before, key=lambda x: (x[0], x[1]))[2] if before else None))
    return out


@pytest.mark.parametrize("per_block", [1_000_000, 40, 7])
def test_asof_backward(spark, per_block):
    """A hot key, ties, null keys and times, repeated rows, values that are null; in one block and in many."""
    rng = random.Random(per_block)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    at = lambda: rng.choice([None] + list(range(60)) * 2)
    left = [(key(), at(), f"l{k % 150}") for k in range(300)]
    right = [(key(), at(), k, rng.choice([None, k, k * 2])) for k in range(250)]
    l = spark.createDataFrame(left, "k string, t int, name string")  # noqa: E741
    r = spark.createDataFrame(right, "k string, t int, tie int, v int")
    found = asof.asof_backward(l, r, ["k"], "t", ["v"], "tie", per_block).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, plain_asof(left, right)))
    assert asof.asof_backward(l, r.limit(0), ["k"], "t", ["v"], "tie", per_block).filter("v IS NOT NULL").count() == 0
    assert asof.asof_backward(l.limit(0), r, ["k"], "t", ["v"], "tie", per_block).count() == 0


def test_asof_takes_timestamps_and_many_keys(spark):
    day = datetime.datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, "x", day + datetime.timedelta(hours=h)) for h in range(5)], "a int, b string, ts timestamp")
    right = spark.createDataFrame([(1, "x", day + datetime.timedelta(hours=1, microseconds=1), "one", 1), (1, "y", day, "other", 2), (1, "x", day + datetime.timedelta(hours=3), "three", 3)], "a int, b string, ts timestamp, v string, tie int")
    found = asof.asof_backward(left, right, ["a", "b"], "ts", ["v"], "tie", 2).orderBy("ts").collect()
    assert [r.v for r in found] == [None, None, "one", "three", "three"]


def test_ten_thousand_expressions(spark):
    """Overlapping, nested and repeated expressions, also in several slices, against looking for each."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdé", k=n))
    wanted = list({word(rng.randint(2, 9)) for _ in range(14000)})[:10000]
    texts = [(k, " ".join(word(rng.randint(1, 12)).title() for _ in range(60))) for k in range(20)] + [(20, None), (21, ""), (22, "AA aa")]
    docs = spark.createDataFrame(texts, "id int, text string")
    table = spark.createDataFrame([(e,) for e in [*wanted, "", None, "AA", "aa", wanted[0].upper()]], "expression string")
    known = {*wanted, "aa"}
    want = sorted((i, e, at) for i, t in texts if t for low in [t.lower()] for at in range(len(low)) for n in range(2, 10) for e in [low[at : at + n]] if e in known and len(e) == n)
    for size in (1 << 20, 20_000):
        found = expressions.expression_places(docs, "id", "text", table, slice_bytes=size)
        assert sorted(map(tuple, found.collect())) == want
    assert expressions.expression_places(docs, "id", "text", table.limit(0)).count() == 0
    assert expressions.expression_places(docs.limit(0), "id", "text", table).count() == 0


def test_themes_by_expressions(spark):
    docs = spark.createDataFrame([(1, "Slow pacing, bad Sound"), (2, "nothing"), (3, "SOUND")], "id int, text string")
    themes = spark.createDataFrame([("t1", "pacing"), ("t2", "sound"), ("t1", "slow"), ("t3", "Sound")], "theme_id string, expression string")
    assert {r.id: r.theme_ids for r in expressions.themes_by_expressions(docs, "id", "text", themes).collect()} == {1: ["t1", "t2", "t3"], 3: ["t2", "t3"]}


def test_language_lists_and_labels(spark):
    lists = spark.createDataFrame([("pt", "de"), ("pt", "não"), ("en", "the"), ("en", "of"), ("es", "de"), ("es", "el"), (None, "x"), ("en", "")], "language string, word string")
    texts = ["De não (de)", "The end, of THE day", "de", "el de", "xyz", "", None, "the não"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    counts, known = languages.language_counts(docs, "id", "text", lists)
    assert known == ["en", "es", "pt"]
    found = {r.id: (r.n_en, r.n_es, r.n_pt, r.label) for r in counts.select("*", languages.language_of(known).alias("label")).collect()}
    mixed, unknown = languages.MIXED, languages.UNKNOWN
    assert found == {
        0: (0, 2, 3, "pt"), 1: (3, 0, 0, "en"), 2: (0, 1, 1, mixed), 3: (0, 2, 1, "es"), 4: (0, 0, 0, unknown), 5: (0, 0, 0, unknown), 6: (0, 0, 0, unknown), 7: (1, 0, 1, mixed),
    }
    assert languages.language_counts(docs.limit(0), "id", "text", lists)[0].count() == 0
    own = spark.createDataFrame([("a", "x y both"), ("a", "x z"), ("b", "w both"), (None, "lost"), ("b", None)], "lang string, text string")
    assert sorted(map(tuple, languages.word_lists(own, "lang", "text", 3).collect())) == [("a", "x"), ("a", "y"), ("b", "w")]


def test_sketches_roll_up_and_grow(spark, tmp_path):
    rows = spark.range(60000).select((F.col("id") % 3).alias("film"), (F.col("id") % 10).alias("level"), (F.col("id") % 7000).alias("who"), ((F.col("id") * 7919) % 60000).cast("double").alias("x"))
    first, second = rows.filter("id < 40000"), rows.filter("id >= 40000")
    sketches.sketched(first, ["film", "level"], "who", "x").write.parquet(f"{tmp_path}/s")
    both = sketches.merged(spark.read.parquet(f"{tmp_path}/s"), sketches.sketched(second, ["film", "level"], "who", "x"), ["film", "level"])
    whole = sketches.rolled_up(both, []).select("n", sketches.n_distinct().alias("d"), *(sketches.quantile(q).alias(f"q{k}") for k, q in enumerate((0.1, 0.5, 0.9)))).first()
    assert whole.n == 60000 and abs(whole.d - 7000) <= 7000 * sketches.DISTINCT_ERROR
    for found, q in zip((whole.q0, whole.q1, whole.q2), (0.1, 0.5, 0.9), strict=True):
        assert abs(found / 60000 - q) <= sketches.RANK_ERROR
    empty = sketches.sketched(rows.select("film", F.lit(None).cast("long").alias("who"), F.lit(None).cast("double").alias("x")), ["film"], "who", "x")
    assert {(r.n, r.d, r.q) for r in sketches.rolled_up(empty, []).select("n", sketches.n_distinct().alias("d"), sketches.quantile(0.5).alias("q")).collect()} == {(60000, 0, None)}


def test_upsert_rewrites_touched_buckets_only(spark):
    path, schema = fresh_path(spark, "kept"), "key string, v int, run int"
    order = [F.col("run")]
    first = [(f"k{i}", i, 1) for i in range(200)] + [(None, 0, 1), ("k0", 5, 0), ("k0", 6, 0)]
    upsert(spark.createDataFrame(first, schema), path, "key", order, buckets=16)
    files = lambda: {f for f in spark.read.parquet(path).inputFiles()}
    before = files()
    found = upsert(spark.createDataFrame([("k3", 33, 2), ("new", 1, 2), (None, 9, 2), ("k4", 44, 0)], schema), path, "key", order, buckets=16).collect()
    assert {r.key: (r.v, r.run) for r in found} == {f"k{i}": (i, 1) for i in range(200)} | {"k3": (33, 2), "new": (1, 2), None: (9, 2)}
    assert len(found) == 202 and 12 <= len(before & files()) < len(before)


def test_upsert_that_fails_leaves_the_table(spark):
    path, schema = fresh_path(spark, "kept"), "key string, v int, run int"
    order = [F.col("run")]
    upsert(spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], schema), path, "key", order)
    bad = spark.createDataFrame([("a", 5, 2), ("c", 0, 2)], schema).withColumn("v", F.expr("IF(v = 0, CAST(raise_error('lost') AS INT), v)"))
    with pytest.raises(Exception, match="lost"):
        upsert(bad, path, "key", order)
    assert sorted((r.key, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]


def test_counters_come_from_the_one_job(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "network").otherwise("cache").alias("origin"))
    path = fresh_path(spark, "counted")
    spark.sparkContext.setJobGroup("counted", "one job")
    found = observed.write_with_counters(rows, lambda x: x.write.mode("overwrite").parquet(path), "origins", **observed.origin_counters())
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("counted")
    spark.sparkContext.setJobGroup("other", "")
    assert found == {"n_network": 100, "n_cache": 900} and len(jobs) == 1
    assert spark.read.parquet(path).count() == 1000


def test_origins_of_hot_tied_and_missing_keys(spark):
    """One key holds most requests; two come at one time; requests without a key share theirs."""
    rows = [("hot", t, 0) for t in range(50)] + [("hot", 0, 1), ("tie", 7, 0), ("tie", 7, 1), ("tie", 9, 2), (None, 3, 0), (None, 4, 1), ("held", 1, 0), ("held", 2, 1)]
    requests = spark.createDataFrame(rows, "url string, at int, n int")
    cached = spark.createDataFrame([("held",), ("held",), ("other",), (None,)], "url string")
    found = records.with_origin(requests, cached, "url")
    assert found.columns == ["url", "at", "n", "origin"] and found.count() == len(rows)
    network = sorted(map(str, ((r.url, r.at) for r in found.collect() if r.origin == "network")))
    assert network == sorted(map(str, [("hot", 0), ("tie", 7), (None, 3)]))
    assert records.with_origin(requests.limit(0), cached, "url").count() == 0


def test_documents_that_repeat_or_lack_parts(spark):
    documents = spark.createDataFrame([("a", [("negativas", 7), ("medianas", None)]), ("a", [("negativas", 8)]), ("b", []), ("c", None), (None, [("negativas", 1)])], "film string, buckets array<struct<bucket:string,share_real:int>>")
    shares = spark.createDataFrame([("a", "negativas", 70), ("a", "positivas", 30), ("b", "negativas", None), (None, "negativas", 5)], "film string, bucket string, share_real int")
    found = [(r.film, None if r.buckets is None else [(b.bucket, b.share_real) for b in r.buckets]) for r in records.apply_distribution(documents, shares).collect()]
    want = [("a", [("negativas", 70), ("medianas", None)]), ("a", [("negativas", 70)]), ("b", []), ("c", None), (None, [("negativas", None)])]
    assert sorted(map(str, found)) == sorted(map(str, want))
    catalogue = spark.createDataFrame([("b", 2), ("a", 1), ("a", 3), ("zz", 4), (None, 5)], "film string, place int")
    assert sorted(r.place for r in compare.in_catalogue_order(documents, catalogue).collect()) == [1, 1, 2, 3, 3]


def test_candidates_that_tie(spark):
    rows = [
        ("f", 2000, 2, 10, "2000-05-01", 5.0), ("f", 2000, 1, 11, "2000-01-01", 5.0), ("f", 2000, 0, 12, "1999-01-01", 99.0), ("g", None, 1, 20, "2001-01-01", 1.0), ("g", None, 0, 21, None, None),
        ("h", 1990, 3, 30, "1990-01-01", None), ("h", 1990, 4, 31, "1990-02-02", 0.0), (None, 1990, 0, 40, "", None),
    ]
    found = records.best_candidate(spark.createDataFrame(rows, "film string, year int, rank int, id int, release_date string, popularity double"), ["film"]).collect()
    assert {r.film: (r.id, r.same_year) for r in found} == {"f": (11, True), "g": (21, False), "h": (30, True), None: (40, False)}


def test_exact_figures_are_dealt_by_the_number_of_rows(spark):
    """A task's rows stay as many when there are more of them, also behind a join with a table that is dealt by the session's number."""
    tasks = {}
    for n in (4_000, 40_000):
        rows = spark.range(n).select((F.col("id") % 1000).alias("film"), "id")
        told = rows.groupBy("film").agg(F.count(F.lit(1)).alias("n"))
        every, few = sketches.dealt(rows, told, "film", 1_000)
        joined = every.join(few.hint("shuffle_hash"), "film").withColumn("task", F.spark_partition_id())
        found = joined.groupBy("film", "n").agg(F.count(F.lit(1)).alias("again"), F.max("task").alias("task"))
        got = found.collect()
        assert len(got) == 1000 and all(r.n == r.again == n // 1000 for r in got)
        tasks[n] = len({r.task for r in got})
    assert tasks[4_000] == 4 and tasks[40_000] > 30


def test_word_lists_are_made_once(spark):
    """However often lists are looked at, what they come from is read once."""
    made = spark.sparkContext.accumulator(0)

    def told(word):
        made.add(1)
        return word

    rows = [("pt", "de"), ("pt", "que"), ("en", "the"), ("en", "")]
    lists = spark.createDataFrame(rows, "language string, word string").withColumn("word", F.udf(told, "string").asNondeterministic()("word"))
    texts = spark.createDataFrame([(1, "the de QUE, x"), (2, None)], "id int, prose string")
    counts, known = languages.language_counts(texts, "id", "prose", lists)
    assert known == ["en", "pt"] and sorted((r.id, r.n_en, r.n_pt) for r in counts.collect()) == [(1, 1, 2), (2, 0, 0)]
    assert made.value == len(rows)
