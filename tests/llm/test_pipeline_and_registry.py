import itertools
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F
from test_minhash import brute
from test_tokens_and_packing import best_fit_decreasing

import __spark_entry__
import corpus_pipeline
from tierloom.llm import exact_dedup, minhash, packing, quality, registry


@pytest.fixture
def sf_dir(make_docs, spark, prose, tmp_path):
    texts = [prose(60, k % 50) for k in range(120)] + ["### $$$ !!! " * 20 + str(k) for k in range(40)] + [None, "", prose(60, 1) + " more", "short"]
    path = str(tmp_path)
    make_docs(texts).write.parquet(path + "/documents.parquet")
    spark.createDataFrame([(k, int(k < 120), 0) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    return path


def test_stages_apply_their_decisions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "packing"]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/out{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append((before, docs))
    for before, after in seen[:-1]:
        assert after.columns == before.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    predicted = {r.doc_id for r in quality.score_texts(seen[0][0], spark.read.parquet(sf_dir + "/labels.parquet")).collect() if r.predicted}
    assert ids(seen[0][1]) == predicted and predicted >= set(range(120)) and not predicted & set(range(120, 160))
    assert ids(seen[1][1]) == {r.doc_id for r in exact_dedup.mark_duplicates(seen[1][0]).collect() if r.kept}
    assert ids(seen[2][1]) == {r.doc_id for r in minhash.near_components(seen[2][0]).collect() if r.kept}
    packed = packing.pack(seen[3][0])
    assert sorted(map(tuple, seen[3][1].collect())) == sorted(map(tuple, packed.collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, packed.collect()))


def test_odd_tables(spark, make_docs, prose, tmp_path):
    """An empty table; null and repeated ids, null texts and columns whose names the operators use inside."""
    spark.createDataFrame([(k, int(k < 20), 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    good, junk = [prose(60, k) for k in range(20)], ["### $$$ !!! " * 20 + str(k) for k in range(10)]
    texts = good + junk + [good[0], good[1] + " more", None, "", prose(60, 50), prose(60, 50), prose(60, 51)]
    docs = make_docs(texts, [*range(30), None, None, None, 40, None, None, 5]).withColumn("key", F.lit(1)).withColumn("root", F.lit(2)).withColumn("fold", F.lit("f"))
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        assert kept.columns == docs.columns and kept.count() > 0
    placed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in placed}
    # every good text is there by its id; copies without an id went, the repeated text without an id is there once
    assert ids >= set(range(20)) and not ids & set(range(20, 30))
    assert len([r for r in placed if r.doc_id is None and r.doc_tokens > 1]) == 1
    assert len({(r.sequence_id, r.offset) for r in placed}) == len(placed)


def test_names_and_sql_match(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None
    assert [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")] == list(registry.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_agrees(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    ours = registry.queries()[name](spark, sf)
    theirs = con.execute(registry.oracle_sql()[name]).to_arrow_table().select(ours.columns).to_pylist()
    assert sorted(map(str, (tuple(r.values()) for r in theirs))) == sorted(map(str, map(tuple, ours.collect())))


def test_whole_pipeline_against_plain_steps(spark):
    """Every step after the classifier's decisions in plain Python: equal texts, all pairs, the library's tokens, best fit."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    good = {r.doc_id for r in quality.score_texts(docs, labels).collect() if r.predicted}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    told = [i for i in texts if marks.get(i) is not None]
    assert sum((i in good) == bool(marks[i]) for i in told) >= 0.9 * len(told) > 0
    last = {}
    for i in sorted(good):
        last[texts[i]] = i
    unique = {i: texts[i] for i in last.values()}
    component = brute(unique)[0]
    kept = {i for i in unique if component[i] == i}
    assert len(texts) > len(good) > len(unique) > len(kept)
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = {i: [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 0] for i in kept}
    found = corpus_pipeline.run(spark, sf).collect()
    pieces = defaultdict(list)
    for r in found:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(np.array(own, "<u4").tobytes()))
        pieces[r.doc_id].append((r.start, r.length))
    assert {i: sum(n for _, n in sorted(p)) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}
    assert all(a + n == b for p in pieces.values() for (a, n), (b, _) in itertools.pairwise(sorted(p)))
    windows = defaultdict(list)
    for r in found:
        windows[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in w) <= 1024 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(w))) and min(w)[0] == 0 for w in windows.values())
    assert len(windows) == len(best_fit_decreasing([r.length for r in found], 1024))
