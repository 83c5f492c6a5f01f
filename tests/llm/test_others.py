import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierloom.llm import collision_ann, license_join, quality, registry, resharding

# resharding


def test_flow_moves_the_fewest_bytes():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n, m = rng.integers(1, 8, 2)
        supply = rng.integers(0, 100, n).tolist()
        total = sum(supply)
        capacity = [total * (j + 1) // m - total * j // m for j in range(m)]
        flow = resharding.min_cost_flow(supply, capacity, 1 - np.eye(n, m, dtype=np.int64))
        assert flow.sum(axis=1).tolist() == supply and flow.sum(axis=0).tolist() == capacity
        assert total - np.trace(flow) == total - sum(min(s, c) for s, c in zip(supply, capacity, strict=False))
    # with other costs, against all ways of a small case
    cost = np.array([[3, 1], [1, 5]])
    flow = resharding.min_cost_flow([2, 2], [3, 1], cost)
    assert (flow * cost).sum() == min((np.array([[a, 2 - a], [b, 2 - b]]) * cost).sum() for a in range(3) for b in range(3) if a + b == 3)
    with pytest.raises(ValueError):
        resharding.min_cost_flow([5], [1, 1], np.ones((1, 2), np.int64))


@pytest.mark.parametrize("per_block", [8192, 16])
def test_shards(make_docs, odd_texts, prose, per_block):
    texts = odd_texts + [prose(int(n), int(n)) for n in np.random.default_rng(1).integers(1, 80, 900)] + ["copy"] * 400
    found = resharding.reshard(make_docs(texts), shards=10, per_block=per_block).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(texts)))
    bytes_in, slots = {}, {}
    for r in found:
        text = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 16, zlib.crc32(text.encode()), "bytes", None)
        bytes_in[r.shard] = bytes_in.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    even = sorted(bytes_in.values())
    longest = max(r.size for r in found)
    # one text is longer than a shard's share; the others share the rest evenly
    assert even[-1] <= max(longest, sum(even) / 10) + 400
    assert even[-2] - even[0] <= 0.1 * even[-2] + 400


def test_moved_bytes_are_the_flow_s(make_docs, prose):
    """Bytes that stay where they are fall short of the least-cost flow's by no more than a document for each cut."""
    texts = [prose(int(n), k) for k, n in enumerate(np.random.default_rng(3).integers(1, 60, 1500))] + ["copy"] * 300 + [None] * 50
    docs = make_docs(texts, [*range(1700), *[None] * 150])
    old = F.when(F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == 0, 0).otherwise(F.coalesce(F.col("doc_id"), F.lit(0)) % 5)
    found = resharding.reshard(docs, old, shards=8, old_shards=5, per_block=64).collect()
    supply = np.zeros(5, np.int64)
    for r in found:
        supply[r.old_shard] += r.size
    total = int(supply.sum())
    capacity = [total * (j + 1) // 8 - total * j // 8 for j in range(8)]
    flow = resharding.min_cost_flow(supply.tolist(), capacity, 1 - np.eye(5, 8, dtype=np.int64))
    stayed = sum(r.size for r in found if not r.moved)
    small = sorted(r.size for r in found)[len(found) // 2]
    assert abs(stayed - int(np.trace(flow))) <= 8 * small
    assert {r.moved for r in found if r.shard == r.old_shard} <= {False} and all(r.moved == (r.shard != r.old_shard) for r in found)


def test_capacities_nulls_and_empty(make_docs, prose):
    docs = make_docs([prose(20, k) for k in range(300)] + [None], [*range(300), None])
    total = resharding.reshard(docs).agg(F.sum("size")).first()[0]
    capacities = [total // 2, total // 4, total - total // 2 - total // 4]
    found = resharding.reshard(docs, capacities=capacities, shards=3, old_shards=2, old_shard=F.coalesce(F.col("doc_id") % 2, F.lit(0))).collect()
    for j, c in enumerate(capacities):
        assert abs(sum(r.size for r in found if r.shard == j) - c) < 300
    assert resharding.reshard(make_docs([])).count() == 0


def test_rewrite_affected(make_docs, prose, tmp_path):
    docs = make_docs([prose(20, k) for k in range(200)])
    placed = resharding.reshard(docs, shards=4, old_shards=2, old_shard=F.when(F.col("doc_id") < 150, 0).otherwise(1)).persist()
    affected = resharding.rewrite_affected(docs.drop("shard"), placed, str(tmp_path / "out"))
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert sorted(r.shard for r in back.select("shard").distinct().collect()) == affected
    assert back.count() == placed.filter(F.col("shard").isin(affected)).count()


@pytest.mark.parametrize("own_key", [False, True])
def test_rewrite_null_and_repeated_ids_and_untouched_shards(spark, prose, tmp_path, own_key):
    # shards 0 and 3 (of old shards 0 to 3) are full already; 1 gives to 2; the rows of old shard 4 leave it
    # ids: null, seven times the same, and distinct ones, with equal and different texts
    ids = [None, None, 7, 7, 7, None, 7, 7, 7, *range(100, 111)]
    rows = [(i, "copy of it" if k % 2 else prose(10, k)[:10].ljust(10, "x"), old, k) for old, n in ((0, 20), (1, 20), (3, 20), (4, 20)) for k, i in enumerate(ids[:n])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old int, k int")
    docs.write.parquet(f"{tmp_path}/docs")
    docs, path = spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/out"
    docs.withColumn("shard", F.col("old")).withColumn("slot", F.lit(-1).cast("long")).write.partitionBy("shard").parquet(path)
    size = 20 * 26
    how = {"old_shard": F.col("old"), "shards": 4, "old_shards": 5, "capacities": [size, size // 2, size + size // 2, size]}
    key = F.struct("_metadata.file_path", "_metadata.row_index") if own_key else None
    placed = resharding.reshard_files(docs, path, key, **how).collect()
    assert resharding.ROW_KEY not in placed[0].asDict() and len(placed) == len(rows)
    affected = {s for r in placed if r.moved for s in (r.old_shard, r.shard)}
    assert 4 in affected and not affected & {0, 3}
    back = spark.read.parquet(path).collect()
    assert sorted((str(r.doc_id), r.text, r.old, r.k) for r in back) == sorted((str(i), *rest) for i, *rest in rows)
    assert {r.shard for r in back} == {r.shard for r in placed}
    for shard in {r.shard for r in placed}:
        assert sorted(r.slot for r in back if r.shard == shard) == ([-1] * 20 if shard in (0, 3) else sorted(r.slot for r in placed if r.shard == shard))
    with pytest.raises(ValueError):
        resharding.rewrite_affected(docs, spark.createDataFrame(placed), path)


def test_query_writes_shards(spark, make_docs, prose, tmp_path):
    make_docs([prose(20, k) for k in range(60)] + [None, "x", "x"], [*range(60), None, 3, 3]).drop("shard").write.parquet(f"{tmp_path}/documents.parquet")
    paths = []
    real = resharding.rewrite_affected
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(resharding, "rewrite_affected", lambda docs, placed, path: paths.append(path) or real(docs, placed, path))
        found = registry.queries()["op3_resharding"](spark, str(tmp_path)).collect()
    back = spark.read.parquet(paths[0]).collect()
    affected = {s for r in found if r.moved for s in (r.old_shard, r.shard)}
    assert sorted((r.shard, r.slot, str(r.doc_id)) for r in back) == sorted((r.shard, r.slot, str(r.doc_id)) for r in found if r.shard in affected)


# nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string, part int, score double")


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[100:400] = x[100]  # many copies
    odd = [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [float("inf")] + [1.0] * 23), (5005, [None] + [1.0] * 23), (None, [1.0] * 24), (5050, [0.0] * 24)]
    rows = [(i, v.tolist(), 0, "v", 1, 0.5) for i, v in enumerate(x)] + [(i, v, 0, "v", 1, 0.5) for i, v in odd]
    found = collision_ann.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, per_block=400, per_group=8).collect()
    d = x.astype(float)
    norms = np.sqrt((d * d).sum(axis=1))
    hits = total = 0
    for q in range(0, 1500, 50):
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        cosine = (d * d[q]).sum(axis=1) / (norms * norms[q])
        assert all(s == cosine[i] for _, i, s in own)
        cosine[q] = -9
        best = np.lexsort((np.arange(1500), -cosine))[:5].tolist()
        hits, total = hits + len(set(best) & {i for _, i, _ in own}), total + 5
        if 100 <= q < 400:
            assert [i for _, i, _ in own] == best
    assert len(found) == total and hits >= 0.9 * total


def test_components_out_of_range_and_many_lengths(spark):
    """Squares that overflow or vanish, subnormal numbers, and vectors of many lengths, some without a query."""
    rows = [(0, [1e200, 0.0], 0), (1, [2e-320, 2e-320], 0), (2, [1e-200, 3e-200], 0), (3, [-1e308, 1e308], 0), (50, [5e-324, 0.0], 0)]
    rows += [(1000 + 100 * n + j, [float(j + i * i % 7 + 1) for i in range(n)], 0) for n in range(3, 9) for j in range(0, 60, 10)]
    rows += [(5001, [1.0] * 20, 0), (5002, [2.0] * 20, 0)]
    found = collision_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, length int"), F.col("vec_id") % 50 == 0).collect()
    by = {i: [Fraction(x) for x in v] for i, v, _ in rows}

    def cosine(a, b):
        dot, one, two = (sum(x * y for x, y in zip(u, v, strict=True)) for u, v in ((a, b), (a, a), (b, b)))
        return (1 if dot > 0 else -1) * math.sqrt(dot * dot / (one * two)) if dot else 0.0

    queries = [i for i in by if i % 50 == 0]
    assert {r.query_id for r in found} == set(queries)
    for q in queries:
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        others = {i for i, v in by.items() if len(v) == len(by[q]) and i != q}
        assert {r.vec_id for r in own} <= others and len(own) == min(5, len(others))
        assert all(r.score == pytest.approx(cosine(by[q], by[r.vec_id]), abs=1e-12) for r in own)
        assert [r.score for r in own] == sorted((r.score for r in own), reverse=True)


def test_few_vectors_repeats_and_none(spark):
    rows = [(0, [1.0, 0.0], 0, "", 1, 0.0), (0, [1.0, 0.0], 0, "", 1, 0.0), (1, [0.0, 2.0], 0, "", 1, 0.0), (2, [1.0, 1.0], 0, "", 1, 0.0), (100, [1.0, 0.0, 0.0], 0, "", 1, 0.0)]
    found = collision_ann.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] == [(0, 1, 2), (0, 2, 1)]
    assert collision_ann.nearest(vectors(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0


# licences

NOTICES = [
    "Released under the MIT License.", "x\nReleased under the\nMIT License", "MIT-License mit license MIT  license", "gnu general public licensegpl GNU (General) Public, License!",
    "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "version License Apache the under LICENSED 2 0 and more words", "cc by" * 3, "cc\tby cc by", "MİT license é",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software", None, "", " ", "¿",
]


def plain_scan(text):
    low = (text or "").translate(str.maketrans(license_join.UPPER, license_join.LOWER))
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) if w]
    words, places, base = split(low), [], set()
    for phrase, label in license_join.PHRASES:
        own = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        places += at
        base |= {label} if at else set()
    labels, score = set(base), 0.0
    for label, notice in license_join.TEMPLATES:
        wanted = set(license_join.word_set(notice))
        for b in range(len(words)):
            run = words[b : b + license_join.run_length(notice)]
            n, said = len(wanted & set(run)), f" {' '.join(run)} "
            if n >= license_join.needed(len(wanted)) and all(any(f" {p} " in said for p in group) for group in license_join.TELLING.get(label, ())):
                labels.add(label)
                score = max(score, n / len(wanted))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_licences_against_plain_python(make_docs, odd_texts, prose):
    texts = NOTICES + odd_texts + NOTICES + [prose(40, k) + "\n" + NOTICES[k % 6] + " " + prose(5, k) for k in range(40)]
    found = license_join.scan_licenses(make_docs(texts)).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(texts)))
    for r in found:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == plain_scan(texts[r.doc_id]), texts[r.doc_id]
    same = license_join.scan_licenses(make_docs(["MIT License", "MIT License", "nothing", "x"], [None, None, None, 1])).collect()
    assert sorted(r.n_base for r in same) == [0, 0, 1, 1]
    assert license_join.scan_licenses(make_docs([])).count() == 0


def test_runs_find_wrapped_notices_and_no_neighbours(make_docs, prose):
    wrap = lambda text, n: "\n * ".join(" ".join(text.split()[k : k + n]) for k in range(0, len(text.split()), n))
    wrapped = [(label, f"{prose(30, k)}\n{wrap(notice, n)}\n{prose(30, k + 50)}") for k, (label, notice) in enumerate(license_join.TEMPLATES) for n in (2, 5, 100)]
    wrapped += [("mit-notice", "Released under the terms of\nthe MIT\nLicense"), ("apache-2.0-notice", "Licensed under the Apache\nLicense 2.0"), ("gpl-3.0-notice", "this work is licensed under the GNU General Public License v3")]
    near = [
        "Licensed under CC BY 4.0", "Licensed under CC BY-NC-SA 4.0", "Licensed under CC BY-NC 3.0", "Released under the Apache License", "Released under the BSD License", "Licensed under the Apache License, Version 1.1",
        "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "mit " + prose(50, 1) + " released under " + prose(50, 2) + " the license", None, "",
    ]
    found = license_join.scan_licenses(make_docs([t for _, t in wrapped] + near + [wrapped[0][1]], [*range(len(wrapped) + len(near)), None])).collect()
    assert sorted(r.doc_id for r in found if r.doc_id is not None) == list(range(len(wrapped) + len(near)))
    for r in found:
        named = set(r.labels.split(",")) - set(r.base_labels.split(",")) - {""}
        want = {wrapped[r.doc_id or 0][0]} if (r.doc_id or 0) < len(wrapped) else set()
        assert named == want and (r.score >= 0.8) == bool(want), r
        assert r.score == 1.0 or r.doc_id is None or r.doc_id >= 3 * len(license_join.TEMPLATES)


DENSE = "licensed under the apache license version 2 0 mit "


@pytest.mark.parametrize("size", [100_000, 1_000_000])
def test_long_texts_dense_in_template_words(make_docs, size):
    times = size // len(DENSE)
    r = license_join.scan_licenses(make_docs([DENSE * times, "x"])).filter("doc_id = 0").first()
    one = plain_scan(DENSE * 20)
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (9 * times, times, 3, 9 * (times - 1) + 3)
    assert (r.base_labels, r.labels, r.score) == one[4:]


def test_dense_and_scattered_words(make_docs):
    """Texts of few words in every order, so that runs overlap, miss a word or have one of them from the next notice."""
    rng = np.random.default_rng(5)
    words = "licensed under the apache license version 2 0 x released mit cc by nc 4 this work is gnu general public 3".split()
    texts = [" ".join(words[k] for k in rng.integers(0, len(words) - (n % 3) * 6, 30 + n)) for n in range(150)]
    texts += [" ".join(x for w in t.split() for x in [w, *(["y"] * int(rng.integers(0, 2)))]) for t in (license_join.TEMPLATES[2][1] * 3, license_join.TEMPLATES[0][1] * 3) for _ in range(40)]
    for r in license_join.scan_licenses(make_docs(texts)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == plain_scan(texts[r.doc_id]), texts[r.doc_id]


def test_templates_of_a_table(spark, make_docs):
    schema = "label string, notice string, telling array<array<string>>"
    rows = [("zlib", "This software is provided as-is, without any express or implied warranty.", [["as is"], ["express or implied", "implied warranty"]]), ("bare", "One two three", None), (None, "lost", None), ("empty", "!", None)]
    templates, telling = license_join.template_table(spark.createDataFrame(rows + rows[:1], schema))
    texts = ["x this SOFTWARE is provided as is, without any express or\nimplied warranty", "this software is provided without any express or implied warranty", "one two  three", "Released under the MIT License.", None]
    found = license_join.scan_licenses(make_docs(texts), templates, telling=telling).collect()
    assert {r.doc_id: (r.labels, r.score) for r in found} == {0: ("zlib", 1.0), 1: ("", 0.0), 2: ("bare", 1.0), 3: ("mit", 0.0), 4: ("", 0.0)}
    with pytest.raises(ValueError):
        license_join.template_table(spark.createDataFrame([("a", "b c", None), ("a", "b d", None)], schema))


def test_query_takes_runs(spark, make_docs, tmp_path):
    make_docs(["Released under the\nMIT License.", "Licensed under CC BY 4.0"]).write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["op9_license_scan"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.labels, r.score) for r in found) == [(0, "mit,mit-notice", 1.0), (1, "cc-by", 0.0)]


# quality


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, label double, features string")


def test_quality_separates_junk_and_keeps_good(spark, make_docs, prose, odd_texts):
    good = [prose(60, k) for k in range(300)]
    junk = ["$$$ *** ### " * (5 + k % 20) + "BUY!! " * (k % 9) for k in range(100)]
    texts = good + junk + odd_texts
    docs = make_docs(texts)
    labels = labelled(spark, [(i, int(i < 300), 0, 0.0, "") for i in range(400)] + [(1, None, 0, 0.0, ""), (None, 1, 0, 0.0, ""), (99999, 0, 0, 0.0, ""), (2, 1, 0, 0.0, "")])
    found = quality.score_texts(docs, labels).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(texts)))
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in found if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == int(r.doc_id < 300) for r in held]) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.predicted}


def test_scores_against_a_direct_fit(spark, make_docs, prose):
    """Ridge weights from one matrix, and calibration by pooling neighbours until none decrease; labels that contradict each other count each."""
    texts = [prose(30 + k % 40, k) for k in range(200)] + ["$$ ## " * (3 + k % 9) + prose(8, k) for k in range(120)]
    marks = [(k, int(k < 200 or k % 17 == 0), 0, 0.0, "") for k in range(320)] + [(k, int(k >= 200), 0, 0.0, "") for k in range(0, 320, 31)]
    docs, labels = make_docs(texts), labelled(spark, marks)
    model = quality.train(quality.features(docs), labels)
    folds = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(quality.SEED)), F.lit(quality.FOLDS)).alias("f")).collect()}
    used = [(i, q) for i, q, *_ in marks if zlib.crc32(str(i).encode()) % 5]
    raw = np.array([quality.text_statistics(texts[i]) for i, _ in used])
    y, fold = np.array([float(q) for _, q in used]), np.array([folds[i] for i, _ in used])
    z = np.clip((raw - raw.mean(axis=0)) / np.maximum(raw.std(axis=0), 1e-6), -8, 8)
    angle = z @ (np.random.default_rng(quality.SEED).standard_normal((z.shape[1], quality.PAIRS)) / quality.WIDTH)
    x = np.hstack([np.ones((len(z), 1)), z, np.cos(angle), np.sin(angle)])

    def ridge(a, b):
        penalty = np.full(a.shape[1], quality.RIDGE * max(len(a), 1.0))
        penalty[0] = 1e-9
        return np.linalg.lstsq(np.vstack([a, np.diag(np.sqrt(penalty))]), np.concatenate([b, np.zeros(a.shape[1])]), rcond=None)[0]

    assert np.allclose(x @ model.weights, x @ ridge(x, y), atol=1e-6)
    outside = np.zeros(len(y))
    for f in range(quality.FOLDS):
        outside[fold == f] = x[fold == f] @ ridge(x[fold != f], y[fold != f])
    bins = np.floor(np.clip(outside, -0.5, 1.5) * quality.BINS / 2).astype(int)
    pools = [[y[bins == b].sum(), (bins == b).sum(), ((b + 0.5) * 2 / quality.BINS) * (bins == b).sum()] for b in sorted(set(bins))]
    while any(a[0] / a[1] >= b[0] / b[1] for a, b in zip(pools, pools[1:], strict=False)):
        k = next(k for k in range(len(pools) - 1) if pools[k][0] / pools[k][1] >= pools[k + 1][0] / pools[k + 1][1])
        pools[k : k + 2] = [[p + q for p, q in zip(*pools[k : k + 2], strict=True)]]
    want = np.clip(np.interp(x @ model.weights, [p[2] / p[1] for p in pools], [p[0] / p[1] for p in pools]), 0, 1)
    # a row that lies on a bin's edge may fall to either side
    assert (np.abs(model.score(raw) - want) < 0.02).mean() > 0.98


def test_quality_without_labels_or_rows(spark, make_docs):
    none = labelled(spark, [])
    found = quality.score_texts(make_docs(["a", None], [None, 3]), none).collect()
    assert [r.score for r in found] == [0.5, 0.5] and {r.doc_id: r.held_out for r in found}[None]
    assert quality.score_texts(make_docs([]), none).count() == 0
    one_kind = labelled(spark, [(i, 1, 0, 0.0, "") for i in range(30)])
    assert all(0.9 < r.score <= 1 for r in quality.score_texts(make_docs(["some words"] * 30), one_kind).collect())


def test_isotonic_steps():
    at, share = quality.isotonic_steps(np.arange(5.0), np.array([0, 3, 1, 4, 4.0]), np.array([2, 4, 4, 4, 4.0]))
    assert (np.diff(share) > 0).all() and share.tolist() == [0.0, 0.5, 1.0] and at.tolist() == [0.0, 1.5, 3.5]
