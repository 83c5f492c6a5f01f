import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierloom.llm import exact_dedup, url_filter
from tierloom.llm.durable import joined_where_hot, lasting, scratch, written


def test_minimal_perfect_hash_gives_every_digest_its_own_slot():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    words = exact_dedup._digest_words(digests)
    sizes, bits = exact_dedup.build_hash(words)
    assert sorted(exact_dedup.slots_of(words, sizes, bits)) == list(range(5000))
    assert exact_dedup.build_hash(words[:0])[0] == []


@pytest.mark.parametrize("per_bucket", [4096, 2])
def test_groups_against_brute_force(make_docs, odd_texts, per_bucket):
    texts = odd_texts * 2 + ["hot"] * 50
    found = exact_dedup.mark_duplicates(make_docs(texts), per_bucket).collect()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    assert len(found) == len(texts)
    for r in found:
        group = groups[texts[r.doc_id] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), r.doc_id == max(group))
        assert r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_ids_null_and_repeated_and_empty(make_docs):
    found = exact_dedup.mark_duplicates(make_docs(["a", "a", "b", "c", "c"], [None, 1, None, 2, 2])).collect()
    assert sorted((r.text_sha256[:2], r.doc_id or -1, r.keep_id or -1, r.kept) for r in found) == sorted(
        [("ca", -1, 1, False), ("ca", 1, 1, True), ("3e", -1, -1, True), ("2e", 2, 2, True), ("2e", 2, 2, True)]
    )
    assert exact_dedup.mark_duplicates(make_docs([])).count() == 0
    docs = make_docs(["a", "a", "b", "c", "c"], [None, 1, None, 2, 2])
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "b"), (1, "a"), (2, "c")]
    # of rows with one id and text the same one stays, however they are dealt
    twice = make_docs(["c"] * 6 + ["d", "d"], [2] * 6 + [None, None]).withColumn("extra", F.monotonically_increasing_id())
    several = [sorted(map(str, exact_dedup.drop_duplicates(twice.repartition(n)).collect())) for n in (1, 3)]
    assert several[0] == several[1] and len(several[0]) == 2


def test_nonmembers_that_fall_on_a_slot_are_told_apart():
    words = exact_dedup._digest_words([hashlib.sha256(str(i).encode()).digest() for i in range(300)])
    other = exact_dedup._digest_words([hashlib.sha256(f"x{i}".encode()).digest() for i in range(3000)])
    sizes, bits = exact_dedup.build_hash(words)
    slots = exact_dedup.slots_of(other, sizes, bits)
    assert (slots >= 0).any()  # so the comparison of digests is what decides


@pytest.mark.parametrize("listed", [0, 1, 37, 2000, 3999, 4000])
def test_cascade_is_exact_for_its_universe(listed):
    rng = np.random.default_rng(listed)
    h1, h2 = (rng.integers(0, 1 << 63, 4000, dtype=np.uint64) for _ in range(2))
    inside = np.arange(4000) < listed
    levels = url_filter.build_cascade(h1, h2, inside)
    assert (url_filter.is_listed(levels, h1, h2) == inside).all()


URLS = [
    None, "", "no scheme", "http://", "://x", "HTTP://A.Example.ORG/es/1", "http://example.org/en/12?q#f", "http://notexample.org/en/1", "https://org/", "http://org",
    "http://b.com/fr/", "http://com/de/x", "http://spam-farm.net/" + "long/" * 60000, "http://" + "sub." * 30000 + "example.org/es/", "http://spam-farm.net/", "http://a.spam-farm.com/fr/1", "http://x.net?://y.org/es/", "http://x.org#/es/", "ftp://u@h.org:80/a//b?c", "a\nhttp://q.com/de/",
]


LISTED = {"spam-farm.net", "a.spam-farm.com", "nowhere.net", *(f"h{k}.fine.net" for k in range(0, 200, 3))}


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    listed = host in LISTED
    return host, path, rule, verdict or ("block" if listed else "allow")


@pytest.mark.parametrize("budget", [1 << 20, -1])
def test_urls_against_plain_python(spark, budget):
    urls = URLS * 3 + [f"http://h{k}.fine.net/p" for k in range(200)]
    pages = spark.createDataFrame([(i, u, "<p>", "h", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host string, h1 int")
    listed = spark.createDataFrame([(h, "x") for h in [*LISTED, "nowhere.net", None]], "host string, url string")
    found = url_filter.judge_urls(pages, listed, per_shard=50, broadcast_bytes=budget).collect()
    assert len(found) == len(urls)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(urls[r.page_id])
    assert url_filter.judge_urls(pages.limit(0), listed, broadcast_bytes=budget).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, listed.limit(0), broadcast_bytes=budget).collect() if r.rule is None} == {"allow"}


def test_membership_of_other_keys(spark):
    rows = spark.createDataFrame([(str(k % 70),) for k in range(300)] + [(None,)], "k string")
    found = url_filter.with_membership(rows, "k", spark.createDataFrame([("0",), ("7",), ("14",), ("none",)], "k string"), "hit", per_shard=20).collect()
    assert len(found) == 301 and all(r.hit == (r.k in ("0", "7", "14")) for r in found)


def test_hot_groups_are_joined_where_they_lie(spark):
    rows = spark.createDataFrame([("hot",)] * 3000 + [(str(k % 900),) for k in range(2000)] + [(None,)], "g string")
    groups = rows.filter("g IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("g")).alias("x"))
    both = joined_where_hot(rows, groups, "g", "n", 5001)
    assert both.count() == 5000 and both.filter("x <> length(g)").count() == 0
    assert both.groupBy("g").count().filter("g = 'hot'").first()["count"] == 3000


def test_tables_go_with_their_scope(spark):
    with scratch(spark):
        inner = written(spark.range(5).toDF("x"), "inner")
        with scratch(spark):
            kept, lost = lasting(inner, "kept"), written(inner, "lost")
        assert kept.count() == 5 and inner.count() == 5
        with pytest.raises(Exception, match="(?i)not.exist|file"):
            lost.count()
        outer = lasting(kept, "outer")
    assert outer.count() == 5
    with pytest.raises(Exception, match="(?i)not.exist|file"):
        kept.count()
