import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tierloom.llm import fill_in_middle, filter_audit, mixing

WORD = r"[^\x20\x09-\x0D]+"

# fill in middle


def cut(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_middle_against_plain_python(make_docs, odd_texts, prose):
    special = ["x <P> y", "<S>", "tail <M>", "<P", "S>", "<<<S", "$1 \\1 ${x} \\Q", "a\r\nb c\x85", "😀" * 9000, "é" * 5000, "<S" * 300, "a" * 4096, "b" * 8192]
    texts = odd_texts + special + [prose(n, n) for n in range(1, 120)]
    texts += ["the same text"] * 300
    found = {r.doc_id: r for r in fill_in_middle.fill_in_middle(make_docs(texts)).collect()}
    assert len(found) == len(texts) and {r.form for r in found.values()} == {"plain", "psm", "spm"}
    for i, text in enumerate(texts):
        r = found[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut(i, text)


def test_middle_comes_back_and_odd_rows(make_docs, odd_texts, prose):
    texts = odd_texts + ["long 😀\n " * 400_000, prose(40, 1), prose(40, 1)]
    ids = [None, None, *range(len(texts) - 4), 3, 3]
    found = fill_in_middle.fill_in_middle(make_docs(texts, ids))
    back = found.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in zip(ids, texts, strict=True))
    digests = fill_in_middle.digests(found).collect()
    assert Counter(r.restored_sha256 for r in digests) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for t in texts)
    assert fill_in_middle.fill_in_middle(make_docs([])).count() == 0
    every = fill_in_middle.fill_in_middle(make_docs(["ab c"] * 50), transformed=100, suffix_first=100).collect()
    assert {r.form for r in every} == {"spm"}


def test_middle_stays_in_the_jvm(make_docs):
    plan = fill_in_middle.digests(fill_in_middle.fill_in_middle(make_docs(["a"])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# filter audit


def audited(rows, marks):
    """rows: (doc_id, text, lang); marks: doc_id to (quality, toxic)."""
    firsts = {}
    for i, text, _ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    failed = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(WORD, text)
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        fails |= {"D"} if set("#$%&*|") & set(text) else set()
        fails |= {"E"} if i is not None and firsts[text] < i else set()
        failed.append((lang or "", fails, *marks.get(i, (False, False))))
    out = {}
    shapley = Counter()
    for part in {x[0] for x in failed}:
        own = [x for x in failed if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                stay = [x for x in left if f not in x[1]]
                shapley[part, f] += len(gone)
                out[part, order, step] = [
                    len(stay), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone),
                ]
                left = stay
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


@pytest.fixture
def corpus(spark, odd_texts, prose):
    texts = odd_texts + [prose(n * 3, n % 40) for n in range(150)] + [prose(250, 7)] * 60 + ["LOUD " * 300, "a b # c", prose(220, 5).upper(), None, None, "one two"] * 3
    ids = [*range(len(texts) - 8), None, None, 3, 3, 5, 5, 9000, 9000]
    langs = [("en", "de", None, "")[k % 4] for k in range(len(texts))]
    rows = list(zip(ids, texts, langs, strict=True))
    docs = spark.createDataFrame([(*r, 1, "x", b"y", 2) for r in rows], "doc_id long, text string, lang string, mask int, h string, shared binary, bucket int")
    marks = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 200, 2)] + [(0, 0, 0), (4, 1, 0), (None, 1, 1), (6, None, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    held = defaultdict(lambda: (False, False))
    for i, q, t in marks:
        if i is not None:
            held[i] = (held[i][0] or q == 1, held[i][1] or t == 1)
    return rows, docs, labels, held


@pytest.mark.parametrize("buckets", [16384, 0])
def test_audit_against_plain_python(corpus, monkeypatch, buckets):
    """Also with more rows than the sketch has room for: then digests stand for texts."""
    rows, docs, labels, held = corpus
    if not buckets:
        monkeypatch.setattr(filter_audit, "MAX_BUCKETS", 1)
        monkeypatch.setattr(filter_audit, "CELLS_PER_ROW", 1000)
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    assert found == audited(rows, held)
    assert len(found) == 600 * 3


def test_audit_of_no_rows(corpus):
    _, docs, labels, _ = corpus
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert {r.good_lost + r.toxic_lost for r in filter_audit.audit(docs, labels.limit(0)).collect()} == {0}


def test_sketch_clears_only_unique_texts(spark, make_docs, prose):
    texts = [prose(12, k) for k in range(3000)] + [prose(12, 5)] * 400 + [prose(12, k) for k in range(100)]
    docs = make_docs(texts).repartition(7)
    rows = filter_audit.measured(docs).cache()
    sketch = filter_audit.merged_sketch(filter_audit.task_sketches(rows, 1)).cache()
    left = {r.doc_id for r in filter_audit.possible_repeats(rows, sketch, 1).collect()}
    repeated = {i for i, t in enumerate(texts) if Counter(texts)[t] > 1} if len(texts) < 100 else {i for i, t in enumerate(texts) if i >= 3000 or i < 100}
    assert repeated <= left and len(left - repeated) < 600
    # merging is by sum: whatever the split, the same bits
    one = filter_audit.merged_sketch(filter_audit.task_sketches(rows.coalesce(1), 1)).collect()
    assert one == sketch.collect()


def test_failures_of_one_text():
    assert filter_audit.own_failures(b"", 0) == 1
    assert filter_audit.own_failures(b"a " * 200, 400) == 2
    assert filter_audit.own_failures(" ".join(f"w{k}" for k in range(200)).encode(), 800) == 0
    assert filter_audit.own_failures(b"A|", 2) == 1 | 4 | 8
    assert filter_audit.own_failures(("é " * 3).encode(), 6) == 1


# mixing


def filled(sizes, total=1.5, repeats=2):
    """Targets by the rule as it is told: shares by weight, the excess shared again until none is above."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    want, full = Fraction(sum(sizes.values())) * Fraction(total), set()
    while True:
        rest = want - sum(repeats * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in sizes if s not in full)
        target = {s: Fraction(repeats * sizes[s]) if s in full else rest * weight[s] / open_weight for s in sizes}
        above = {s for s in sizes if s not in full and target[s] > repeats * sizes[s]}
        if not above:
            return target
        full |= above


def sources_of(spark, sizes):
    return spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_rows long")


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 300}, {"a": 5, "b": 5, "c": 5}, {"x": 0, "y": 10**6, "é": 7, "z": 900, None: 0}, {str(k): k * k for k in range(40)}, {"only": 77}, {"none": 0}])
def test_targets(spark, sizes):
    found = {r.source: r.target for r in mixing.with_targets(sources_of(spark, sizes)).collect()}
    for s, t in filled(sizes).items():
        assert found[s] == pytest.approx(float(t), rel=1e-12)


@pytest.mark.parametrize("seed", range(4))
def test_quotas_are_the_highest_quotients(spark, seed):
    import random

    rng = random.Random(seed)
    sizes = {str(k): rng.choice([0, 1, 3, 30, 700, 5000, 5000]) for k in range(60)}
    rows = mixing.with_quotas(mixing.with_targets(sources_of(spark, sizes))).collect()
    block = rows[0].block
    blocks = math.floor(1.5 * sum(sizes.values()) / block + 0.5)
    ranked = sorted((-r.target / (2 * k - 1), r.source_no, k) for r in rows for k in range(1, blocks + 1) if r.target > 0)[:blocks]
    assert {r.source_no: r.quota for r in rows if r.quota} == Counter(s for _, s, _ in ranked)


def test_mix(spark, odd_texts, prose):
    texts = odd_texts + [prose(n % 90, n) for n in range(1500)] + ["copy of a text"] * 500 + [None, ""] * 20
    source = lambda k: "hot" if k % 3 else ["a", "b", None, "ß", "Z", "tiny"][k % 6 if k < 1200 else 2]
    ids = [*range(len(texts) - 60), *[None] * 30, *[7] * 30]
    rows = [(i, t, source(k), 5, "s", "k", 1.0) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, key string, at string, target double")
    found = mixing.mix(docs, per_shard=64).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, len(re.findall(WORD, t or ""))) for i, t, *_ in rows)
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(re.findall(WORD, t or ""))
    targets = sorted((n, float(t)) for n, t in ((sizes[s], t) for s, t in filled(sizes).items()))
    assert sorted({(r.source_size, r.target) for r in found}) == [(n, pytest.approx(t)) for n, t in targets]
    taken = Counter()
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.target] += r.taken
    shards = 1 + len(rows) // 64
    for t, n in taken.items():
        assert abs(n - t) <= 16 * (shards + 1) and abs(n - t) <= 0.02 * t + 20
    # most documents are taken whole
    assert sum(r.taken % r.size != 0 for r in found if r.size) <= 2 * (shards + len(sizes))
    again = mixing.mix(docs.repartition(5), per_shard=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mix_deals_a_hot_id_to_many_shards(spark):
    """A third of all rows without an id and alike: they lie in lots, and every run takes as much of them."""
    rows = [(None, "one two three", "hot")] * 3000 + [(k, "w " * (k % 50), "hot" if k % 2 else "b") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lots = mixing.lots(docs)
    assert lots.filter("doc_id IS NULL").agg(F.sum("copies"), F.max("copies"), F.count(F.lit(1))).first()[:] == (3000, 64, 47)
    several = [sorted(map(str, mixing.mix(docs.repartition(n), per_shard=100).collect())) for n in (1, 5)]
    assert several[0] == several[1] and len(several[0]) == 9000
    found = mixing.mix(docs, per_shard=100).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.try_divide("taken", "size")).alias("most")).collect()
    assert all(r.most <= 2 and abs(r.taken - r.target) <= 0.01 * r.target for r in found) and len(found) == 2


def test_mix_of_little(spark, make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    assert [tuple(r) for r in mixing.mix(make_docs([None])).collect()] == [(0, 0, 0, 0.0, 0)]
    r = mixing.mix(make_docs(["a b c", " d\te "])).collect()
    assert sum(x.taken for x in r) in (7, 8) and {x.target for x in r} == {7.5}


def test_mix_has_no_python(make_docs, monkeypatch):
    """Every table that the operator writes is planned without a Python worker."""
    plans = []
    for name in ("written", "lasting"):
        own = getattr(mixing, name)
        monkeypatch.setattr(mixing, name, lambda df, label, own=own: (plans.append(df._jdf.queryExecution().executedPlan().toString()), own(df, label))[1])
    mixing.mix(make_docs(["a b c", "d e"])).count()
    assert len(plans) >= 5 and not any("Python" in p or "Arrow" in p for p in plans)
