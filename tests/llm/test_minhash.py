import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tierloom.llm import components as component_rounds
from tierloom.llm import minhash
from tierloom.llm.components import components
from tierloom.llm.shingles import shingle_sets

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(texts):
    """Components by comparing every pair."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in seen[s])
        for s in sets[i]:
            seen[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def check(spark, make_docs, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    found = {r.doc_id: r for r in minhash.near_components(make_docs(texts, ids)).collect()}
    roots, sizes = brute(dict(zip(ids, texts, strict=True)))
    assert {i: r.component_id for i, r in found.items()} == roots
    assert {i: r.n_shingles for i, r in found.items()} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def changed(text, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"z{rng.randint(0, 10**9)}" for w in text.split(" "))


def test_odd_texts(spark, make_docs, odd_texts):
    check(spark, make_docs, odd_texts)


def test_copies_of_one_text_that_are_apart_from_each_other(spark, make_docs, prose):
    base = prose(200, 5)
    texts = [changed(base, 0.02 + 0.02 * (k % 3), k) for k in range(60)] + [base] + [prose(150, 100 + k) + " " + base[:600] for k in range(40)]
    check(spark, make_docs, texts, [500 + 7 * k % 101 for k in range(len(texts))])


def test_chain(spark, make_docs, prose):
    words = prose(100, 9).split(" ")
    texts = [" ".join([f"w{k}x{j}" for j in range(8 * k)] + words[8 * k :]) for k in range(10)]
    check(spark, make_docs, texts)


def test_ids_null_and_repeated(spark, make_docs, prose):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    found = minhash.near_components(make_docs([a, a, b, b, c, "", None, c + " zz"], [None, 1, 2, 2, 3, None, 4, None])).collect()
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in found), key=str)
    assert rows == sorted([(None, 1, False), (1, 1, True), (2, 2, True), (2, 2, True), (3, 3, True), (None, None, True), (4, 4, True), (None, 3, False)], key=str)
    # rows of one id are compared each by its own text
    found = minhash.near_components(make_docs([a, b, b], [1, 1, 0])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(0, 0, True), (1, 0, False), (1, 1, True)]
    # and only the copied one goes
    kept = minhash.drop_near_duplicates(make_docs([a, b, b, c, c + " zz"], [1, 1, 0, None, None])).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text[:9]) for r in kept) == sorted([(1, a[:9]), (0, b[:9]), (-1, c[:9])])


def test_a_hot_key_is_dealt_in_tiles(spark, make_docs, prose, monkeypatch):
    """Texts that share a long passage, most of them below the threshold, and a few copies of some."""
    monkeypatch.setattr(minhash, "PER_TILE", 8)
    passage = prose(120, 77)
    texts = [passage + " " + prose(60 + k % 7, 900 + k) for k in range(70)]
    texts += [changed(texts[k], 0.01, k) for k in range(0, 70, 3)]
    check(spark, make_docs, texts)


def test_many_short_texts_are_hashed_in_bounded_batches():
    parts = list(shingle_sets(["a b"] * 1000))
    assert max(map(len, parts)) <= 256 and sum(map(len, parts)) == 1000


def test_empty_table_and_filter(spark, make_docs, prose):
    assert minhash.near_components(make_docs([])).count() == 0
    docs = make_docs([prose(40, 1), prose(40, 1), prose(40, 2), None], [5, 4, 3, None])
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 4]


def test_shingle_sets_are_sets_of_words():
    texts = ["", "a", "A b", "a  B", "x y z w v", "a b c d e f", "a b c d e a b c d e a b c d e", None]
    sizes = [len(s) for part in shingle_sets(texts) for s in part]
    assert sizes == [len(shingles(t)) for t in texts]


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    universe = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    bits = minhash.packed_bits(minhash.minima([np.sort(universe[:3000]), np.sort(universe[500:3500])])).view(np.uint64)
    differ = bits[0] ^ bits[1]
    lanes = np.uint64(0x5555555555555555)
    n = sum(int(x).bit_count() for x in ((differ | differ >> np.uint64(1)) & lanes))
    assert abs((1 - n / minhash.HASHES - 0.25) / 0.75 - 2500 / 3500) < 0.06


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 50)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_unfinished_components_are_refused(spark, monkeypatch):
    monkeypatch.setattr(component_rounds, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long"))
