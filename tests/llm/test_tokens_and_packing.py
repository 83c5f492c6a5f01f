import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer as Library

from tierloom.llm import packing, token_counts, unigram
from tierloom.llm.byte_bpe import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def spaced(seed, n):
    """Texts of few characters, where white space and special strings meet in all ways."""
    rng = np.random.default_rng(seed)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "'s", "12", "!?", "é", " ", "　", "<|endoftext|>", "<|", "日", "\x1c", "\r\n"]
    return ["".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(n)]


def test_ids_are_the_library_s(library, odd_texts):
    texts = [t for t in odd_texts if t is not None] + spaced(3, 3000)
    ours = Tokenizer(PATH)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == ids, repr(text)
        assert ours.count(text) == len(ids)


def test_cache_stays_bounded_and_right(library, prose):
    ours = Tokenizer(PATH)
    ours.counts.most = 50
    for k in range(20):
        text = prose(200, k)
        assert ours.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        assert len(ours.counts) <= 50


def test_count_tokens(make_docs, odd_texts, library):
    texts = odd_texts + odd_texts
    found = token_counts.count_tokens(make_docs(texts)).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)
    assert token_counts.count_tokens(make_docs([])).count() == 0
    assert token_counts.count_tokens(make_docs([None, "a"], [None, None])).count() == 2


def test_long_units_of_rare_scripts(make_docs, library):
    text = "a " + "".join(map(chr, range(0x12000, 0x12040)))
    assert len(library.encode(text).ids) > 256
    found = token_counts.count_tokens(make_docs([text] * 8 + ["often often often"])).collect()
    assert {r.n_tokens for r in found if r.doc_id < 8} == {len(library.encode(text).ids)}


def best_fit_decreasing(lengths, window):
    """One piece at a time; the sorted remaining capacities of the windows."""
    windows = []
    for n in sorted(lengths, reverse=True):
        room = [w for w in windows if w >= n]
        if room:
            windows.remove(min(room))
            windows.append(min(room) - n)
        else:
            windows.append(window - n)
    return sorted(windows)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.choice([8, 20, 64]))
    lengths = rng.integers(1, window + 1, int(rng.integers(1, 300))).tolist() + [int(rng.integers(1, window))] * int(rng.integers(0, 200))
    histogram = {n: lengths.count(n) for n in set(lengths)}
    used, seen = defaultdict(list), defaultdict(int)
    runs = packing.plan_runs(histogram, window)
    for n in histogram:
        own = [r[1:] for r in runs if r[0] == n]
        assert [r[0] for r in own] == sorted(r[0] for r in own)
        starts = [r[0] for r in own]
        for rank in range(histogram[n]):
            first_rank, first, each, base = own[np.searchsorted(starts, rank, side="right") - 1]
            k = rank - first_rank
            used[first + k // each].append((base + k % each * n, n))
            seen[n] += 1
    assert seen == histogram and sorted(used) == list(range(len(used)))
    left = []
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        left.append(window - at)
    assert sorted(left) == best_fit_decreasing(lengths, window)


def test_capacity_tree():
    tree = packing.CapacityTree(10)
    for c in (2, 5, 9):
        tree.set(c, True)
    assert [tree.least_from(i) for i in range(11)] == [2, 2, 2, 5, 5, 5, 9, 9, 9, 9, None]
    tree.set(5, False)
    assert tree.least_from(3) == 9


@pytest.mark.parametrize("per_block", [8192, 3])
def test_packing(make_docs, odd_texts, library, per_block):
    texts = odd_texts + ["hot text"] * 300 + [None] * 20
    ids = [i if i < 300 else 300 for i in range(len(texts))]  # some ids repeat
    found = packing.pack(make_docs(texts, ids), per_block=per_block).collect()
    tokens = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    wanted = sorted((i, s, min(1024, len(t) - s), zlib.crc32(np.array(t[s : s + 1024], "<u4").tobytes()), len(t)) for i, t in zip(ids, tokens, strict=True) for s in range(0, len(t), 1024))
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == wanted
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(sequences) == len(best_fit_decreasing([r.length for r in found], 1024))
    assert packing.pack(make_docs([])).count() == 0


@pytest.fixture(scope="module")
def model():
    return unigram.load(public_tokenizers.path(unigram.MODEL))


@pytest.fixture(scope="module")
def as_unigram():
    """The library on the same pieces and scores, with the model's kind set to unigram."""
    raw = bytearray(open(public_tokenizers.path(unigram.MODEL), "rb").read())
    kind = raw.find(b"tok_v0\x18\x02") + 7
    raw[kind] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(raw))


def test_unigram_has_the_score_of_the_library_s_best(model, as_unigram, prose):
    """Its list of best cuts is exact; its plain encode can be worse ("the" as one piece of -13 instead of two of -8)."""
    # without characters that no piece has, whose scores are too large for its floats
    texts = [w for k in range(8) for w in prose(40, k).replace("\n", " ").split()] + ["a", "the cat", "on the other side", "naïve café"]
    total = lambda ids: sum(as_unigram.get_score(int(i)) for i in ids)
    for text, ids in zip(texts, model.encode_batch(texts), strict=True):
        assert total(np.frombuffer(ids, "<u4")) == total(as_unigram.nbest_encode(text, nbest_size=2)[0]), text


def plain_viterbi(model, text):
    """The best sum over the whole marked text, unit borders not looked at."""
    marked = unigram.MARK + text.replace(" ", unigram.MARK) if text else ""
    score = dict(zip([model.pieces[i] for i in model.real], model.scores, strict=True))
    best, back = [0.0] + [-np.inf] * len(marked), [0] * (len(marked) + 1)
    for i in range(len(marked)):
        for j in range(i + 1, min(len(marked), i + model.longest) + 1):
            s = score.get(marked[i:j], model.unknown if j == i + 1 else None)
            if s is not None and best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, i
    pieces, j = [], len(marked)
    while j:
        pieces.append(marked[back[j] : j])
        j = back[j]
    out = []
    for p in reversed(pieces):
        out += [model.pieces.index(p)] if p in score else [model.bytes_at[b] for b in p.encode()]
    return out


def test_unigram_against_plain_viterbi(model, prose):
    texts = ["", " ", "  x", "a  b   c ", "é😀日本 ", "\x00 \x00a", "▁▁ x▁", "a" * 60, "\n\na b", prose(30, 1), *spaced(5, 60)]
    for text, ids in zip(texts, model.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain_viterbi(model, text), repr(text)


def test_double_array_holds_all_keys_and_no_others():
    rng = np.random.default_rng(2)
    keys = list({tuple(rng.integers(1, 30, rng.integers(1, 6)).tolist()) for _ in range(3000)})
    trie = unigram.DoubleArray(keys, 30)

    def value(key):
        state = np.zeros(1, np.int32)
        for c in key:
            state = trie.step(state, np.array([c]))
            if state[0] < 0:
                return -1
        return trie.value[state[0]]

    assert [value(k) for k in keys] == list(range(len(keys)))
    known = set(keys)
    for _ in range(2000):
        key = tuple(rng.integers(1, 31, rng.integers(1, 7)).tolist())
        assert (value(key) >= 0) == (key in known)


def test_round_trip(make_docs, odd_texts):
    texts = odd_texts + odd_texts
    docs = make_docs(texts)
    found = unigram.round_trip(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.same_text == (unigram.MARK not in (texts[r.doc_id] or ""))
    back = {r.doc_id: r.text for r in unigram.decode(unigram.encode(docs)).collect()}
    assert back == {i: (t or "").replace(unigram.MARK, " ") for i, t in enumerate(texts)}
    assert unigram.round_trip(make_docs([])).count() == 0
    assert unigram.round_trip(make_docs(["x"], [None])).first().same_text
