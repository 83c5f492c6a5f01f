import random
import string

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, digest string, rep long, slice int, id long, label int, features string, block int, length long"


def rows_of(texts, ids=None, source="s"):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", source, len(t or ""), 7, 0.5, "x", 1, 2, 3, 1, "f", 4, 5) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names the operators use inside."""
    return lambda texts, ids=None, source="s": spark.createDataFrame(rows_of(texts, ids, source), SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """Made-up prose: (number of words, seed) to text."""

    def make(n, seed):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(1, 9))) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_texts(prose):
    """Null, empty, white space, other scripts, control characters, special strings, repeats and a very long text."""
    return [
        None, "", " ", "\n\n", "a", "A b", "a  B", "  two  spaces ", "tab\tand\x0bmore\x00nul", "日本語 テスト 😀", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "▁mark ▁",
        "it's 12 o'clock!!", "a" * 5000, prose(30000, 1), prose(50, 2), prose(50, 2), "line one\nline two\r\nline three", "é" * 300, "trailing \n ", " nbsp  wide",
    ]
