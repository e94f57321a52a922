from __future__ import annotations

import pytest

LONG = "word " * 30_000 + "x" * 5000
TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "The quick brown fox jumps over the lazy dog.", "  leading and trailing  \n\n tabs\t\there \r\n", "", None, "a", "naïve café – 東京 🎉 é", "it's we'll THEY'RE 123 4567 <|endoftext|> !!??",
    "\x1cunit\x85sep\xa0nbsp", LONG, "same line of words that repeats here\nsecond line\nthird one", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab", " ", "\n",
    "hello <|endoftext|> x", "inside<|endoftext|>word <|startoftext|><|startoftext|>", "<|ENDOFTEXT|> T\u0308 J\u030c",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows and ids, and columns of clashing names."""
    rows = [(i if i != 6 else None, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", "s1"][i % 4], None if i % 5 == 0 else len(t or ""), "own", i, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[9], (3, "another text under an id that exists", "en", "s1", 5, "own", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, size int, k string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
