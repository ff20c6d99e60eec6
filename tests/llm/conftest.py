import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, n string, _bucket string, a int, score string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and extra columns with names in use."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(40000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away from it all day long until night falls over the hill", "en", "s1"),
        (2, "the quick brown fox jumps over the lazy dog and runs away from it all day long until night falls over the hill", "en", "s1"),
        (3, None, None, None), (4, "", "en", "s2"), (5, " \t\n ", "en", "s2"), (6, "one", None, "s1"), (7, "one", "de", None), (8, long, "en", "s3"), (9, long, "en", "s3"),
        (None, "no id here but a text that says something", "en", "s1"), (10, "é漢字 𠮷 naïve\x00nul", "fr", "s2"), (11, "repeat " * 100, "en", "s1"), (11, "repeat " * 100, "en", "s1"), (12, "MIT License and the Apache License, CC BY", "en", "s1"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", None, "b", 1, None) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"
