import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score double, h string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, and columns with clashing names."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3
    rows = [
        (1, base, "en", "s0", 1, "x", 1.0, "h"), (1, base, "en", "s0", 1, "x", 1.0, "h"), (2, base, "en", "s1", 2, None, None, None),
        (3, base.replace(" ", "\n\t "), None, None, None, "x", 2.0, "h"), (4, "", "en", "s0", 0, "y", 0.0, ""), (5, None, "en", "s0", None, "y", 0.0, ""),
        (6, " \t\n", "en", None, 3, None, None, None), (None, "no id here at all", "fr", "s2", 4, None, None, None), (None, None, None, None, None, None, None, None),
        (7, "one", "fr", "s2", 3, None, None, None), (8, "Mixed CASE words Été ß \U0001f600 # $ %", "de", "s3", 9, None, None, None),
        (9, " ".join(f"w{i}" for i in range(30_000)), "en", "s4", 1, None, None, None), (10, "same line\nsame line\n\nsame line \nother", "en", "s4", 1, None, None, None),
        (11, "de de de de de de " * 20, "es", "s4", 1, None, None, None), (12, "de de de de de de " * 20, "es", "s4", 1, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
