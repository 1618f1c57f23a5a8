import pytest

ODD_TEXTS = [None, "", " \t\n", "a", "one two", "Äpfel € naïve 日本語 \U0001f600", "word " * 30_000, "1234 !!! ???", "mail a.b@c.example.com now"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, odd and very long texts, a repeated row, and columns named like results."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 2 else "src", 1, 0.5, 3, -1, "x") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], (None, "null id", "en", "src", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, fp long, lang_pred string")


@pytest.fixture(scope="session")
def none_at_all(odd):
    return odd.limit(0)
