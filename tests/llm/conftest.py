"""Documents with every odd case, for the operators of this subpackage."""

import pytest

#: One long text, nulls, empty and blank texts, repeated rows, a null key.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away"), (2, "The quick brown fox jumps over the lazy dog and runs away"), (3, None), (4, ""), (5, " \t\n "),
    (6, "one"), (7, "zwei Wörter"), (8, "word " * 30_000), (9, "Ünïcödé 中文字符 \U0001f600 \x00 text"), (10, "one"), (10, "one"), (None, "a row without a key"), (11, "the QUICK brown fox jumps over the lazy dog and runs away today"),
]
SHAPE = "doc_id long, text string"


@pytest.fixture
def odd(spark):
    """The odd documents with columns whose names clash with usual inner ones."""
    rows = [(*r, "en", "src_1", 7, 1.5, "x") for r in ODD]
    return spark.createDataFrame(rows, SHAPE + ", lang string, source string, n long, score double, node string").repartition(3)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SHAPE + ", lang string, source string")
