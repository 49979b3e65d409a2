from __future__ import annotations

import pytest
from made import made_texts

#: Columns whose names the operators use inside.
CLASHING = "doc_id long, text string, source string, lang string, n_tokens int, key string, component string, row string, version int, rate double, __copies int, body string"


@pytest.fixture(scope="session")
def nasty(spark):
    """Texts of made_texts with ids in another order, a null id, sources with null, columns with clashing names."""
    rows, texts = [], made_texts()
    for k, text in enumerate(texts):
        doc_id = None if k == 12 else (k * 37) % 1009
        rows.append((doc_id, text, None if k % 5 == 0 else f"s{'a' if k % 2 else k % 3}", None, k, "k", None, "r", 1, 0.5, 3, "b"))
    return spark.createDataFrame(rows, CLASHING).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="session")
def rows_of(nasty):
    """doc_id and text of every row."""
    return [(r["doc_id"], r["text"]) for r in nasty.collect()]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
