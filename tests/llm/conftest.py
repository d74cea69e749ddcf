import pytest

from .rows import DOCS, words


@pytest.fixture(scope="module")
def docs(spark):
    base, other = words(120, 1), words(150, 2)
    edited = " ".join("zz" if i == 60 else w for i, w in enumerate(base.split()))
    texts = [base, base, edited, other, other[:300] + " " + words(40, 3), None, "", "x", "é" * 60, "é" * 60 + "q", "a" * 500, " \n\t ", base + " " + other]
    rows = [(i, t, None if i == 3 else "en", None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t), "k", 7) for i, t in enumerate(texts)]
    rows += [rows[0], (None, base, "en", "s1", 1, "k", 7)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
