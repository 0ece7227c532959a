import os
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep)


CLASHING = ", ".join(f"{c} string" for c in (
    "source", "lang", "score", "size", "order", "row", "n", "set", "key", "spans", "sources", "target", "taken", "count", "label"))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names the operators use."""
    line = "the same line of seven words again\n"
    texts = [(1, "a b c d e f g h"), (2, None), (3, ""), (4, " \n\t "), (None, "a b c d e f g h"), (None, None),
             (5, line * 3000), (6, "x" * 100_000), (7, "é漢\U0001F600 " * 50), (1, "a b c d e f g h"), (8, "short")]
    rows = [(i, t, *["x" if n % 2 else None] * 15) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
