import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum " * 3000 + "x" * 2000
BASE = " ".join(f"word{i}" for i in range(120))
NEAR = BASE.replace("word7 ", "other ").replace("word60 ", "")


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with NULLs, repeats, ties, long texts and clashing columns."""
    rows = [
        (1, BASE, "en", "a"), (2, BASE, "en", "a"), (2, BASE, "en", "a"), (3, NEAR, "en", None),
        (4, None, None, "a"), (5, "", "de", "b"), (None, "alone without an id", None, None),
        (None, None, None, None), (6, LONG, "en", "b"), (7, "  \t\n", "fr", "c"),
        (8, "Released under the MIT License. mail: a@b.org", "en", "c"),
        (9, BASE.replace(" ", "\n"), "en", "a"), (10, "one two", "en", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ("row", "key", "node", "words", "kept", "whole", "_maybe", "size", "bin_lang", "n_words", "base", "k1")
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)]).cache()


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, None, None), (None, 1, 1), (8, 0, 1), (99, 1, 0), (10, 0, 0), (9, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    items = [(1, " ".join(f"word{i}" for i in range(20, 60))), (2, None), (3, ""), (4, "zeta eta theta iota kappa"),
             (5, " ".join(f"word{i}" for i in range(20, 60)))]
    return spark.createDataFrame(items, "item_id long, text string")
