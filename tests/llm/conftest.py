from __future__ import annotations

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that the operators use inside; a table may have them too.
CLASHES = ("row", "h", "maybe", "dedup_hash", "block", "keys", "n", "near_row", "quality_row", "bloom_block", "hit", "site", "bits")
COPY = "One two three four five six seven eight nine ten eleven twelve."
EDGE = [
    (1, None), (2, ""), (3, " \t\n "), (4, COPY), (5, COPY.replace(" ", "  \n")), (5, COPY.replace(" ", "  \n")), (None, COPY), (6, "é ñ ß ü"),
    (7, "a b c"), (8, "word " * 40_000), (9, " ".join(f"w{i}" for i in range(300))), (10, " ".join(f"w{i}" for i in range(303))),
    (11, "!!! ### ???"), (12, "x"), (12, "x"), (13, " nbsp wide"), (14, "<|endoftext|> token = \"abcdef1234567890abcdef12\""),
]


@pytest.fixture(scope="session")
def edge(spark) -> DataFrame:
    rows = [(d, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else f"https://h{i % 2}.example/p{i % 4}/x", None if t is None else len(t)) for i, (d, t) in enumerate(EDGE)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit(c) for c in CLASHES})


@pytest.fixture(scope="session")
def plain(spark, edge, tmp_path_factory) -> DataFrame:
    """The same, written: its rows come in the same order each time."""
    path = str(tmp_path_factory.mktemp("edge") / "docs")
    edge.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, edge) -> DataFrame:
    return spark.createDataFrame([], edge.schema)
