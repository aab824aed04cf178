import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("shard", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("uid", T.StringType()),
    ]
)


def prose(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Null in any column, empty and very long texts, ties, repeated rows."""
    long = "\n".join(prose(k, 60) for k in range(400))
    texts = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, None), (3, ""), (None, "delta"), (None, None), (4, long), (5, long), (6, "x" * 30000), (7, " \n\t\n ")]
    return [(i, t, None, "s", "k", None) for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with doc_id and text, and columns whose names the operators use too."""

    def make(rows):
        full = [r if len(r) == 6 else (*r, 0, "s", "k", "u") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
