import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), StructField("k", StringType()), StructField("row", StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text); it has columns whose names operators use inside."""

    def make(pairs):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", None) for i, t in pairs], DOCS)

    return make


@pytest.fixture(scope="session")
def texts():
    """Small corpus with repeats, near copies, ties, empty, null and long texts, odd white space and other scripts."""
    import random

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(40)] + ["é", "Straße", "日本", "don't", "x<y", "12", "!!", "naïve"]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 60, 200]))) for _ in range(30)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    out = base + base[:4] + [b + " tail" for b in base[4:8]] + [f"{b[:30]}\n{passage}\t {b[30:60]}" for b in base[8:14]]
    out += ["", None, "   ", "\n\t", "a", passage, passage, "aa " * 300, "aa " * 301, " ".join(base) * 3]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
