import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for themselves or for results
    T.StructField("kept", T.StringType()), T.StructField("rid", T.StringType()), T.StructField("_rid", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("shard", T.StringType()), T.StructField("rate", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("class_id", T.StringType()),
    T.StructField("a.b", T.StringType()),
])

LONG = " ".join(f"word{i % 977} of the tale{i % 31}" for i in range(9_000))
TEXTS = [
    None, "", " ", "a", "the", "Same  text\there and there", "Same text here and there", "same text here and there", "mail me: x.y@z.org or +1 (988) 555-2485, 10.0.0.1",
    LONG, LONG, "1" * 5_000, "日本語のテキスト、空白なし。" * 50, "<|endoftext|> and </s>[INST]\\ x", "4337166598464399 4337-1665-9846-4399 999.1.1.1", "😀 tail \n\n\n end ", "é à ü ñ " * 40,
]


def rows(texts=TEXTS):
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, "en" if i % 2 else None, "big" if i % 3 else None, len(t or ""), *["clash"] * 9))
    return [*out, out[5], out[9], (None, "no id", None, "big", 5, *[None] * 9), (None, None, None, None, None, *[None] * 9)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing column names."""
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
