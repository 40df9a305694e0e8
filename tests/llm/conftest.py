import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
#: Extra columns whose names the operators also use.
CLASHING = ["digest", "shard", "block", "runs", "node", "fingerprint", "rank", "key", "h", "words", "held", "size", "line", "pos",
            "n_lines", "emptied", "label", "places", "bucket", "slot", "list", "a", "b", "component_id", "score"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       *[T.StructField(c, T.StringType()) for c in CLASHING]])


def frame(spark, rows):
    """Documents from (doc_id, text[, lang])."""
    return spark.createDataFrame(
        [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1]) if r[1] else None, *["x"] * len(CLASHING))
         for r in rows], SCHEMA)


LONG = " ".join(f"word{i % 977} other{i % 31}." + ("\n" if i % 50 == 0 else "") for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (6, "The same text"), (7, "the SAME text"),
       (8, "the same text"), (9, "ÄÖ é 中文 it's  a\n\n  test 123!"), (10, "one"), (11, "a\x00b   c"), (12, "\n\n")]


@pytest.fixture
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(real):
    return {r["doc_id"]: r["text"] for r in real.select("doc_id", "text").collect()}
