import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


#: Nulls in every column, empty and odd texts, repeated rows, and columns whose names clash with those inside the operators.
ODD = [
    (1, "", "en", "a"),
    (2, None, None, None),
    (None, "A text without an id. It has two sentences, and some words.", "en", None),
    (3, " \t\n\x0b\x0c\r ", "de", "b"),
    (4, "one", "en", "b"),
    (4, "one", "en", "b"),
    (5, "Ünïcödé 漢字 😀 <s> </w> ▁   x́ <|endoftext|> İ K", "fr", "c"),
    (6, "word " * 30000, "en", "c"),
    (7, "x" * 200000, "en", "c"),
    (8, "12345" * 5000 + "." + "@" * 50 + "a." * 500 + "+" + "1 " * 300 + "%41" * 200, "en", "c"),
    (9, "\n".join(["same line here", "", "same line here", "  "]) * 3, "es", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    for name in ("fp", "key", "hash", "place", "places", "component_id", "ids", "kept", "lot", "node", "root"):
        df = df.withColumn(name, F.lit("extra"))
    # Names with dots and of other case, and types that can't be compared.
    df = df.withColumn("a.b", F.lit("extra")).withColumn("_0", F.lit("extra")).withColumn("tags", F.create_map(F.lit("k"), F.col("lang")))
    return df.withColumn("parts", F.array(F.struct(F.lit(1).alias("x.y"), F.col("source").alias("z"))))


@pytest.fixture(scope="session")
def twins(odd):
    """The odd rows with columns whose names differ from those needed in case only."""
    return odd.toDF(*[{"key": "TEXT", "hash": "Doc_Id", "place": "N_CHARS"}.get(c, c) for c in odd.columns])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", n_chars long")
