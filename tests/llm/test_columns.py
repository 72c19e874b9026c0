"""Every operator and stage on rows with odd values and columns of odd names and types."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoweave.llm import common, hnsw, language, packing, pii, quality, secrets, sentencepiece, sentences, simhash, token_files
from tests.llm.conftest import ODD

WHOLE = (quality.keep_good, simhash.keep_one, sentences.drop_repeated, pii.redact)
OPERATORS = (
    secrets.secrets, token_files.round_trip, packing.best_fit_packing, quality.quality, pii.personal_data, language.languages,
    sentences.sentence_dedup, simhash.near_duplicates, sentencepiece.encode,
)


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_columns_that_differ_in_case(twins, odd, operator):
    key = "piece = 0" if operator is packing.best_fit_packing else "TRUE"
    assert operator(twins).where(key).count() == len(ODD) == operator(odd).where(key).count()


@pytest.mark.parametrize("stage", WHOLE, ids=lambda f: f.__name__)
def test_stages_keep_columns_of_any_name(twins, odd, stage):
    for df in (twins, odd):
        out = stage(df)
        assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
        assert out.count() == (stage(df).count())


def test_what_stays_of_the_odd_rows(odd):
    assert quality.keep_good(odd).count() == 0
    kept = simhash.keep_one(odd)
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()).count(4) == 1  # two rows agree
    assert kept.where("doc_id IS NULL").count() == 1
    redacted = {r.doc_id: r.text for r in pii.redact(odd).collect()}
    assert redacted[2] is None and redacted[1] == "" and redacted[4] == "one"


def test_the_pipeline_on_odd_rows(spark, odd, empty):
    for start in (odd, odd.union(odd), empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if stage is not corpus_pipeline.packed:
                assert out.columns == docs.columns
            docs = common.stored(out, f"odd-{name}")
        assert docs.where("offset < 0 OR length < 1 OR length > 2048").count() == 0
        if start is empty:
            assert docs.count() == 0


def test_vectors_with_odd_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], "x", {"a": "b"}) for i in range(1, 30)], "vec_id long, embedding array<double>, VEC_ID2 string, tags map<string,string>").withColumn("a.b", F.lit(1))
    df = df.withColumnRenamed("VEC_ID2", "VEC_ID")
    found = hnsw.nearest(df, df.where("tags['a'] = 'b'"), 3)
    assert found.count() == 3 * 29 and found.where("rank = 1 AND query_id < 29 AND vec_id <> 29").count() == 0


def test_intermediate_tables_go(spark, odd):
    import glob
    import os

    folder = f"{common.shared_folder(spark)}/geoweave/{spark.sparkContext.applicationId}".removeprefix("file:").replace("//", "/")
    before = set(glob.glob(f"{folder}/*"))
    out = common.settled(lambda: sentences.drop_repeated(odd), "kept")
    left = set(glob.glob(f"{folder}/*")) - before
    assert [os.path.basename(p).split("-")[0] for p in left] == ["kept"] and out.count() == len(ODD)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()

    with pytest.raises(RuntimeError):
        common.shared_folder(Session())
