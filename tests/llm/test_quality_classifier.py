import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tidemark.llm import q_quality_classifier
from tidemark.llm import quality_classifier as qc
from tidemark.llm.textops import table


def test_held_out_accuracy(spark):
    folder = f"{TESTDATA}/sf0.1"
    docs, labels = table(spark, folder, "documents").where("doc_id < 4000"), table(spark, folder, "labels").where("doc_id < 4000")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    model = qc.fit(docs, labels.where(~held))
    got = qc.score(docs.join(labels.where(held), "doc_id"), model).select("quality", "quality_content", "quality_metadata", "quality_score").collect()
    y = np.array([r.quality for r in got])
    # sources, languages and lengths say next to nothing about quality here, so metadata gives the larger class
    for column, least in (("quality_content", 0.97), ("quality_metadata", 0.8), ("quality_score", 0.97)):
        p = np.array([r[column] for r in got]) >= 0.5
        assert (p == y).mean() >= least, (column, (p == y).mean())
    keep = np.array([r.quality_score for r in got]) >= 0.5
    assert keep[y == 1].mean() >= 0.98


def test_query_scores_every_document(spark, small):
    got = q_quality_classifier.op2_quality_classifier(spark, small)
    assert got.count() == table(spark, small, "documents").count()
    assert got.where("quality_score IS NULL OR NOT quality_score BETWEEN 0 AND 1").count() == 0


def test_edges(spark):
    rows = [(1, None, None, None, 5.0), (2, "", "s", "en", 5.0), (2, "", "s", "en", 5.0), (None, "word " * 50000, "s", "en", 5.0), (3, "!!! $$$", "s", None, 5.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality_score double")
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert {r.quality_score for r in qc.score(docs, qc.fit(docs, labels)).collect()} == {1.0}
    assert {r.quality_score for r in qc.score(docs, qc.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert qc.score(docs.limit(0), qc.fit(docs.limit(0), labels)).count() == 0


def test_views_are_separate_and_metadata_can_tell(spark):
    """Where sources do tell, the metadata view learns it, whatever the texts; texts alone change nothing in it."""
    import random

    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(3, 30))), f"s{i % 6}", "en", "q") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, q string")
    labels = spark.createDataFrame([(i, int(i % 6 < 3)) for i in range(600) if i // 6 % 2], "doc_id long, quality int")
    model = qc.fit(docs, labels)
    got = {x.doc_id: x for x in qc.score(docs, model).collect()}
    assert all((got[i].quality_score >= 0.5) == (i % 6 < 3) and got[i].q == "q" for i in range(600))
    other = qc.score(docs.withColumn("n_chars", F.length("text")).withColumn("text", F.lit("!")), model).collect()
    assert all(x.quality_metadata == got[x.doc_id].quality_metadata for x in other)


def test_logistic_finds_the_optimum():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 5))
    y = (x @ np.arange(5) + r.normal(size=300) > 0).astype(float)
    m = qc.Logistic(1.0).fit(np.hstack([x, np.ones((300, 1))]), y, np.ones(300))
    p = 1 / (1 + np.exp(-m.odds(x)))
    assert np.abs(x.T @ (p - y) + m.w[:-1]).max() == pytest.approx(0, abs=1e-3)
