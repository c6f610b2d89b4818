"""The pipeline's stages, each against a plain version of what it should keep."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

pytest.importorskip("marlstone.llm")
import corpus_pipeline as P
from marlstone.llm import jaccard, language, registry, toxicity
from marlstone.llm.common import materialise

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.withColumn("toxic", F.lit("kept")).withColumn("lang_pred", F.lit("kept")).unionByName(spark.createDataFrame([(-1, None, None, None, None, "kept", "kept"), (-2, "12 34", "en", "s", 5, "kept", "kept")], "doc_id long, text string, lang string, source string, n_chars long, toxic string, lang_pred string"))
    clean = materialise(P.drop_toxic(spark, extra, SF), "t1")
    assert clean.columns == extra.columns and clean.filter("toxic <> 'kept'").count() == 0
    model = toxicity.train(extra.drop("toxic"), spark.read.parquet(f"{SF}/labels.parquet"))
    judged = {r["doc_id"] for r in toxicity.judge(docs, model).filter("not toxic").collect()}
    assert {r["doc_id"] for r in clean.filter("doc_id >= 0").collect()} == judged and clean.filter("doc_id < 0").count() == 2
    spoken = materialise(P.keep_languages(spark, clean, SF), "t2")
    assert {r["doc_id"] for r in clean.select("doc_id").subtract(spoken.select("doc_id")).collect()} == {-1, -2}
    single = materialise(P.drop_near_duplicates(spark, spoken, SF), "t3")
    classes = jaccard.jaccard_classes(spoken)
    want = {r["component_id"] for r in classes.select("component_id").distinct().collect()}
    assert sorted(r["doc_id"] for r in single.select("doc_id").collect()) == sorted(want)
    packed = P.best_fit_packing(spark, single, SF)
    assert packed.select("doc_id").distinct().count() == len(want)


def test_language_stage_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "123", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in P.keep_languages(spark, df, SF).collect()] == [1]
    assert language.NONE == "und"


def test_registered():
    assert [k for k in sorted(registry.QUERIES, key=lambda k: int(k[2:].split("_")[0]))] and {int(k[2:].split("_")[0]) for k in registry.QUERIES} == set(range(1, 14))
    assert [n for n, _ in P.STAGES] == ["toxicity", "language ID", "n-gram Jaccard join", "best-fit packing"]
