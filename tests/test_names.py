"""Functions, losses and calibrators by name: SQL against the column functions and fits they are made from."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marlstone import names
from marlstone.functions import assertion, labels, text
from marlstone.operators import calibrate


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(c, float((i * 7 + c) % 5 < 2 + (i > 20)), round(0.02 + 0.96 * i / 40, 4)) for c in (0, 1) for i in range(41)]
    df = spark.createDataFrame(rows, "cls int, y double, p double")
    df.createOrReplaceTempView("scored_rows")
    names.register_functions(spark)
    return df


def test_losses_and_links(spark, scored):
    z, y, p = labels.logit(F.col("p")), F.col("y"), F.col("p")
    want = scored.select(labels.bce(z, y, 2.0), labels.bce(z, y), labels.focal(z, y), labels.asymmetric(z, y), labels.sigmoid(z * 30), labels.log_sigmoid(-z), labels.sigmoid(z / 1.5), labels.sigmoid(0.5 * z - 1)).collect()
    got = spark.sql("""SELECT bce_loss(logit(p), y, 2.0D), bce_loss(logit(p), y), focal_loss(logit(p), y), asymmetric_loss(logit(p), y), sigmoid(30 * logit(p)), log_sigmoid(-logit(p)),
        temperature_scaled(p, 1.5), platt_scaled(p => p, b => -1.0, a => 0.5) FROM scored_rows""")
    for g, w in zip(got.collect(), want, strict=True):
        assert list(g) == pytest.approx(list(w), rel=1e-12, abs=1e-15)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert spark.sql("SELECT bce_loss(NULL, 1), sigmoid(-800D), sigmoid(800D)").first()[:] == (None, 0.0, 1.0)


def test_policies_and_texts(spark, scored):
    spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (None,)], "raw double").createOrReplaceTempView("raw_rows")
    for uncertain in ("zero", "one", "mask"):
        target, mask = labels.apply_policy(F.col("raw"), uncertain)
        assert spark.sql(f"SELECT target_{uncertain}(raw), mask_{uncertain}(raw) FROM raw_rows").collect() == spark.table("raw_rows").select(target, mask).collect()
    with pytest.raises(Exception, match="not a label state"):
        spark.sql("SELECT target_mask(5D)").collect()
    df = spark.createDataFrame([("It's 3.5 cm. Was it?\nNo - 'quoted' (so).",), ("",), (None,)], "t string")
    df.createOrReplaceTempView("text_rows")
    t = F.col("t")
    want = df.select(text.tokens(t), text.token_count(t), text.sentences(t), text.duplicate_key(t)).collect()
    assert spark.sql("SELECT text_tokens(t), token_count(t), text_sentences(t), duplicate_key(t) FROM text_rows").collect() == want


@pytest.mark.parametrize("lexicon", [None, {"thing": ["edema", "opacit(?:y|ies)"], "size": ["large|small"]}])
def test_mentions_from_sql(spark, lexicon):
    names.register_functions(spark, lexicon)
    rows = [
        (1, "No edema. Large effusion, possible opacity; opacities of edema are not seen but effusions remain.\nEDEMA edema"), (2, "Without change in the effusion. Opacity cannot be excluded; XXXX small pneumothorax"),
        (3, ""), (4, None), (5, "nothing of note"), (6, "edemaedema, (edema) no significant change in edema. Cardiomegaly versus effusion"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.createOrReplaceTempView("mention_docs")
    want = assertion.mentions(docs, lexicon or assertion.CONCEPTS)
    got = spark.sql("SELECT doc_id, inline(m) FROM (SELECT doc_id, concept_mentions(text) AS m FROM mention_docs)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 6


@pytest.mark.parametrize("method", ["temperature", "platt", "isotonic"])
def test_fits_by_name(spark, scored, method):
    names.fit(spark, method, "scored_rows", "fitted")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.table("fitted")) == rows(names.FITTERS[method](calibrate.compact(scored)))
    if method == "platt":
        applied = spark.sql("SELECT cls, avg(platt_scaled(p, a, b)) AS mean, avg(y) AS rate FROM scored_rows JOIN fitted USING (cls) GROUP BY cls").collect()
        assert all(r["mean"] == pytest.approx(r["rate"], abs=1e-6) for r in applied)


def test_unknown_names(spark, scored):
    z, y = F.lit(0.3), F.lit(1.0)
    assert spark.range(1).select(names.loss("focal", gamma=1.0, alpha=0.25)(z, y)).first() == spark.range(1).select(labels.focal(z, y, 1.0, 0.25)).first()
    for call in (lambda: names.loss("hinge"), lambda: names.loss("bce", gamma=2.0), lambda: names.fit(spark, "beta", "scored_rows", "x")):
        with pytest.raises(ValueError, match="unknown|no option"):
            call()
