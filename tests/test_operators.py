"""Small inputs with values worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from marlstone.functions import agents, assertion, labels, reports, text
from marlstone.operators import association, calibrate, classify, graph, images, relational, resample, retrieval, splits, textgen
from marlstone.sources import files
from marlstone.streaming import incremental


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_multi_label_measures(spark):
    ids = spark.createDataFrame([(i,) for i in range(4)], "id long")
    m = spark.createDataFrame([(0, "A"), (0, "B"), (1, "A"), (2, "B"), (2, "C")], "id long, label string")
    c = association.cardinality(m, None, ids).first()
    assert c["cardinality"] == 1.25 and c["density"] == round(5 / 12, 6)
    assert {r["labels_per_row"]: r["n"] for r in association.positives_per_row(m, ids).collect()} == {0: 1, 1: 1, 2: 2}
    p = {(r["a"], r["b"]): r for r in association.pairwise(m, ids).collect()}
    assert p["A", "B"]["jaccard"] == round(1 / 3, 6) and p["A", "B"]["p_b_given_a"] == 0.5 and p["C", "B"]["p_b_given_a"] == 1 and p["A", "B"]["phi"] == 0
    full = association.pairwise(m.unionByName(ids.withColumn("label", F.lit("D"))), ids).filter("a = 'A' and b = 'D'").first()
    assert full["phi"] is None


def test_label_policy(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (None,)], "raw double")
    t, m = labels.apply_policy(F.col("raw"), "mask", "zero")
    assert [tuple(r) for r in df.select(t, m).collect()] == [(1, 1), (0, 1), (0, 0), (0, 1)]
    with pytest.raises(Exception, match="not a label state"):
        spark.createDataFrame([(2.0,)], "raw double").select(t).collect()
    with pytest.raises(ValueError):
        labels.apply_policy(F.col("raw"), "half")


@pytest.mark.parametrize(("policy", "weight"), [(("mask", "mask"), 1.0), (("mask", "zero"), 3.0), (("one", "zero"), 1.0)])
def test_pos_weight(spark, policy, weight):
    df = spark.createDataFrame([("l", x) for x in (1.0, 0.0, -1.0, -1.0, None, None)], "label string, raw double")
    t, m = labels.apply_policy(F.col("raw"), *policy)
    assert association.pos_weight(df.select("label", t.alias("target"), m.alias("mask"))).first()["pos_weight"] == weight


def points(spark, y, p, w=None):
    return spark.createDataFrame([(0, a, b, c) for a, b, c in zip(y, p, w or [1] * len(y))], "cls int, y int, p double, w int")


def test_thresholds(spark):
    c = classify.candidates(points(spark, [1, 1, 1, 0, 0, 0], [0.9, 0.8, 0.4, 0.6, 0.3, 0.1]), ["cls"])
    y = classify.youden(c, ["cls"]).first()
    assert y["threshold"] == 0.4 and y["n_tied"] == 2 and math.isclose(y["j"], 2 / 3)
    f = classify.f1_optimal(c, ["cls"]).first()
    assert f["threshold"] == 0.4 and math.isclose(f["f1"], 6 / 7)
    assert classify.youden(c, ["cls"], legacy=True).first()["threshold"] == 0.8
    assert classify.f1_optimal(classify.candidates(points(spark, [1, 0, 0, 1], [0.9, 0.8, 0.7, 0.6]), ["cls"]), ["cls"]).first()["threshold"] == 0.6
    assert classify.youden(classify.candidates(points(spark, [1, 0, 1, 0], [0.5] * 4), ["cls"]), ["cls"]).first()["threshold"] is None
    rows = sorted(classify.candidates(points(spark, [1, 1, 0, 0], [0.9, 0.8, 0.8, 0.1]), ["cls"]).collect(), key=lambda r: -r["p"])
    assert [(r["p"], r["tp"], r["fp"]) for r in rows] == [(0.9, 1, 0), (0.8, 2, 1), (0.1, 2, 2)]


def test_weights_equal_replication(spark):
    y, p, w = [1, 0, 1, 0, 1], [0.9, 0.7, 0.6, 0.4, 0.2], [2, 1, 0, 3, 1]
    a = classify.candidates(points(spark, y, p, w).filter("w > 0"), ["cls"], F.col("w"))
    rep = [(a_, b_) for a_, b_, n in zip(y, p, w) for _ in range(n)]
    b = classify.candidates(points(spark, [x for x, _ in rep], [x for _, x in rep]), ["cls"])
    for f in (classify.youden, classify.f1_optimal, classify.auc):
        assert f(a, ["cls"]).first()[1] == f(b, ["cls"]).first()[1]


def test_undefined_metrics_are_null(spark):
    df = spark.createDataFrame([(0, 0, False)] * 5 + [(0, 1, False)] * 3, "cls int, y int, d boolean")
    r = classify.confusion(df, ["cls"], F.col("d")).first()
    assert r["precision"] is None and r["recall"] == 0 and r["f1"] == 0
    r = classify.confusion(df.filter("y = 0"), ["cls"], F.col("d")).first()
    assert r["precision"] is None and r["recall"] is None and r["f1"] is None
    assert classify.auc(classify.candidates(points(spark, [1, 1], [0.2, 0.4]), ["cls"]), ["cls"]).first()["auroc"] is None


def test_losses(spark):
    z, y = F.col("z"), F.col("y")
    df = spark.createDataFrame([(0.3, 1.0), (-2.0, 0.0), (50.0, 0.0)], "z double, y double")
    for a, b in df.select(labels.bce(z, y), labels.focal(z, y, gamma=0.0)).collect():
        assert math.isclose(a, b)
    for a, b in df.select(labels.bce(z, y), labels.asymmetric(z, y, 0.0, 0.0, 0.0)).collect():
        assert math.isclose(a, b)
    assert df.agg(labels.masked_mean(z, F.lit(0))).first()[0] == 0


def test_normal_rule_and_routing(spark):
    rows = spark.createDataFrame([(1, "nf", True), (1, "bad", True), (2, "nf", True), (2, "device", True), (3, "bad", True), (3, "nf", False)], "id int, label string, decision boolean")
    out = {(r["id"], r["label"]): r["final"] for r in labels.suppress_normal(rows, "nf", ["bad"]).collect()}
    assert out == {(1, "nf"): False, (1, "bad"): True, (2, "nf"): True, (2, "device"): True, (3, "bad"): True, (3, "nf"): False}
    df = spark.createDataFrame([([], True), (["device"], True), (["device"], False), ([], False)], "p array<string>, n boolean")
    assert [r[0] for r in df.select(labels.route(F.col("p"), F.col("n"), ["device"])).collect()] == ["normal", "normal", "abnormal", "indeterminate"]


def test_bm25_order(spark):
    docs = spark.createDataFrame([(1, "no pleural effusion"), (2, "pleural effusion is present"), (3, "cardiomegaly"), (4, "pleural effusion is present")], "id long, text string")
    toks = text.tokens(F.col("text"))
    q = spark.createDataFrame([(0, "pleural"), (0, "effusion")], "query long, token string")
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size(toks)).alias("avgdl"))
    top = retrieval.top_k(retrieval.bm25(retrieval.postings(docs, toks, "id"), q, n), 4)
    full = retrieval.fill_zero(top, q.select("query"), docs.select("id"), 4).orderBy("rank").collect()
    assert [r["id"] for r in full] == [1, 2, 4, 3] and full[1]["score"] == full[2]["score"] and full[3]["score"] == 0


def test_rank_fusion(spark):
    rank = lambda names: spark.createDataFrame([(0, ord(x), i) for i, x in enumerate(names, 1)], "query long, id long, rank long")
    top = retrieval.top_k(retrieval.rrf(rank("abc"), rank("bad")), 10).orderBy("rank").collect()
    assert [chr(r["id"]) for r in top] == ["a", "b", "c", "d"] and math.isclose(top[0]["score"], 1 / 61 + 1 / 62)
    assert retrieval.rrf(rank("abc"), rank("bad"), depth=2).count() == 2


def test_mmr(spark):
    pool = spark.createDataFrame([(0, 0, 1, 1.0, [1.0, 0.0]), (0, 1, 2, 0.95, [1.0, 0.0]), (0, 2, 3, 0.9, [0.0, 1.0]), (0, 3, 4, 0.5, [0.6, 0.8])], "query long, id long, rank long, score double, v array<double>")
    order = lambda lam, k: [r["id"] for r in retrieval.mmr(pool, lam, k).orderBy("rank").collect()]
    assert order(1.0, 4) == [0, 1, 2, 3] and order(0.5, 2) == [0, 2] and order(0.5, 4)[:2] == [0, 2]


def test_ndcg(spark):
    ideal = spark.createDataFrame([(0, 1.0, 1), (0, 0.5, 1), (0, 0.0, 2), (1, 0.0, 4)], "query long, gain double, n long")
    ranked = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.5), (1, 1, 0.0)], "query long, rank long, gain double")
    out = {r["query"]: r["ndcg"] for r in retrieval.ndcg(ranked, ideal, 10).collect()}
    assert math.isclose(out[0], 1.0) and out[1] is None


def test_section_cleaning(spark):
    clean = lambda x: one(spark, text.clean_section(F.col("t")), t=x)
    assert clean("<b>Findings:</b> Heart   size XXXX normal .") == "Heart size normal."
    assert clean("Impression: clear lungs ,  stable.") == "clear lungs, stable."
    assert clean("None.") == "" and clean("12 3") == "" and spark.sql("select cast(null as string) t").select(text.clean_section(F.col("t"))).first()[0] == ""
    r = one(spark, text.retrieval_text(F.col("a"), F.col("b")), a="Same text.", b="same TEXT")
    assert r["source"] == "both_identical" and r["text"] == "Same text."


MENTIONS = [
    ("There is cardiomegaly.", "positive"), ("No cardiomegaly.", "negated"), ("Possible cardiomegaly.", "uncertain"), ("No change in cardiomegaly.", "positive"),
    ("Cardiomegaly is not seen.", "negated"), ("No effusion but cardiomegaly.", "positive"), ("Cardiomegaly cannot be excluded.", "uncertain"), ("The heart is fine.", None),
    # Commas and slashes do not use up the scope.
    ("No mass, nodule, scar, cyst, bleb, granuloma, cardiomegaly.", "negated"), ("No a, b, c, d, e, f, g, h, i, j, k, cardiomegaly", "negated"), ("No a, b, c, d, e, f, g, h, i, j, k, l, cardiomegaly", "positive"),
    ("No well-known x-ray follow-up a b c d e f g h cardiomegaly", "negated"), ("Cardiomegaly, (as above), is absent", "negated"), ("cardiomegaly a b c d e f absent", "positive"),
    ("No mass. Cardiomegaly.", "positive"), ("No mass\ncardiomegaly", "positive"), ("écardiomegaly", None), ("No effusion; possible enlarged heart.", "uncertain"),
]


def test_assertions(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(MENTIONS)] + [(98, None), (99, "")], "doc_id long, text string")
    got = {}
    for r in assertion.mentions(df).filter("concept = 'cardiomegaly'").collect():
        got.setdefault(r["doc_id"], []).append(r["status"])
    assert got == {i: [state] for i, (_, state) in enumerate(MENTIONS) if state}
    twice = spark.createDataFrame([(1, "No effusion, and Effusions but XXXX effusion.")], "doc_id long, text string")
    rows = assertion.mentions(twice).collect()
    assert sorted((r["match"], r["status"]) for r in rows) == [("Effusions", "negated"), ("effusion", "negated"), ("effusion", "positive")] and "xxxx" in rows[0]["sentence"]
    lexicon = assertion.overlay(assertion.TRIGGERS, add={"negation_pre": ["bar"]})
    assert [r["status"] for r in assertion.mentions(spark.createDataFrame([(1, "bar edema")], "doc_id long, text string"), triggers=lexicon).collect()] == ["negated"]
    left = assertion.unmappable(spark.createDataFrame([(1, " Odd words here.  Edema is seen.\n\nAll clear! last"), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["sentence"]) for r in left) == [(1, "Odd words here."), (1, "last")]


REPORTS = [
    ("FINDINGS: clear.\nIMPRESSION: normal.", "clear.", "normal.", True, ""),
    ("just text", "just text", "", False, "no_headings_whole_text_as_findings;empty_impression"),
    ("**FINDINGS:**\nline one\nline two\n**IMPRESSION:** fine", "line one line two", "fine", True, ""),
    ("FINDINGS: a\nIMPRESSION: b\nFINDINGS: c\nmore\nIMPRESSION: d", "a", "b", True, "repeated_section_ignored;repeated_section_ignored"),
    ("FINDINGS: a\nIMPRESSION: b\nB. RETRIEVED EVIDENCE x", "a", "b", True, "echoed_input_removed"),
    (None, "", "", False, "no_headings_whole_text_as_findings;empty_findings;empty_impression"),
    ("intro\r\n\nFINDING - a\nFINDINGS: b\n c \nIMPRESSIONS:\n* _\nd\nIMPRESSION e", "a b c", "* _ d e", False, "text_before_first_heading"),
    ("IMPRESSION: only", "", "only", False, "empty_findings"),
    ("FINDINGS: " + "x" * 400 + "\nIMPRESSION: y", "", "y", False, "text_before_first_heading;empty_findings"),
    ("C. EVIDENCE SUMMARY", "", "", False, "echoed_input_removed;no_headings_whole_text_as_findings;empty_findings;empty_impression"),
]


def test_report_parser(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPORTS)], "id long, text string")
    got = {r["id"]: (r["findings"], r["impression"], r["format_ok"], r["flags"]) for r in reports.parse_reports(df, "id").collect()}
    for i, want in enumerate(REPORTS):
        assert got[i] == want[1:], want[0]
    clash = spark.createDataFrame([("FINDINGS: a\nIMPRESSION: b", 1)], "flags string, findings int")
    assert [tuple(r) for r in reports.parsed(clash, "flags").select("findings", "impression").collect()] == [("a", "b")]


def test_evidence_validator(spark):
    texts = ["the cardiac silhouette is enlarged there is an effusion", "clear lungs"]
    full = '{"classifier_findings": [{"finding": "b", "supporting_ranks": [4, 1, 2, 9, "2", 2.5, true], "support_status": "unsupported", "evidence_summary": "seen"}, {"finding": "a", "supporting_ranks": ["5"], "support_status": "partially_supported", "evidence_summary": "The cardiac silhouette is enlarged. There is more"}, {"finding": "b"}, {"finding": "z"}], "retrieval_only_candidates": [{"finding": "c", "supporting_ranks": []}, {"finding": "c", "supporting_ranks": [3], "evidence_summary": "%s"}, {"finding": "a", "supporting_ranks": [1]}, {"finding": "d", "supporting_ranks": [1, 2]}], "normal_report_ranks": [5, 0]}' % ("long " * 25)
    pos = [("b", 0.81234), ("a", 0.33333)]
    df = spark.createDataFrame([(1, full, pos, 5, texts), (2, "no json", pos, 5, texts), (3, None, [], 0, []), (4, 'x {"classifier_findings": []} y', pos[:1], 5, texts)], "id int, raw string, pos array<struct<finding: string, probability: double>>, k int, texts array<string>")
    got = {r["id"]: r for r in agents.validate_evidence(df, "raw", "pos", "k", "texts", ["a", "b", "c", "d"]).collect()}
    one = got[1]
    assert [(e["finding"], e["ranks"], e["count"], e["status"], e["stated_status"], e["probability"]) for e in one["entries"]] == [("a", [5], 1, "partially_supported", "partially_supported", 0.3333), ("b", [1, 2, 4], 3, "supported", "unsupported", 0.8123)]
    assert one["entries"][0]["summary"]["text"] == "Stated in 1 of 5 retrieved reports." and one["entries"][1]["summary"]["text"] == "seen" and one["normal_ranks"] == [5]
    assert [(c["finding"], c["ranks"]) for c in one["candidates"]] == [("d", [1, 2]), ("c", [3])] and len(one["candidates"][1]["summary"]["text"].split()) == 20
    assert one["flags"] == ["extra_or_duplicate_entry", "status_inconsistent_with_count", "summary_replaced", "summary_truncated"]
    assert got[2]["flags"] == ["omitted_finding", "status_inconsistent_with_count", "summary_replaced", "unparseable"] and [e["status"] for e in got[2]["entries"]] == ["unsupported"] * 2
    assert got[3]["entries"] == [] and got[4]["flags"] == ["omitted_finding", "status_inconsistent_with_count", "summary_replaced"]


def test_review(spark):
    rows = [
        ('{"decision": "APPROVE", "findings": "a b.", "impression": "C", "issues_detected": ["none"]}', "approve", "A b", []),
        ('{"decision": "REVISE", "findings": " new  text ", "impression": "i", "issues_detected": ["excessive_certainty", "odd"]}', "revise", "new text", []),
        ('{"decision": "REVISE", "findings": "x"}', "revise_unusable_kept_draft", "A b", ["revise_without_complete_report"]),
        ('{"decision": "REVISE", "findings": "A, B", "impression": "c"}', "approve", "A b", ["revise_but_identical"]),
        ('{"findings": "x"}', "unparseable_kept_draft", "A b", ["missing_decision"]), ("[1]", "unparseable_kept_draft", "A b", ["unparseable"]), (None, "unparseable_kept_draft", "A b", ["unparseable"]),
    ]
    df = spark.createDataFrame([(i, r[0], "A b", "c") for i, r in enumerate(rows)], "id int, raw string, f string, i string")
    got = {r["id"]: (r["action"], r["final_findings"], r["flags"]) for r in agents.parse_review(df, "raw", "f", "i").collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}


def test_text_metrics(spark):
    same = "a b c d e f g h".split()
    df = spark.createDataFrame([(1, same, same), (2, "a b c d".split(), "a x c d".split()), (3, [], same)], "id long, h array<string>, r array<string>")
    b = {r["id"]: r["bleu"] for r in textgen.bleu(df, 4).collect()}
    assert math.isclose(b[1], 1.0) and b[3] == 0
    r = {x["id"]: (x["l"], x["m"]) for x in df.select("id", textgen.rouge_l("h", "r").alias("l"), textgen.meteor_exact("h", "r").alias("m")).collect()}
    assert r[1][0] == 1 and math.isclose(r[1][1], 1 - 0.5 / 8**3) and math.isclose(r[2][0], 0.75) and r[3] == (0, 0)


def test_copying(spark):
    g = spark.createDataFrame([(1, ["one two three four five six", "short one"], "one two three four five six short one".split())], "id long, sentences array<string>, tokens array<string>")
    r = textgen.copy_statistics(g, g).first()
    assert r["copied_rate"] == 1 and r["whole_copy"] and r["overlap_rate"] == 1
    assert math.isclose(one(spark, textgen.repeat_rate(F.col("s")), s=["a", "b", "a"]), 1 / 3)


def test_random_split(spark):
    g = spark.range(3000).select(F.col("id").alias("group"), (F.col("id") % 5 + 1).alias("size"))
    ratios = {"train": 0.7, "val": 0.15, "test": 0.15}
    s = splits.random_split(g, ratios, 1)
    assert s.count() == 3000 and s.select("group").distinct().count() == 3000
    share = {r["split"]: r["s"] / 9000 for r in s.groupBy("split").agg(F.sum("size").alias("s")).collect()}
    assert all(abs(share[k] - v) < 0.02 for k, v in ratios.items())
    assert s.select("group", "split").exceptAll(splits.random_split(g.orderBy(F.rand(3)), ratios, 1).select("group", "split")).count() == 0
    with pytest.raises(ValueError):
        splits.random_split(g, {"a": 0.5}, 1)


def test_stratified_split(spark):
    g = spark.range(600).select(F.col("id").alias("group"), F.lit(2).alias("size"), F.array((F.col("id") % 3 == 0).cast("int"), (F.col("id") % 20 == 0).cast("int")).alias("labels"))
    s = splits.stratified_split(g, {"train": 0.7, "test": 0.3}, 5).join(g, "group").groupBy("split").agg(F.sum(F.col("labels")[0]).alias("a"), F.sum(F.col("labels")[1]).alias("b"), F.count(F.lit(1)).alias("n"))
    r = {x["split"]: x for x in s.collect()}
    # Each label is within a group of its share.
    assert abs(r["train"]["a"] - 140) <= 2 and abs(r["train"]["b"] - 21) <= 1 and r["train"]["n"] + r["test"]["n"] == 600


def test_leakage(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train")], "g string, split string")
    with pytest.raises(relational.CheckFailed):
        splits.check_leakage(rows, "g", "split")
    splits.check_leakage(rows.filter("g = 'b'"), "g", "split")


def test_one_to_one(spark):
    a, b = spark.range(3), spark.createDataFrame([(0, "x"), (0, "y")], "id long, v string")
    with pytest.raises(relational.CheckFailed):
        relational.one_to_one(a, b, ["id"])


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    out = {r["node"]: r["label"] for r in graph.components(e).collect()}
    assert set(out[i] for i in range(21)) == {0} and out[101] == 100
    assert graph.components(e.limit(0)).count() == 0


def test_calibration(spark):
    df = spark.createDataFrame([(0, int((i * 37) % 100 < 100 * p), p) for p in (0.1, 0.3, 0.5, 0.7, 0.9) for i in range(100)], "cls int, y int, p double")
    pts = calibrate.compact(df)
    t = calibrate.fit_temperature(pts).first()["t"]
    ab = calibrate.fit_platt(pts).first()
    assert abs(t - 1) < 0.05 and abs(ab["a"] - 1) < 0.05 and abs(ab["b"]) < 0.05 and ab["converged"]
    knots = calibrate.fit_isotonic(pts)
    q = calibrate.apply_isotonic(df.select("cls", labels.logit(F.col("p")).alias("z"), "p"), knots)
    assert q.select(F.max(F.abs(F.col("q") - F.col("p")))).first()[0] < 0.02


def test_calibrator_choice(spark):
    cols = "cls int, method string, log_loss double, brier double, pathological boolean, mismatches long"
    row = lambda c, ll, br=None, bad=(), off=(): [(c, m, x, (br or ll)[i], m in bad, 1 * (m in off)) for i, (m, x) in enumerate(zip(calibrate.COMPLEXITY, ll))]
    def chosen(rows, **kw):
        return {(r["cls"]): (r["own"], r["chosen"]) for r in calibrate.choose(spark.createDataFrame(rows, cols), **kw).collect()}

    # The simplest within half a per cent; not one that breaks a guardrail.
    assert chosen(row(0, [0.60, 0.501, 0.50, 0.499])) == {0: ("temperature", "temperature")}
    one = row(0, [0.60, 0.520, 0.500, 0.4980]) + row(1, [0.60, 0.520, 0.500, 0.4980], off=["isotonic"]) + row(2, [0.30, 0.31, 0.32, 0.33]) + row(3, [0.6, 0.50, 0.5, 0.5], bad=["temperature"])
    assert {c: own for c, (own, _) in chosen(one).items()} == {0: "platt", 1: "platt", 2: "raw", 3: "platt"}
    # Platt is chosen by three of four, but would cost class 2 more than one per cent.
    assert chosen(one)[2][1] == "raw"
    assert {v[1] for v in chosen(one, most_loss=0.10).values()} == {"platt"} and {v[1] for v in chosen(one, share=0.9, most_loss=0.10).values()} == {"platt", "raw"}
    assert chosen(row(0, [0.5] * 4, bad=calibrate.COMPLEXITY))[0] == (None, None)
    df = spark.createDataFrame([(0, int((i * 37) % 100 < 100 * p), p, i % 3) for p in (0.1, 0.3, 0.5, 0.7, 0.9) for i in range(100)], "cls int, y int, p double, fold int")
    got = {r["method"]: r for r in calibrate.out_of_fold(df, 3, 0.5).collect()}
    assert set(got) == set(calibrate.COMPLEXITY) and all(not r["pathological"] and r["mismatches"] == 0 for r in got.values()) and abs(got["raw"]["brier"] - got["platt"]["brier"]) < 0.01


def test_bootstrap(spark):
    v = spark.createDataFrame([(n, u, float(u % 5 + (n == "b"))) for n in "ab" for u in range(50)], "name string, unit long, x double")
    p = resample.paired(v, "b", "a", 100).first()
    assert p["mean"] == 1 and p["low"] == 1 and p["high"] == 1
    ci = {r["name"]: r for r in resample.mean_ci(v, 200).collect()}
    assert ci["a"]["low"] < 2 < ci["a"]["high"]
    w = spark.range(20000).select(resample.weights(F.col("id"), F.lit(1)).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(w[0] - 1) < 0.05 and abs(w[1] - 1) < 0.08
    assert math.isclose(one(spark, resample.fisher_exact("a", "b", "c", "d"), a=3, b=1, c=1, d=3), 0.4857142857, rel_tol=1e-6)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1 + 0.2), (2, 1e-300)], "k long, x double")
    files.write_csv(df, str(tmp_path / "c"))
    back = {r["k"]: r["x"] for r in files.read_csv(spark, str(tmp_path / "c"), "k long, x double").collect()}
    assert back == {1: 0.1 + 0.2, 2: 1e-300}
    a = files.audit_files(spark, str(tmp_path / "c"))
    m = a.select("path", "sha256")
    assert files.verify_manifest(a, m).count() == 0
    assert files.verify_manifest(a, m.withColumn("sha256", F.lit("0"))).first()["problem"] == "changed"
    assert one(spark, files.canonical_json(spark.createDataFrame([(1, None)], "b int, a string")), b=1, a="z") == '{"a":"z","b":1}'


def test_stream_windows(spark, tmp_path):
    ev = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 02:00:00", "b", 5.0)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = incremental.unique_events(stream).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 3
    w = {(str(r["start"]), r["event_type"]): (r["n"], r["total"]) for r in incremental.windowed_counts(incremental.unique_events(ev), "1 hour").collect()}
    assert w == {("2024-01-01 00:00:00", "a"): (2, 3.0), ("2024-01-01 02:00:00", "b"): (1, 5.0)}


def test_pending(spark):
    w = spark.range(5)
    assert sorted(r["id"] for r in incremental.pending(w, spark.range(3), ["id"]).collect()) == [3, 4]
    k = incremental.request_key({"b": F.col("id"), "a": F.lit("x")})
    assert w.select(k).distinct().count() == 5


def test_config(tmp_path):
    from marlstone.sources import catalog

    f = tmp_path / "c.json"
    f.write_text('{"paths": {"a": "/x", "b": "<set me>"}, "options": {"k": 3}}')
    c = catalog.load_config(f, required=("a",))
    assert c.path("a") == "/x" and c.options["k"] == 3
    with pytest.raises(ValueError):
        catalog.load_config(f, required=("b",))
    with pytest.raises(KeyError):
        c.path("z")


def test_config(tmp_path, spark):
    from marlstone.sources import catalog

    (tmp_path / "c.json").write_text('{"paths": {"a": "/x", "b": "PATH_TO_B"}, "options": {"k": 1}}')
    c = catalog.load_config(tmp_path / "c.json", ("a",))
    assert c.path("a") == "/x" and c.options == {"k": 1}
    with pytest.raises(ValueError, match="not set"):
        catalog.load_config(tmp_path / "c.json", ("b",))
    with pytest.raises(KeyError, match="no path"):
        catalog.load_config(tmp_path / "c.json", ("z",))
    with pytest.raises(FileNotFoundError):
        catalog.load_config(tmp_path / "none.json")
    e = spark.createDataFrame([(1, "a", "/x"), (1, "b", "<b>"), (2, "a", None), (2, "b", "/y"), (3, "a", "/x"), (3, "b", "/y")], "config int, key string, value string")
    assert sorted(tuple(r) for r in catalog.problems(e, ["b", "a"]).collect()) == [(1, "", "b"), (2, "a", "")]


def test_manifest_states(spark):
    from marlstone.plans import catalog

    got = {r["file"]: r["state"] for r in catalog.QUERIES["l4_manifest_check"](spark, "/root/testdata/sf0.001").collect()}
    assert got.pop("gone.parquet") == "missing" and got.pop("labels.parquet") == "changed" and got.pop("nation.parquet") == "new" and set(got.values()) == {"unchanged"} and len(got) == 12


def png(pixels, filters=None) -> bytes:
    """Encode rows x columns x channels of bytes, each row with its filter."""
    import zlib

    import numpy as np

    h, w, n = pixels.shape
    flat, lines = pixels.reshape(h, w * n).astype(int), []
    for y in range(h):
        kind = (filters or [0])[y % len(filters or [0])]
        left = np.concatenate([np.zeros(n, int), flat[y][:-n]]) if w > 1 else np.zeros(w * n, int)
        up = flat[y - 1] if y else np.zeros(w * n, int)
        corner = np.concatenate([np.zeros(n, int), up[:-n]]) if w > 1 else np.zeros(w * n, int)
        p = left + up - corner
        nearest = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        lines.append(bytes([kind]) + bytes(((flat[y] - [0, left, up, (left + up) // 2, nearest][kind]) % 256).astype("uint8")))
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, {1: 0, 3: 2, 2: 4, 4: 6}[n], 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(0)
    for n in (1, 2, 3, 4):
        x = r.integers(0, 256, (11, 9, n), dtype=np.uint8)
        for kind in range(5):
            assert (images.decode_png(png(x, [kind]))[1] == x).all()
        assert (images.decode_png(png(x, [4, 3, 2, 1, 0]))[1] == x).all()
    grey = png(r.integers(0, 256, (300, 300, 1), dtype=np.uint8))
    made = {
        "good.png": grey, "empty.png": b"", "cut.png": grey[:-30], "text.png": b"hello", "tiny.png": png(np.zeros((10, 10, 1), np.uint8)), "black.png": png(np.zeros((300, 300, 1), np.uint8)),
        "white.png": png(np.full((300, 300, 1), 255, np.uint8)), "wide.png": png(r.integers(0, 256, (70, 300, 1), dtype=np.uint8)), "red.png": png(np.dstack([r.integers(0, 256, (300, 300)), np.zeros((300, 300)), np.zeros((300, 300))]).astype(np.uint8)), "small.png": png(r.integers(0, 256, (100, 150, 4), dtype=np.uint8) // np.array([1, 1, 1, 2], np.uint8)),
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    table = images.audit_images(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("path", "/"), -1))
    error, warnings = images.verdict(F.lit(True))
    n, flags = relational.flag_list(images.flags(F.lit(True), F.lit(True), F.lit(False), F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1), F.lit("png")))
    got = {x["file"]: x for x in table.select("*", error.alias("error"), warnings.alias("warnings"), flags.alias("flags")).collect()}
    assert {k: v["error"] for k, v in got.items()} == {
        "good.png": None, "cut.png": "unreadable_image", "text.png": "unreadable_image", "tiny.png": "invalid_dimensions", "black.png": "fully_black_image", "white.png": "fully_white_image", "wide.png": "extreme_aspect_ratio", "red.png": "strongly_colored_image", "small.png": "strongly_colored_image",
    }
    assert got["good.png"]["warnings"] == [] and got["small.png"]["warnings"] == ["small_image", "transparency"] and got["good.png"]["flags"] == ""
    assert got["black.png"]["flags"] == "near_blank" and got["cut.png"]["flags"] == "unreadable_or_corrupt" and got["small.png"]["flags"] == "non_grayscale;suspiciously_small" and got["wide.png"]["flags"] == "suspiciously_small;unusual_aspect_ratio"
    assert abs(got["good.png"]["mean"] - 127.5) < 2 and got["good.png"]["sha256"] == __import__("hashlib").sha256(grey).hexdigest()


def test_retrieval_of_many_queries(spark, monkeypatch):
    """Queries in blocks, and lexical queries beyond what is sent to every task, give what one pass gives."""
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id long, v array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i), -1.0]) for i in range(9)], "query long, q array<double>")
    key = lambda df: sorted((r["query"], r["rank"], r["id"], round(r["score"], 8)) for r in df.collect())
    one = key(retrieval.dense(v, q, 4))
    docs = spark.createDataFrame([(i, [f"w{(i * k) % 11}" for k in range(1, 2 + i % 9)]) for i in range(80)] + [(99, []), (98, None)], "id long, t array<string>")
    asked = spark.createDataFrame([(i, f"w{(i + j) % 13}") for i in range(8) for j in range(3)], "query long, token string")
    first = key(retrieval.lexical(docs, asked, 5))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 2)
    assert key(retrieval.dense(v, q, 4)) == one and len(one) == 36
    monkeypatch.setattr(retrieval, "MOST_WORTH", 0)
    assert key(retrieval.lexical(docs, asked, 5)) == first and len(first) == 40
    monkeypatch.setattr(retrieval, "MOST_ASKED", 5)
    assert key(retrieval.lexical(docs, asked, 5)) == first
    assert retrieval.lexical(docs, asked.limit(0), 5).count() == 0 and retrieval.lexical(docs.limit(0), asked, 5).count() == 0
