"""Queries: label policies, losses, decisions, association, imbalance."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import agents
from ..functions import labels as L
from ..operators import association as A
from .base import MATRIX, SCORES, STATES, matrix, r6, scores, states, t
from .registry import query

_IDS = "ids AS (SELECT o_orderkey AS id FROM orders)"
ids = lambda spark, sf: t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
_LS = "(CASE WHEN {0} >= 0 THEN -ln(1 + exp(-({0}))) ELSE ({0}) - ln(1 + exp({0})) END)"


@query("b1_label_policy", f"WITH {STATES} SELECT doc_id, label, CASE raw WHEN 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS target, CASE WHEN raw = -1 THEN 0 ELSE 1 END AS mask FROM st")
def b1(spark, sf):
    target, mask = L.apply_policy(F.col("raw"), "mask", "zero")
    return states(spark, sf).select("doc_id", "label", target.alias("target"), mask.alias("mask"))


@query("b2_sigmoid", "SELECT p_partkey, round(CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END, 9) AS s FROM (SELECT p_partkey, (p_size - 25) / 3.0 AS z FROM part)")
def b2(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.round(L.sigmoid((F.col("p_size") - 25) / 3.0), 9).alias("s"))


_Z = f"z AS (SELECT cls, y::DOUBLE AS y, ln(least(greatest(p, 1e-12), 1 - 1e-12)) - ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)) AS z FROM sc)"


@query("b3_masked_losses", f"""WITH {SCORES}, {_Z}, l AS (SELECT cls, y, {_LS.format('z')} AS a, {_LS.format('-z')} AS b FROM z), k AS (SELECT *, y * a + (1 - y) * b AS lp, greatest(exp(a) - 0.05, 0) AS pm FROM l)
SELECT cls, round(avg(-(2 * y * a + (1 - y) * b)), 6) AS bce, round(avg(-power(1 - exp(lp), 2) * lp), 6) AS focal, round(avg(y * -a + (1 - y) * -power(pm, 4) * ln(greatest(1 - pm, 1e-12))), 6) AS asymmetric FROM k GROUP BY 1""")
def b3(spark, sf):
    z = scores(spark, sf).select("cls", F.col("y").cast("double").alias("y"), L.logit(F.col("p")).alias("z"))
    one = F.lit(1)
    z0, y = F.col("z"), F.col("y")
    return z.groupBy("cls").agg(r6(L.masked_mean(L.bce(z0, y, 2.0), one)).alias("bce"), r6(L.masked_mean(L.focal(z0, y), one)).alias("focal"), r6(L.masked_mean(L.asymmetric(z0, y), one)).alias("asymmetric"))


@query("b4_tempered_weight", f"WITH {STATES} SELECT label, round(sqrt(count(*) FILTER (raw = 0)::DOUBLE / nullif(count(*) FILTER (raw = 1), 0)), 6) AS w FROM st GROUP BY 1")
def b4(spark, sf):
    g = states(spark, sf).groupBy("label").agg(F.count_if(F.col("raw") == 0).cast("double").alias("n"), F.count_if(F.col("raw") == 1).cast("double").alias("p"))
    return g.select("label", r6(F.sqrt(F.try_divide("n", "p"))).alias("w"))


@query("b5_pos_weight", f"WITH {STATES}, c AS (SELECT label, count(*) FILTER (raw = 1) AS n_pos, count(*) FILTER (raw = 0 OR raw IS NULL) AS n_neg FROM st GROUP BY 1) SELECT label, n_pos, n_neg, round(CASE WHEN n_pos = 0 OR n_neg = 0 THEN 1.0 ELSE n_neg::DOUBLE / n_pos END, 6) AS pos_weight, n_pos = 0 OR n_neg = 0 AS degenerate FROM c")
def b5(spark, sf):
    target, mask = L.apply_policy(F.col("raw"), "mask", "zero")
    return A.pos_weight(states(spark, sf).select("label", target.alias("target"), mask.alias("mask")))


_W = f"{MATRIX}, {_IDS}, n AS (SELECT count(*)::DOUBLE AS rows FROM ids), pv AS (SELECT label, max(rows) / count(*) AS inverse FROM m, n GROUP BY 1), own AS (SELECT id, max(inverse) AS w FROM m JOIN pv USING (label) GROUP BY 1), nn AS (SELECT max(rows) / nullif(count(*), 0) AS w_none FROM ids, n WHERE id NOT IN (SELECT id FROM m)), w AS (SELECT id, coalesce(own.w, w_none) AS w FROM ids LEFT JOIN own USING (id), nn)"


@query("b6_sampling_weights", f"WITH {_W} SELECT id, round(w, 6) AS w FROM w")
def b6(spark, sf):
    return A.sampling_weights(matrix(spark, sf), ids(spark, sf)).select("id", r6("w").alias("w"))


@query("b7_sampler_effect", f"WITH {_W}, tt AS (SELECT sum(w) AS sw, sum(w * w) AS sww, count(*)::DOUBLE AS rows FROM w) SELECT label, round(count(*) / max(rows), 6) AS prevalence, round(sum(w) / max(sw), 6) AS expected, round(max(sw) * max(sw) / max(sww), 3) AS ess FROM m JOIN w USING (id), tt GROUP BY 1")
def b7(spark, sf):
    m = matrix(spark, sf)
    return A.sampler_effect(m, A.sampling_weights(m, ids(spark, sf)))


@query("c1_cardinality_and_density", f"WITH {MATRIX}, {_IDS} SELECT (SELECT count(*) FROM ids) AS rows, round(count(*) / (SELECT count(*) FROM ids)::DOUBLE, 6) AS cardinality, round(count(*) / (SELECT count(*) FROM ids)::DOUBLE / count(DISTINCT label), 6) AS density FROM m")
def c1(spark, sf):
    return A.cardinality(matrix(spark, sf), None, ids(spark, sf))


@query("c1b_labels_per_row", f"WITH {MATRIX}, {_IDS}, k AS (SELECT ids.id, count(label) AS k FROM ids LEFT JOIN m ON m.id = ids.id GROUP BY 1) SELECT k AS labels_per_row, count(*)::BIGINT AS n FROM k GROUP BY 1")
def c1b(spark, sf):
    return A.positives_per_row(matrix(spark, sf), ids(spark, sf))


_PAIRS = f"{MATRIX}, s AS (SELECT label, count(*) AS n FROM m GROUP BY 1), r AS (SELECT count(*)::DOUBLE AS rows FROM orders), k AS (SELECT x.label AS a, y.label AS b, count(*) AS k FROM m x JOIN m y ON x.id = y.id AND x.label <> y.label GROUP BY 1, 2), e AS (SELECT sa.label AS a, sb.label AS b, coalesce(k.k, 0) AS n_ab, sa.n AS n_a, sb.n AS n_b, rows FROM s sa JOIN s sb ON sa.label <> sb.label CROSS JOIN r LEFT JOIN k ON k.a = sa.label AND k.b = sb.label)"
_MEASURES = {
    "c2_cooccurrence": ("n_ab", "n_ab"),
    "c3_jaccard": ("jaccard", "round(n_ab::DOUBLE / nullif(n_a + n_b - n_ab, 0), 6)"),
    "c4_conditional": ("p_b_given_a", "round(n_ab::DOUBLE / nullif(n_a, 0), 6)"),
    "c5_phi": ("phi", "round((rows * n_ab - n_a::DOUBLE * n_b) / nullif(sqrt(n_a * (rows - n_a) * n_b * (rows - n_b)), 0), 6)"),
    "c6_lift": ("lift", "round(rows * n_ab / nullif(n_a::DOUBLE * n_b, 0), 6)"),
}
for _name, (_col, _sql) in _MEASURES.items():
    query(_name, f"WITH {_PAIRS} SELECT a, b, {_sql} AS {_col} FROM e")(lambda spark, sf, c=_col: A.pairwise(matrix(spark, sf), ids(spark, sf)).select("a", "b", c))


@query("c7_pairwise_table", f"WITH {_PAIRS} SELECT a, b, n_a, n_b, " + ", ".join(f"{s} AS {c}" for c, s in _MEASURES.values()) + " FROM e")
def c7(spark, sf):
    return A.pairwise(matrix(spark, sf), ids(spark, sf))


@query("h1_logit", "SELECT l_orderkey, l_partkey, l_linenumber, round(ln(q) - ln(1 - q), 6) AS z FROM (SELECT l_orderkey, l_partkey, l_linenumber, least(greatest(l_discount, 1e-12), 1 - 1e-12) AS q FROM lineitem)")
def h1(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", r6(L.logit(F.col("l_discount"))).alias("z"))


#: Class 0 stands for the normal finding, 9 for a device, the others for pathologies; a class is positive from 0.6 on.
NORMAL, DEVICE, CUT = 0, 9, 0.6
_DEC = f"{SCORES}, dc AS (SELECT vec_id AS id, cls, p, p >= {CUT} AS decision FROM sc), ab AS (SELECT *, coalesce(bool_or(decision) FILTER (cls BETWEEN 1 AND 8) OVER (PARTITION BY id), false) AS bad FROM dc), fin AS (SELECT id, cls, p, decision, CASE WHEN cls = {NORMAL} THEN decision AND NOT bad ELSE decision END AS final FROM ab)"


def decisions(spark, sf):
    return scores(spark, sf).select(F.col("vec_id").alias("id"), "cls", "p", (F.col("p") >= CUT).alias("decision"))


def finals(spark, sf):
    rows = decisions(spark, sf).withColumn("label", F.col("cls").cast("string"))
    return L.suppress_normal(rows, str(NORMAL), [str(i) for i in range(1, 9)]).drop("label")


@query("k1_threshold_decision", f"WITH {_DEC} SELECT id, cls, decision FROM dc")
def k1(spark, sf):
    return decisions(spark, sf).select("id", "cls", "decision")


@query("k2_normal_suppression", f"WITH {_DEC} SELECT id, cls, final FROM fin")
def k2(spark, sf):
    return finals(spark, sf).select("id", "cls", "final")


@query("k3_structured_findings", f"WITH {_DEC} SELECT id, coalesce(string_agg(cls::VARCHAR, ',' ORDER BY round(p - {CUT}, 6) DESC, cls) FILTER (decision), '') AS positive, coalesce(string_agg(cls::VARCHAR, ',' ORDER BY cls) FILTER (NOT decision), '') AS negative, coalesce(string_agg(cls::VARCHAR, ',' ORDER BY cls) FILTER (abs(round(p - {CUT}, 6)) <= 0.05), '') AS borderline, bool_or(decision AND cls = {NORMAL}) AND bool_or(decision AND cls BETWEEN 1 AND 8) AS contradiction FROM dc GROUP BY 1")
def k3(spark, sf):
    margin = F.round(F.col("p") - CUT, 6)
    listed = lambda cond, key: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(key.alias("k"), "cls")))), lambda s: s["cls"].cast("string")), ",")
    d = F.col("decision")
    return decisions(spark, sf).groupBy("id").agg(listed(d, -margin).alias("positive"), listed(~d, F.lit(0)).alias("negative"), listed(F.abs(margin) <= 0.05, F.lit(0)).alias("borderline"), (F.bool_or(d & (F.col("cls") == NORMAL)) & F.bool_or(d & F.col("cls").between(1, 8))).alias("contradiction"))


_POS = f"{_DEC}, ps AS (SELECT id, list_sort(list(cls) FILTER (final AND cls <> {NORMAL})) AS pos, bool_or(final AND cls = {NORMAL}) AS normal FROM fin GROUP BY 1), pp AS (SELECT id, coalesce(pos, []) AS pos, normal FROM ps)"


def positives(spark, sf):
    f = finals(spark, sf)
    return f.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("final") & (F.col("cls") != NORMAL), F.col("cls")))).alias("pos"), F.bool_or(F.col("final") & (F.col("cls") == NORMAL)).alias("normal"))


@query("k4_routing", f"WITH {_POS} SELECT id, CASE WHEN len(pos) = 0 AND NOT normal THEN 'indeterminate' WHEN normal AND len(list_filter(pos, lambda x: x <> {DEVICE})) = 0 THEN 'normal' ELSE 'abnormal' END AS state FROM pp")
def k4(spark, sf):
    p = positives(spark, sf).withColumn("names", F.transform("pos", lambda x: x.cast("string")))
    return p.select("id", L.route(F.col("names"), F.col("normal"), [str(DEVICE)]).alias("state"))


@query("k5_classifier_query", f"WITH {_POS} SELECT id, CASE WHEN len(pos) > 0 THEN array_to_string(pos, ', ') WHEN normal THEN 'no acute finding' ELSE '' END AS query, CASE WHEN len(pos) > 0 THEN 'findings' WHEN normal THEN 'no_finding' ELSE 'empty' END AS status FROM pp")
def k5(spark, sf):
    some = F.size("pos") > 0
    return positives(spark, sf).select("id", F.when(some, F.array_join(F.transform("pos", lambda x: x.cast("string")), ", ")).when(F.col("normal"), "no acute finding").otherwise("").alias("query"), F.when(some, "findings").when(F.col("normal"), "no_finding").otherwise("empty").alias("status"))


@query("k6_gated_query", f"""WITH {_DEC}, g AS (SELECT id, list_sort(list(cls) FILTER (final AND cls <> {NORMAL} AND (cls >= 5 OR p >= 0.65))) AS high, list_sort(list(cls) FILTER (final AND cls BETWEEN 1 AND 4 AND p < 0.65)) AS low, bool_or(final AND cls = {NORMAL}) AS normal, arg_max(cls, (p, -cls)) FILTER (final AND cls <> {NORMAL}) AS best FROM fin GROUP BY 1)
SELECT id, array_to_string(coalesce(high, []), ',') AS high, array_to_string(coalesce(low, []), ',') AS low, CASE WHEN len(coalesce(high, [])) > 0 THEN 'findings' WHEN normal THEN 'no_finding' WHEN best IS NOT NULL THEN 'fallback:' || best ELSE 'empty' END AS status FROM g""")
def k6(spark, sf):
    f = finals(spark, sf)
    found = F.col("final") & (F.col("cls") != NORMAL)
    gate = F.when(F.col("cls").between(1, 4), 0.65)  # the other classes have no gate
    item = F.struct(F.col("cls").alias("name"), found.alias("positive"), "p", gate.alias("gate"))
    g = f.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.bool_or(F.col("final") & (F.col("cls") == NORMAL)).alias("normal"), F.max_by(F.when(found, F.col("cls")), F.when(found, F.struct("p", (-F.col("cls")).alias("k")))).alias("best"))
    high, low = L.gate_lists(F.col("items"))
    join = lambda x: F.array_join(F.transform(x, lambda c: c.cast("string")), ",")
    return g.select("id", join(high).alias("high"), join(low).alias("low"), F.when(F.size(high) > 0, "findings").when(F.col("normal"), "no_finding").when(F.col("best").isNotNull(), F.concat(F.lit("fallback:"), F.col("best").cast("string"))).otherwise("empty").alias("status"))


@query("k7_top_n_selection", f"WITH {_DEC}, r AS (SELECT id, cls, row_number() OVER (PARTITION BY id ORDER BY p DESC, cls) AS r FROM fin WHERE final) SELECT id, string_agg(cls::VARCHAR, ',' ORDER BY cls) AS chosen FROM r WHERE r <= 3 GROUP BY 1")
def k7(spark, sf):
    r = finals(spark, sf).filter("final").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("p"), "cls"))).filter("r <= 3")
    return r.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("cls")), lambda c: c.cast("string")), ",").alias("chosen"))


@query("k8_finding_weights", f"WITH {_DEC}, w AS (SELECT id, cls, greatest((p - {CUT}) / (1 - {CUT}), 0) AS w FROM fin WHERE final) SELECT id, cls, round(CASE WHEN sum(w) OVER (PARTITION BY id) > 0 THEN w / sum(w) OVER (PARTITION BY id) ELSE 1.0 / count(*) OVER (PARTITION BY id) END, 6) AS w FROM w")
def k8(spark, sf):
    return finals(spark, sf).filter("final").select("id", "cls", r6(L.finding_weights("margin", F.col("p"), F.lit(CUT), F.col("id"))).alias("w"))


@query("k9_support_status", "SELECT l_partkey, count(DISTINCT l_suppkey)::BIGINT AS n, CASE WHEN count(DISTINCT l_suppkey) >= 2 THEN 'supported' WHEN count(DISTINCT l_suppkey) = 1 THEN 'partially_supported' ELSE 'unsupported' END AS status FROM lineitem GROUP BY 1")
def k9(spark, sf):
    g = t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"))
    return g.select("l_partkey", "n", L.support_status(F.col("n")).alias("status"))


_NAMES = ["PROMO", "LARGE", "ECONOMY", "SMALL", "STANDARD", "MEDIUM"]
_LI = "li AS (SELECT l_orderkey AS id, l_linenumber AS ln, p_type AS f, least(l_quantity, 9)::INT AS q, CASE WHEN l_linestatus = 'O' THEN 'supported' ELSE 'partially_supported' END AS st FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("k9b_evidence_validator", f"""WITH {_LI}, o AS (SELECT DISTINCT id FROM li), e AS (SELECT *, row_number() OVER (PARTITION BY id, f ORDER BY ln, q, st) AS r, list_sort(list_distinct(list_filter([ln::INT, q], lambda x: x BETWEEN 1 AND 5))) AS rk FROM li),
p AS (SELECT o.id, n.f, n.pl, coalesce(rk, []) AS rk, st, e.id IS NULL AS omitted, CASE WHEN len(coalesce(rk, [])) >= 2 THEN 'supported' WHEN len(coalesce(rk, [])) = 1 THEN 'partially_supported' ELSE 'unsupported' END AS status FROM o CROSS JOIN (VALUES ('PROMO', 1), ('LARGE', 2)) n(f, pl) LEFT JOIN e ON e.id = o.id AND e.f = n.f AND e.r = 1),
x AS (SELECT id, bool_or(r > 1 OR f NOT IN ('PROMO', 'LARGE')) AS extra, count(DISTINCT f) FILTER (f NOT IN ('PROMO', 'LARGE') AND f IN ({', '.join(f"'{n}'" for n in _NAMES)}) AND len(rk) > 0) AS candidates FROM e GROUP BY 1),
g AS (SELECT id, string_agg(f || ':' || array_to_string(rk, ',') || ':' || status || ':' || coalesce(st, ''), ';' ORDER BY pl) AS entries, bool_or(omitted) AS omitted, bool_or(st IS DISTINCT FROM status) AS inconsistent FROM p GROUP BY 1)
SELECT id, entries, candidates::INT AS candidates, array_to_string(list_filter([CASE WHEN extra THEN 'extra_or_duplicate_entry' END, CASE WHEN omitted THEN 'omitted_finding' END, CASE WHEN inconsistent THEN 'status_inconsistent_with_count' END, CASE WHEN omitted THEN 'summary_replaced' END], lambda v: v IS NOT NULL), ';') AS flags FROM g JOIN x USING (id)""")
def k9b(spark, sf):
    """An order's items as an answer's entries: two findings are asked for, the other types are extra entries and candidates."""
    li = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    entry = F.struct(F.col("l_linenumber").alias("ln"), F.col("p_type").alias("finding"), F.array(F.col("l_linenumber").cast("int"), F.least("l_quantity", F.lit(9)).cast("int")).alias("supporting_ranks"), F.when(F.col("l_linestatus") == "O", "supported").otherwise("partially_supported").alias("support_status"), F.lit("seen in these").alias("evidence_summary"))
    a = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    a = a.select("id", F.concat(F.lit("Here it is: "), F.to_json(F.struct(F.col("e").alias("classifier_findings"), F.col("e").alias("retrieval_only_candidates")))).alias("raw"), F.array(*[F.struct(F.lit(n).alias("finding"), F.lit(0.5).alias("probability")) for n in ("LARGE", "PROMO")]).alias("pos"), F.lit(5).alias("k"), F.array().cast("array<string>").alias("texts"))
    v = agents.validate_evidence(a, "raw", "pos", "k", "texts", _NAMES)
    line = F.transform("entries", lambda e: F.concat(e["finding"], F.lit(":"), F.array_join(F.transform(e["ranks"], lambda r: r.cast("string")), ","), F.lit(":"), e["status"], F.lit(":"), F.coalesce(e["stated_status"], F.lit(""))))
    return v.select("id", F.array_join(line, ";").alias("entries"), F.size("candidates").alias("candidates"), F.array_join("flags", ";").alias("flags"))


_KIND = "(event_id % 6)"


@query("k10_action_parse", f"""WITH e AS (SELECT event_id, event_type AS f, user_id::VARCHAR AS i, {_KIND} AS k FROM events)
SELECT event_id, CASE WHEN k IN (0, 1, 4) THEN 'approve' WHEN k = 2 THEN 'revise' WHEN k = 3 THEN 'revise_unusable_kept_draft' ELSE 'unparseable_kept_draft' END AS action, CASE WHEN k = 2 THEN 'new ' || f ELSE f END AS findings, CASE WHEN k IN (1, 2) THEN 'excessive_certainty' ELSE '' END AS issues,
CASE k WHEN 1 THEN 'approve_with_changed_copy_ignored;approve_with_issues' WHEN 3 THEN 'revise_without_complete_report' WHEN 4 THEN 'revise_but_identical' WHEN 5 THEN 'unparseable' ELSE '' END AS flags FROM e""")
def k10(spark, sf):
    """Reviews of six kinds: approved, approved with another copy and issues, revised, revised in part, revised alike, no object."""
    e = t(spark, sf, "events").select("event_id", F.col("event_type").alias("f"), F.col("user_id").cast("string").alias("i"), (F.col("event_id") % 6).alias("k"))
    answer = lambda decision, f, i, *issues: F.to_json(F.struct(F.lit(decision).alias("decision"), f.alias("findings"), i.alias("impression"), F.array(*map(F.lit, issues)).cast("array<string>").alias("issues_detected")))
    f, i = F.col("f"), F.col("i")
    kinds = [answer("APPROVE", f, i), answer("APPROVE", F.lit("other"), i, "excessive_certainty", "unheard_of"), F.concat(F.lit("Well: "), answer("REVISE", F.concat(F.lit("new "), f), i, "excessive_certainty"), F.lit(" so")), answer("REVISE", f, F.lit("")), answer("REVISE", F.upper(f), F.concat(F.lit(" "), i)), F.lit("[1, 2] is no object")]
    raw = kinds[-1]
    for n, made in enumerate(kinds[:-1]):
        raw = F.when(F.col("k") == n, made).otherwise(raw)
    r = agents.parse_review(e.withColumn("raw", raw), "raw", "f", "i")
    return r.select("event_id", "action", F.col("final_findings").alias("findings"), F.array_join("issues", ";").alias("issues"), F.array_join("flags", ";").alias("flags"))
