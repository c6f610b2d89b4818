"""Queries: generated text against references. A user's turn is the reference of the assistant's turn that follows it; finding
sets of a passage are the key words it has, 'classifier' sets those of its best document, 'generated' those of the second."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import textgen as G
from .base import r6, t
from .registry import query
from .relational_queries import WS
from .retrieval_queries import _KW, _M, KEYS, bm25_top, sets

_TOK = "regexp_extract_all(lower(%s), '[a-z0-9]+')"
_SENT = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace(%s, '([.;!?]){WS}', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '{WS}', ' ', 'g'))), lambda s: s <> '')"
_NS = f"list_transform({_SENT}, lambda s: array_to_string(regexp_extract_all(lower(s), '[a-z0-9]+'), ' '))"
_P = f"pr AS (SELECT conv_id * 1000 + turn AS id, text AS ref, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM conversations), pq AS (SELECT id, {_TOK % 'hyp'} AS h, {_TOK % 'ref'} AS r, hyp, ref FROM pr WHERE hyp IS NOT NULL)"


def turns(spark, sf):
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    p = t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("ref"), nxt.alias("hyp")).filter("hyp is not null")
    return p.select("id", "hyp", "ref", text.tokens(F.col("hyp")).alias("h"), text.tokens(F.col("ref")).alias("r"))


def _bleu_sql(n: int) -> str:
    gram = lambda k, c: f"list_transform(range(1, len({c}) - {k} + 2), lambda i: array_to_string({c}[i:i + {k} - 1], ' '))"
    parts = ", ".join(f"h{k} AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest({gram(k, 'h')}) AS g FROM pq) GROUP BY 1, 2), r{k} AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest({gram(k, 'r')}) AS g FROM pq) GROUP BY 1, 2), m{k} AS (SELECT h{k}.id, ln(CASE WHEN sum(least(h{k}.c, coalesce(r{k}.c, 0))) > 0 THEN sum(least(h{k}.c, coalesce(r{k}.c, 0)))::DOUBLE ELSE 0.1 END / sum(h{k}.c)) AS p FROM h{k} LEFT JOIN r{k} ON r{k}.id = h{k}.id AND r{k}.g = h{k}.g GROUP BY 1)" for k in range(1, n + 1))
    mean = "(" + " + ".join(f"m{k}.p" for k in range(1, n + 1)) + f") / {n}"
    return f"WITH {_P}, {parts} SELECT pq.id, round(CASE WHEN len(r) > 0 AND {mean} IS NOT NULL THEN exp({mean} + CASE WHEN len(h) > len(r) THEN 0 ELSE 1 - len(r)::DOUBLE / nullif(len(h), 0) END) ELSE 0 END, 6) AS bleu FROM pq " + " ".join(f"LEFT JOIN m{k} ON m{k}.id = pq.id" for k in range(1, n + 1))


@query("t1_bleu1", _bleu_sql(1))
def t1a(spark, sf):
    return G.bleu(turns(spark, sf).select("id", "h", "r"), 1).select("id", r6("bleu").alias("bleu"))


@query("t1_bleu4", _bleu_sql(4))
def t1b(spark, sf):
    return G.bleu(turns(spark, sf).select("id", "h", "r"), 4).select("id", r6("bleu").alias("bleu"))


# A row of the table of common subsequences is the running maximum of what its token adds to the row above.
_LCS = f"""{_P}, lc(id, i, row) AS (SELECT id, 0, list_transform(r, lambda x: 0) FROM pq UNION ALL SELECT id, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM
(SELECT id, i, list_transform(range(1, len(r) + 1), lambda j: greatest(row[j], CASE WHEN r[j] = h[i + 1] THEN CASE WHEN j > 1 THEN row[j - 1] ELSE 0 END + 1 ELSE 0 END)) AS c FROM lc JOIN pq USING (id) WHERE i < len(h)))"""


@query("t2_rouge_l", f"WITH RECURSIVE {_LCS} SELECT id, round(CASE WHEN len(h) > 0 AND len(r) > 0 THEN 2.0::DOUBLE * row[-1] / (len(h) + len(r)) ELSE 0 END, 6) AS rouge_l FROM lc JOIN pq USING (id) WHERE i = len(h)")
def t2(spark, sf):
    return turns(spark, sf).select("id", r6(G.rouge_l("h", "r")).alias("rouge_l"))


# The first free equal token is the one that is as manieth of its word.
_PAIRS = f"""{_P}, hw AS (SELECT id, w, i, row_number() OVER (PARTITION BY id, w ORDER BY i) AS k FROM (SELECT id, unnest(h) AS w, generate_subscripts(h, 1) AS i FROM pq)), rw AS (SELECT id, w, j, row_number() OVER (PARTITION BY id, w ORDER BY j) AS k FROM (SELECT id, unnest(r) AS w, generate_subscripts(r, 1) AS j FROM pq)),
al AS (SELECT id, i, j, lag(i) OVER o AS pi, lag(j) OVER o AS pj FROM hw JOIN rw USING (id, w, k) WINDOW o AS (PARTITION BY id ORDER BY i)), mt AS (SELECT id, count(*)::DOUBLE AS m, 1 + count(*) FILTER (pi IS NOT NULL AND (i <> pi + 1 OR j <> pj + 1)) AS chunks FROM al GROUP BY 1)"""


@query("t3_meteor_exact", f"WITH {_PAIRS} SELECT pq.id, round(CASE WHEN m IS NULL THEN 0 ELSE (m / len(h)) * (m / len(r)) / (0.9 * m / len(h) + 0.1 * m / len(r)) * (1 - 0.5 * power(chunks / m, 3)) END, 6)::DOUBLE AS meteor FROM pq LEFT JOIN mt ON mt.id = pq.id")
def t3(spark, sf):
    return turns(spark, sf).select("id", r6(G.meteor_exact("h", "r")).alias("meteor"))


@query("t4_repeated_sentences", f"WITH s AS (SELECT doc_id, list_filter({_NS % 'text'}, lambda x: x <> '') AS s FROM documents) SELECT doc_id, round(CASE WHEN len(s) > 0 THEN 1 - len(list_distinct(s))::DOUBLE / len(s) ELSE 0 END, 6) AS rate FROM s")
def t4(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.norm_sentences(F.col("text")).alias("s")).select("doc_id", r6(G.repeat_rate(F.col("s"))).alias("rate"))


@query("t5_copy_statistics", f"""WITH {_P}, ls AS (SELECT id, unnest({_NS % 'hyp'}) AS s FROM pq), lg AS (SELECT * FROM ls WHERE len(string_split(s, ' ')) >= 6), rs AS (SELECT DISTINCT id, unnest({_NS % 'ref'}) AS s FROM pq),
a AS (SELECT lg.id, count(*) AS nl, count(rs.s) AS nc FROM lg LEFT JOIN rs ON rs.id = lg.id AND rs.s = lg.s GROUP BY 1), gh AS (SELECT id, unnest(list_transform(range(1, len(h) - 6), lambda i: array_to_string(h[i:i + 7], ' '))) AS g FROM pq), gr AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(r) - 6), lambda i: array_to_string(r[i:i + 7], ' '))) AS g FROM pq),
b AS (SELECT gh.id, count(gr.g)::DOUBLE / count(*) AS o FROM gh LEFT JOIN gr ON gr.id = gh.id AND gr.g = gh.g GROUP BY 1)
SELECT pq.id, coalesce(nl, 0) AS n_long, coalesce(nc, 0) AS n_copied, round(coalesce(nc::DOUBLE / nullif(nl, 0), 0), 6) AS copied_rate, round(coalesce(o, 0), 6) AS overlap_rate, coalesce(nl > 0 AND nl = nc, false) AS whole_copy FROM pq LEFT JOIN a ON a.id = pq.id LEFT JOIN b ON b.id = pq.id""")
def t5(spark, sf):
    p = turns(spark, sf)
    g = p.select("id", text.norm_sentences(F.col("hyp")).alias("sentences"), F.col("h").alias("tokens"))
    s = p.select("id", text.norm_sentences(F.col("ref")).alias("sentences"), F.col("r").alias("tokens"))
    return G.copy_statistics(g, s).select("id", "n_long", "n_copied", r6("copied_rate").alias("copied_rate"), r6("overlap_rate").alias("overlap_rate"), "whole_copy")


@query("t6_evaluation_row")
def t6(spark, sf):
    """All measures of a generated text against its reference, a row a pair: length, overlap, repetition, copying, and the key words it
    states rightly, wrongly and not."""
    p = turns(spark, sf).withColumns({"hs": text.norm_sentences(F.col("hyp")), "rs": text.norm_sentences(F.col("ref"))})
    key = lambda c: F.array_intersect(F.array(*map(F.lit, KEYS)), F.col(c))
    own = p.select(
        "id", F.size("h").cast("long").alias("tokens"), F.size("hs").cast("long").alias("sentences"), r6(G.rouge_l("h", "r")).alias("rouge_l"), r6(G.meteor_exact("h", "r")).alias("meteor"),
        r6(G.repeat_rate(F.col("hs"))).alias("repeated"), key("h").alias("stated"), key("r").alias("truth"), G.overlaps("h", "r", "hs", "rs").alias("o"),
    )
    counts = {"tp": F.size(F.array_intersect("stated", "truth")), "fp": F.size(F.array_except("stated", "truth")), "fn": F.size(F.array_except("truth", "stated"))}
    own = own.select("*", *[v.cast("long").alias(k) for k, v in counts.items()]).withColumn("hallucinates", F.col("fp") > 0).withColumn("omits", F.col("fn") > 0)
    nl, nc = F.col("o.n_long"), F.col("o.n_copied")
    rate = F.coalesce(F.try_divide(nc.cast("double"), nl.cast("double")), F.lit(0.0))
    return own.select("*", r6("o.bleu1").alias("bleu1"), r6("o.bleu4").alias("bleu4"), nl.alias("n_long"), nc.alias("n_copied"), r6(rate).alias("copied_rate"), r6("o.overlap_rate").alias("overlap_rate"), ((nl > 0) & (nl == nc)).alias("whole_copy")).drop("o")


@query("t8_reference_leak", f"WITH s AS (SELECT item_id, unnest({_NS % 'text'}) AS s FROM benchmark), d AS (SELECT DISTINCT unnest({_NS % 'text'}) AS s FROM documents) SELECT item_id, count(*)::BIGINT AS sentences, count(d.s)::BIGINT AS leaked FROM s LEFT JOIN d USING (s) WHERE s.s <> '' GROUP BY 1")
def t8(spark, sf):
    s = t(spark, sf, "benchmark").select("item_id", F.explode(text.norm_sentences(F.col("text"))).alias("s")).filter("s <> ''")
    d = t(spark, sf, "documents").select(F.explode(text.norm_sentences(F.col("text"))).alias("s")).distinct().withColumn("hit", F.lit(1))
    return s.join(d, "s", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("sentences"), F.count("hit").alias("leaked"))


@query("t9_output_diversity", "SELECT role, count(*)::BIGINT AS n, count(DISTINCT text)::BIGINT AS distinct_texts, max(c)::BIGINT AS most_common FROM (SELECT role, text, count(*) OVER (PARTITION BY role, text) AS c FROM conversations) GROUP BY 1")
def t9(spark, sf):
    g = t(spark, sf, "conversations").groupBy("role", F.md5("text").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    return g.groupBy("role").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct_texts"), F.max("c").alias("most_common"))


_I = f"{_M}, tr AS (SELECT q.query AS item_id, q.s AS truth, max(d.s) FILTER (rank = 1) AS clf, max(d.s) FILTER (rank = 2) AS gen FROM qs q JOIN rk ON rk.query = q.query JOIN ds d ON d.id = rk.id GROUP BY 1, 2)"
_INT, _EXC = "len(list_intersect({0}, {1}))", "len(list_filter({0}, lambda x: NOT list_contains({1}, x)))"


def triples(spark, sf):
    """item_id, truth, clf, gen."""
    docs = sets(t(spark, sf, "documents"), "doc_id", "id")
    top = bm25_top(spark, sf, 2).join(docs, "id").groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("s"))).alias("clf"), F.max(F.when(F.col("rank") == 2, F.col("s"))).alias("gen"))
    q = sets(t(spark, sf, "benchmark"), "item_id", "query").filter("size(s) > 0")
    return q.join(top, "query").select(F.col("query").alias("item_id"), F.col("s").alias("truth"), "clf", "gen")


_n = lambda f, a, b: F.size(f(a, b)).cast("long")


@query("i1_precision_recall", f"WITH {_I}, c AS (SELECT item_id, {_INT.format('gen', 'truth')} AS tp, {_EXC.format('gen', 'truth')} AS fp, {_EXC.format('truth', 'gen')} AS fn FROM tr) SELECT item_id, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def i1(spark, sf):
    c = triples(spark, sf).select("item_id", _n(F.array_intersect, "gen", "truth").alias("tp"), _n(F.array_except, "gen", "truth").alias("fp"), _n(F.array_except, "truth", "gen").alias("fn"))
    return c.select("*", *[r6(v).alias(k) for k, v in G.prf(F.col("tp"), F.col("fp"), F.col("fn")).items()])


@query("i1b_per_class", f"WITH {_I}, k AS (SELECT unnest({_KW}) AS cls) SELECT cls, count(*) FILTER (list_contains(gen, cls) AND list_contains(truth, cls))::BIGINT AS tp, count(*) FILTER (list_contains(gen, cls) AND NOT list_contains(truth, cls))::BIGINT AS fp, count(*) FILTER (NOT list_contains(gen, cls) AND list_contains(truth, cls))::BIGINT AS fn FROM tr, k GROUP BY 1")
def i1b(spark, sf):
    x = triples(spark, sf).select("truth", "gen", F.explode(F.array(*map(F.lit, KEYS))).alias("cls"))
    g, y = F.array_contains("gen", F.col("cls")), F.array_contains("truth", F.col("cls"))
    return x.groupBy("cls").agg(F.count_if(g & y).alias("tp"), F.count_if(g & ~y).alias("fp"), F.count_if(~g & y).alias("fn"))


@query("i2_propagation", f"WITH {_I}, f AS (SELECT item_id, list_filter(clf, lambda x: NOT list_contains(truth, x)) AS fp, list_intersect(clf, truth) AS tp, gen, clf, truth FROM tr) SELECT item_id, len(fp)::BIGINT AS clf_fp, len(list_intersect(fp, gen))::BIGINT AS fp_mentioned, len(tp)::BIGINT AS clf_tp, len(list_intersect(tp, gen))::BIGINT AS tp_retained, len(list_filter(gen, lambda x: NOT list_contains(clf, x) AND NOT list_contains(truth, x)))::BIGINT AS unexplained FROM f")
def i2(spark, sf):
    f = triples(spark, sf).withColumn("fp", F.array_except("clf", "truth")).withColumn("tp", F.array_intersect("clf", "truth"))
    return f.select("item_id", F.size("fp").cast("long").alias("clf_fp"), _n(F.array_intersect, "fp", "gen").alias("fp_mentioned"), F.size("tp").cast("long").alias("clf_tp"), _n(F.array_intersect, "tp", "gen").alias("tp_retained"), F.size(F.array_except(F.array_except("gen", "clf"), F.col("truth"))).cast("long").alias("unexplained"))


@query("i3_pooled_rates", f"WITH {_I}, c AS (SELECT {_EXC.format('gen', 'truth')} AS fp, {_EXC.format('truth', 'gen')} AS fn, len(truth) AS t FROM tr) SELECT round(avg((fp > 0)::INT), 6) AS hallucination_rate, round(sum(fn)::DOUBLE / nullif(sum(t), 0), 6) AS omission_rate, count(*)::BIGINT AS n FROM c")
def i3(spark, sf):
    c = triples(spark, sf).select(F.size(F.array_except("gen", "truth")).alias("fp"), F.size(F.array_except("truth", "gen")).alias("fn"), F.size("truth").alias("t"))
    return c.agg(r6(F.avg((F.col("fp") > 0).cast("int"))).alias("hallucination_rate"), r6(F.try_divide(F.sum("fn").cast("double"), F.sum("t").cast("double"))).alias("omission_rate"), F.count(F.lit(1)).alias("n"))


_SUP = f"{_I}, sp AS (SELECT rk.query AS item_id, k, count(*) FILTER (list_contains(d.s, k)) AS n FROM rk JOIN ds d ON d.id = rk.id CROSS JOIN (SELECT unnest({_KW}) AS k) WHERE rank <= 5 GROUP BY 1, 2)"


def support(spark, sf):
    docs = sets(t(spark, sf, "documents"), "doc_id", "id")
    x = bm25_top(spark, sf, 5).join(docs, "id").select(F.col("query").alias("item_id"), "rank", "s", F.explode(F.array(*map(F.lit, KEYS))).alias("k"))
    return x.groupBy("item_id", "k").agg(F.count_if(F.array_contains("s", F.col("k"))).alias("n"))


@query("i4_support_buckets", f"WITH {_SUP} SELECT CASE WHEN n = 0 THEN 'none' WHEN n <= 2 THEN 'few' ELSE 'many' END AS bucket, list_contains(truth, k) AS in_truth, count(*)::BIGINT AS n, round(avg(list_contains(gen, k)::INT), 6) AS mention_rate FROM sp JOIN tr USING (item_id) GROUP BY 1, 2")
def i4(spark, sf):
    x = support(spark, sf).join(triples(spark, sf), "item_id")
    return x.groupBy(F.when(F.col("n") == 0, "none").when(F.col("n") <= 2, "few").otherwise("many").alias("bucket"), F.array_contains("truth", F.col("k")).alias("in_truth")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.array_contains("gen", F.col("k")).cast("int"))).alias("mention_rate"))


@query("i5_context_utilisation", f"WITH {_I} SELECT rank, count(*)::BIGINT AS supporting FROM (SELECT item_id, unnest(gen) AS k FROM tr) g JOIN rk ON rk.query = g.item_id JOIN ds d ON d.id = rk.id AND list_contains(d.s, k) GROUP BY 1")
def i5(spark, sf):
    docs = sets(t(spark, sf, "documents"), "doc_id", "id")
    g = triples(spark, sf).select(F.col("item_id").alias("query"), F.explode("gen").alias("k"))
    return bm25_top(spark, sf, 10).join(docs, "id").join(g, "query").filter(F.array_contains("s", F.col("k"))).groupBy("rank").agg(F.count(F.lit(1)).alias("supporting"))


@query("i6_introduced_and_removed", f"WITH {_I} SELECT 'introduced' AS kind, k, count(*)::BIGINT AS n, count(*) FILTER (list_contains(truth, k))::BIGINT AS correct FROM (SELECT truth, unnest(list_filter(gen, lambda x: NOT list_contains(clf, x))) AS k FROM tr) GROUP BY 1, 2 UNION ALL SELECT 'removed', k, count(*)::BIGINT, count(*) FILTER (NOT list_contains(truth, k))::BIGINT FROM (SELECT truth, unnest(list_filter(clf, lambda x: NOT list_contains(gen, x))) AS k FROM tr) GROUP BY 1, 2")
def i6(spark, sf):
    x = triples(spark, sf)
    side = lambda kind, a, b, good: x.select("truth", F.explode(F.array_except(a, b)).alias("k")).groupBy(F.lit(kind).alias("kind"), "k").agg(F.count(F.lit(1)).alias("n"), F.count_if(good(F.array_contains("truth", F.col("k")))).alias("correct"))
    return side("introduced", "gen", "clf", lambda c: c).unionByName(side("removed", "clf", "gen", lambda c: ~c))


@query("i7_decision_coverage", f"WITH {_I}, s AS (SELECT *, CASE WHEN len(gen) >= 3 THEN 'abnormal' WHEN len(gen) = 0 THEN 'normal' ELSE 'indeterminate' END AS state, len(truth) >= 3 AS abnormal FROM tr) SELECT state, count(*)::BIGINT AS n, count(*) FILTER (abnormal)::BIGINT AS truly_abnormal, round(avg((state <> 'indeterminate')::INT), 6) AS decided FROM s GROUP BY 1")
def i7(spark, sf):
    state = F.when(F.size("gen") >= 3, "abnormal").when(F.size("gen") == 0, "normal").otherwise("indeterminate")
    return triples(spark, sf).withColumn("state", state).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("truth") >= 3).alias("truly_abnormal"), r6(F.avg((F.col("state") != "indeterminate").cast("int"))).alias("decided"))


#: Ten kinds of failure, as a condition in SQL and over columns; a row may have several. State: three sets or more are abnormal, none
#: normal, else undecided. The context is what the five best documents hold.
_EXTRA = lambda a, b: f"len(list_filter({a}, lambda x: NOT list_contains({b}, x))) > 0"
_FAIL = [
    ("classifier_error", "list_sort(clf) <> list_sort(truth)"), ("state_mismatch", "state <> 'undecided' AND (state = 'normal') <> (len(truth) = 0)"), ("retrieval_mismatch", "len(ctx) > 0 AND len(list_intersect(truth, ctx)) = 0"),
    ("context_only_unsupported", "len(list_filter(gen, lambda x: list_contains(ctx, x) AND NOT list_contains(clf, x) AND NOT list_contains(truth, x))) > 0"), ("omission", _EXTRA("truth", "gen")), ("hallucination", _EXTRA("gen", "truth")),
    ("abnormal_routed_normal_text", "state = 'abnormal' AND len(gen) = 0"), ("abstention", "state = 'undecided'"), ("corpus_limit", "NOT in_corpus"), ("reference_limit", "reference_limited"),
]
_TX = f"{_I}, cx AS (SELECT rk.query AS item_id, list_distinct(flatten(list(d.s))) AS ctx FROM rk JOIN ds d ON d.id = rk.id WHERE rank <= 5 GROUP BY 1), ks AS (SELECT DISTINCT array_to_string(list_sort(s), ',') AS k FROM ds), tx AS (SELECT tr.*, ctx, CASE WHEN len(clf) >= 3 THEN 'abnormal' WHEN len(clf) = 0 THEN 'normal' ELSE 'undecided' END AS state, array_to_string(list_sort(truth), ',') IN (SELECT k FROM ks) AS in_corpus, len(truth) = 1 AS reference_limited FROM tr JOIN cx USING (item_id)), fl AS (SELECT item_id, [{', '.join(c for _, c in _FAIL)}] AS f FROM tx)"


def failures(spark, sf):
    """item_id, f: an array of booleans in order of _FAIL."""
    docs = sets(t(spark, sf, "documents"), "doc_id", "id")
    context = bm25_top(spark, sf, 5).join(docs, "id").groupBy(F.col("query").alias("item_id")).agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("ctx"))
    known = docs.select(F.array_sort("s").alias("key")).distinct().withColumn("in_corpus", F.lit(True))
    x = triples(spark, sf).join(context, "item_id").withColumn("key", F.array_sort("truth")).join(known, "key", "left")
    some = lambda a, b: F.size(F.array_except(a, b)) > 0
    state = F.when(F.size("clf") >= 3, "abnormal").when(F.size("clf") == 0, "normal").otherwise("undecided")
    rules = [
        F.array_sort("clf") != F.array_sort("truth"), (state != "undecided") & ((state == "normal") != (F.size("truth") == 0)), (F.size("ctx") > 0) & ~F.arrays_overlap("truth", "ctx"),
        F.size(F.array_except(F.array_except(F.array_intersect("gen", "ctx"), F.col("clf")), F.col("truth"))) > 0, some("truth", "gen"), some("gen", "truth"),
        (state == "abnormal") & (F.size("gen") == 0), state == "undecided", F.col("in_corpus").isNull(), F.size("truth") == 1,
    ]
    return x.select("item_id", F.array(*rules).alias("f"))


_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in _FAIL) + "]"


@query("i8_failure_taxonomy", f"WITH {_TX}, e AS (SELECT unnest({_NAMES}) AS category, unnest(f) AS hit FROM fl) SELECT category, count(*) FILTER (hit)::BIGINT AS n, round(100.0 * count(*) FILTER (hit) / count(*), 4)::DOUBLE AS pct FROM e GROUP BY 1 UNION ALL SELECT 'none_of_the_first_eight', count(*) FILTER (NOT list_contains(f[1:8], true))::BIGINT, round(100.0 * count(*) FILTER (NOT list_contains(f[1:8], true)) / count(*), 4)::DOUBLE FROM fl")
def i8(spark, sf):
    none = ~F.exists(F.slice("f", 1, 8), lambda x: x)
    names = [*(n for n, _ in _FAIL), "none_of_the_first_eight"]
    one = failures(spark, sf).select(F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("category"), F.concat("f", F.array(none)).alias("hit"))).alias("x")).select("x.category", "x.hit")
    return one.groupBy("category").agg(F.count_if("hit").alias("n"), F.round(100.0 * F.count_if("hit") / F.count(F.lit(1)), 4).alias("pct"))


@query("i8b_failures_per_study", f"WITH {_TX} SELECT item_id, array_to_string(list_filter(list_transform(range(1, 11), lambda i: CASE WHEN f[i] THEN ({_NAMES})[i] END), lambda x: x IS NOT NULL), ';') AS categories FROM fl")
def i8b(spark, sf):
    named = F.filter(F.zip_with("f", F.array(*[F.lit(n) for n, _ in _FAIL]), lambda hit, n: F.when(hit, n)), lambda n: n.isNotNull())
    return failures(spark, sf).select("item_id", F.array_join(named, ";").alias("categories"))


@query("f6_agreement", f"WITH {_I}, k AS (SELECT unnest({_KW}) AS cls) SELECT cls, round(count(*) FILTER (list_contains(clf, cls) AND list_contains(truth, cls))::DOUBLE / nullif(count(*) FILTER (list_contains(clf, cls)), 0), 6) AS precision, round(count(*) FILTER (list_contains(clf, cls) AND list_contains(truth, cls))::DOUBLE / nullif(count(*) FILTER (list_contains(truth, cls)), 0), 6) AS recall FROM tr, k GROUP BY 1")
def f6(spark, sf):
    x = triples(spark, sf).select("truth", "clf", F.explode(F.array(*map(F.lit, KEYS))).alias("cls"))
    c, y = F.array_contains("clf", F.col("cls")), F.array_contains("truth", F.col("cls"))
    both = F.count_if(c & y).cast("double")
    return x.groupBy("cls").agg(r6(F.try_divide(both, F.count_if(c).cast("double"))).alias("precision"), r6(F.try_divide(both, F.count_if(y).cast("double"))).alias("recall"))
