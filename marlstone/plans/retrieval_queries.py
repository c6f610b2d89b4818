"""Queries: retrieval and its metrics. Queries are the benchmark passages, the corpus is documents; a document's vector is the
one of the same number, a passage's dense query the mean vector of class item_id mod 10."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import ordered
from ..operators import retrieval as R
from ..sources import files
from .base import r6, t
from .registry import query

KEYS = ["the", "and", "of", "der", "und", "la", "et", "que", "con", "los"]
_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_BM = f"""tk AS (SELECT doc_id AS id, unnest({_TOK}) AS token FROM documents), tf AS (SELECT id, token, count(*) AS tf FROM tk GROUP BY 1, 2), dl AS (SELECT doc_id AS id, len({_TOK}) AS dl FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), qt AS (SELECT DISTINCT item_id AS query, unnest({_TOK}) AS token FROM benchmark),
bs AS (SELECT query, tf.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN df USING (token) JOIN tf USING (token) JOIN dl ON dl.id = tf.id, st GROUP BY 1, 2),
al AS (SELECT b.item_id AS query, d.doc_id AS id, coalesce(bs.score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN bs ON bs.query = b.item_id AND bs.id = d.doc_id),
bm AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM al)"""
_CEN = """em AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), cen AS (SELECT label, i, avg(x) AS m FROM em GROUP BY 1, 2)"""
_DN = f"""{_CEN}, dt AS (SELECT c.label, e.vec_id AS id, round(sum(e.x * c.m), 9) AS score FROM em e JOIN cen c ON c.i = e.i GROUP BY 1, 2), dr AS (SELECT label, id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank FROM dt)"""
_RRF = f"""{_BM}, {_DN}, x AS (SELECT query, id, rank AS ra FROM bm WHERE rank <= 100 AND score > 0), y AS (SELECT item_id AS query, id, rank AS rb FROM benchmark JOIN dr ON dr.label = item_id % 10 WHERE rank <= 100),
fu AS (SELECT coalesce(x.query, y.query) AS query, coalesce(x.id, y.id) AS id, coalesce(1.0::DOUBLE / (60 + ra), 0) + coalesce(1.0::DOUBLE / (60 + rb), 0) AS score, ra, rb FROM x FULL JOIN y ON x.query = y.query AND x.id = y.id), fr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM fu)"""


def tokens_of(spark, sf):
    docs = t(spark, sf, "documents")
    toks = text.tokens(F.col("text"))
    size = docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size(toks)).alias("avgdl"))
    asked = t(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.explode(toks).alias("token")).distinct()
    return R.postings(docs, toks, "doc_id"), asked, size


def lexical_top(spark, sf, k):
    """query, rank, id, score: each passage's k best documents of those that share a token with it."""
    toks = text.tokens(F.col("text"))
    asked = t(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.explode(toks).alias("token")).distinct()
    return R.lexical(t(spark, sf, "documents").select(F.col("doc_id").alias("id"), toks.alias("t")), asked, k)


def bm25_top(spark, sf, k):
    every = t(spark, sf, "benchmark").select(F.col("item_id").alias("query"))
    return R.fill_zero(lexical_top(spark, sf, k), every, t(spark, sf, "documents").select(F.col("doc_id").alias("id")), k)


def class_means(spark, sf):
    e = t(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return e.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("q"))


def vectors(spark, sf):
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def dense_top(spark, sf, k):
    """query (class), rank, id, score; the classes are a fixed, small set of queries."""
    return R.dense(vectors(spark, sf), class_means(spark, sf).withColumnRenamed("label", "query"), k)


def dense_for_items(spark, sf, k):
    items = t(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 10).cast("int").alias("query"))
    return dense_top(spark, sf, k).join(items, "query").select(F.col("item_id").alias("query"), "rank", "id", "score")


def fused(spark, sf):
    return R.rrf(lexical_top(spark, sf, 100), dense_for_items(spark, sf, 100))


@query("f1_bm25_topk", f"WITH {_BM} SELECT query AS item_id, rank, id AS doc_id, round(score, 6) AS score FROM bm WHERE rank <= 10")
def f1(spark, sf):
    return bm25_top(spark, sf, 10).select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), r6("score").alias("score"))


@query("j8_token_lookup", f"WITH {_BM} SELECT query AS item_id, token, df, count(*)::BIGINT AS hits, sum(tf)::BIGINT AS total FROM qt JOIN df USING (token) JOIN tf USING (token) GROUP BY 1, 2, 3")
def j8(spark, sf):
    """What each passage's tokens find. Only asked tokens leave the task that reads a document, and they are counted by token before they meet
    the passages."""
    toks = text.tokens(F.col("text"))
    asked = files.written(t(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.explode(toks).alias("token")).distinct(), "asked")
    read = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(toks).alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    tf = read.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    found = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    return asked.join(found, "token").select(F.col("query").alias("item_id"), "token", "df", F.col("df").alias("hits"), "total")


@query("f2_dense_topk", f"WITH {_DN} SELECT label, rank, id AS vec_id, round(score, 6) AS score FROM dr WHERE rank <= 10")
def f2(spark, sf):
    return dense_top(spark, sf, 10).select(F.col("query").alias("label"), "rank", F.col("id").alias("vec_id"), r6("score").alias("score"))


@query("j7_query_corpus_scores", f"WITH {_DN} SELECT label, id AS vec_id, round(score, 6) AS score FROM dr")
def j7(spark, sf):
    q = class_means(spark, sf)
    return vectors(spark, sf).join(F.broadcast(q)).select("label", F.col("id").alias("vec_id"), r6(F.round(R.dot("v", "q"), 9)).alias("score"))  # a row for each class


@query("f3_rank_fusion", f"WITH {_RRF} SELECT query AS item_id, rank, id AS doc_id, round(score, 6) AS score, ra AS bm25_rank, rb AS dense_rank FROM fr WHERE rank <= 10")
def f3(spark, sf):
    f = fused(spark, sf)
    w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "id")
    return f.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select(F.col("query").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), r6("score").alias("score"), F.col("rank_a").alias("bm25_rank"), F.col("rank_b").alias("dense_rank"))


_MMR = f"""{_RRF}, vv AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), po AS (SELECT query, id, rank, v, score - min(score) OVER (PARTITION BY query) AS up, max(score) OVER (PARTITION BY query) - min(score) OVER (PARTITION BY query) AS width FROM fr JOIN vv USING (id) WHERE rank <= 30),
ca AS (SELECT query, id, rank, CASE WHEN width > 0 THEN up / width ELSE 0 END AS rel FROM po), sm AS (SELECT x.query, x.id AS a, y.id AS b, list_inner_product(x.v, y.v) AS sim FROM po x JOIN po y ON x.query = y.query),
mm(query, n, picked) AS (SELECT DISTINCT query, 0, []::BIGINT[] FROM ca UNION ALL SELECT query, n + 1, list_append(picked, arg_max(id, (value, -rank))) FROM (SELECT mm.query, n, picked, ca.id, ca.rank, CASE WHEN n = 0 THEN max(rel) ELSE 0.7 * max(rel) - 0.3 * max(sim) END AS value FROM mm JOIN ca ON ca.query = mm.query AND NOT list_contains(picked, ca.id) LEFT JOIN sm ON sm.query = mm.query AND sm.a = ca.id AND list_contains(picked, sm.b) WHERE n < 10 GROUP BY mm.query, n, picked, ca.id, ca.rank) GROUP BY query, n, picked)"""


@query("f4_mmr", f"WITH RECURSIVE {_MMR}, la AS (SELECT query, arg_max(picked, n) AS picked FROM mm GROUP BY 1) SELECT query AS item_id, unnest(range(1, len(picked) + 1))::BIGINT AS rank, unnest(picked) AS doc_id FROM la")
def f4(spark, sf):
    pool = R.top_k(fused(spark, sf), 30).join(vectors(spark, sf), "id")
    return R.mmr(pool, 0.7, 10).select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"))


@query("f5_weighted_query_vector", f"WITH {_CEN}, w AS (SELECT b.item_id, c.i, sum(CASE WHEN c.label = b.item_id % 10 THEN 0.7 ELSE 0.3 END * c.m) AS s FROM benchmark b JOIN cen c ON c.label IN (b.item_id % 10, (b.item_id + 3) % 10) GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(s * s)) AS nn FROM w GROUP BY 1) SELECT item_id, i::BIGINT AS i, round(s / nn, 6) AS x FROM w JOIN n USING (item_id)")
def f5(spark, sf):
    q = class_means(spark, sf)
    want = t(spark, sf, "benchmark").select("item_id", F.explode(F.array(F.struct((F.col("item_id") % 10).alias("label"), F.lit(0.7).alias("w")), F.struct(((F.col("item_id") + 3) % 10).alias("label"), F.lit(0.3).alias("w")))).alias("p")).select("item_id", "p.label", "p.w")
    s = want.join(F.broadcast(q), "label").select("item_id", "w", F.posexplode("q").alias("i", "m")).groupBy("item_id", "i").agg(F.sum(F.col("w") * F.col("m")).alias("s"))  # a row for each class
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("item_id")))
    return s.select("item_id", (F.col("i") + 1).cast("long").alias("i"), r6(F.col("s") / norm).alias("x"))


@query("f7_hybrid_pipeline", f"WITH {_RRF} SELECT query AS item_id, count(*)::BIGINT AS n, sum(id)::BIGINT AS ids, count(ra)::BIGINT AS from_bm25, count(rb)::BIGINT AS from_dense FROM fr WHERE rank <= 30 GROUP BY 1")
def f7(spark, sf):
    f = fused(spark, sf)
    w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "id")
    top = f.withColumn("rank", F.row_number().over(w)).filter("rank <= 30")
    return top.groupBy(F.col("query").alias("item_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.count("rank_a").alias("from_bm25"), F.count("rank_b").alias("from_dense"))


@query("f8_sham_control", f"WITH {_BM}, n AS (SELECT max(doc_id) + 1 AS n FROM documents), dw AS (SELECT item_id, j, ('0x' || substr(md5('sham|' || item_id || '|' || j), 1, 12))::BIGINT % n AS doc_id FROM benchmark, range(20) r(j), n), fs AS (SELECT item_id, doc_id, min(j) AS j FROM dw WHERE NOT EXISTS (SELECT 1 FROM bm WHERE bm.query = item_id AND bm.id = dw.doc_id AND bm.rank <= 10) AND doc_id IN (SELECT doc_id FROM documents) GROUP BY 1, 2) SELECT item_id, rank, doc_id FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY j) AS rank FROM fs) WHERE rank <= 5")
def f8(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id")
    n = docs.agg((F.max("doc_id") + 1).alias("n"))
    draws = t(spark, sf, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("j")).join(F.broadcast(n))  # one row
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("sham|"), F.col("item_id").cast("string"), F.lit("|"), F.col("j").cast("string"))), 1, 12), 16, 10).cast("long") % F.col("n")
    kept = draws.select("item_id", "j", draw.alias("doc_id")).join(docs, "doc_id", "left_semi")
    kept = kept.join(bm25_top(spark, sf, 10).select(F.col("query").alias("item_id"), F.col("id").alias("doc_id")), ["item_id", "doc_id"], "left_anti").groupBy("item_id", "doc_id").agg(F.min("j").alias("j"))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("j"))).filter("rank <= 5").select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id")


# ---- metrics: a text's set is the key words it has; a text without any is unusable.
_KW = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"
_M = f"""{_BM}, ds AS (SELECT doc_id AS id, list_filter({_KW}, lambda k: list_contains({_TOK}, k)) AS s, n_chars, {_TOK} AS tok FROM documents), qs AS (SELECT item_id AS query, list_filter({_KW}, lambda k: list_contains({_TOK}, k)) AS s FROM benchmark),
ga AS (SELECT q.query, d.id, CASE WHEN len(d.s) = 0 THEN 0 ELSE len(list_intersect(q.s, d.s))::DOUBLE / nullif(len(list_distinct(list_concat(q.s, d.s))), 0) END AS gain, len(d.s) > 0 AND list_sort(d.s) = list_sort(q.s) AS exact FROM qs q CROSS JOIN ds d WHERE len(q.s) > 0),
rk AS (SELECT g.*, bm.rank FROM ga g JOIN bm ON bm.query = g.query AND bm.id = g.id WHERE bm.rank <= 10)"""


def sets(df, key, name):
    toks = text.tokens(F.col("text"))
    return df.select(F.col(key).alias(name), F.array_intersect(F.array(*map(F.lit, KEYS)), toks).alias("s"))


def _world(spark, sf):
    docs = sets(t(spark, sf, "documents"), "doc_id", "id")
    asked = sets(t(spark, sf, "benchmark"), "item_id", "query").filter("size(s) > 0").withColumnRenamed("s", "qs")
    return docs, asked


def gains(spark, sf):
    """query, rank, id, gain, exact of the ten best documents."""
    docs, asked = _world(spark, sf)
    top = bm25_top(spark, sf, 10).select("query", "rank", "id").join(asked, "query").join(docs, "id")
    gain = F.when(F.size("s") == 0, 0.0).otherwise(R.jaccard("qs", "s"))
    return top.select("query", "rank", "id", gain.alias("gain"), ((F.size("s") > 0) & (F.array_sort("s") == F.array_sort("qs"))).alias("exact"), "s", "qs")


def corpus_gains(spark, sf):
    """query, gain, n over the whole corpus: documents count by set, of which there are at most 2^len(KEYS)."""
    docs, asked = _world(spark, sf)
    by_set = docs.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    g = asked.join(F.broadcast(by_set)).select("query", F.when(F.size("s") == 0, 0.0).otherwise(R.jaccard("qs", "s")).alias("gain"), "n")
    return g.groupBy("query", "gain").agg(F.sum("n").alias("n"))


@query("m1_set_jaccard", f"WITH {_M} SELECT query AS item_id, rank, id AS doc_id, round(gain, 6) AS gain FROM rk")
def m1(spark, sf):
    return gains(spark, sf).select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), r6("gain").alias("gain"))


@query("m2_ndcg", f"WITH {_M}, dc AS (SELECT query, sum(gain / log2(rank + 1)) AS dcg FROM rk GROUP BY 1), ir AS (SELECT query, gain, row_number() OVER (PARTITION BY query ORDER BY gain DESC) AS r FROM ga), ic AS (SELECT query, sum(gain / log2(r + 1)) AS idcg FROM ir WHERE r <= 10 GROUP BY 1) SELECT ic.query AS item_id, round(CASE WHEN idcg > 0 THEN dcg / idcg END, 6) AS ndcg FROM ic LEFT JOIN dc USING (query)")
def m2(spark, sf):
    return R.ndcg(gains(spark, sf), corpus_gains(spark, sf), 10).select(F.col("query").alias("item_id"), r6("ndcg").alias("ndcg"))


@query("m3_hit_and_reciprocal_rank", f"WITH {_M}, ex AS (SELECT query, bool_or(exact) AS possible FROM ga GROUP BY 1), fr AS (SELECT query, min(rank) FILTER (exact) AS first FROM rk GROUP BY 1) SELECT query AS item_id, CASE WHEN possible THEN (first IS NOT NULL)::INT END AS hit, round(CASE WHEN possible THEN coalesce(1.0 / first, 0) END, 6) AS rr FROM ex JOIN fr USING (query)")
def m3(spark, sf):
    docs, asked = _world(spark, sf)
    have = docs.filter("size(s) > 0").select(F.array_sort("s").alias("k")).distinct()
    possible = asked.withColumn("k", F.array_sort("qs")).join(have.withColumn("possible", F.lit(True)), "k", "left").select("query", F.coalesce("possible", F.lit(False)).alias("possible"))
    first = gains(spark, sf).groupBy("query").agg(F.min(F.when(F.col("exact"), F.col("rank"))).alias("first"))
    ok = F.col("possible")
    return possible.join(first, "query").select(F.col("query").alias("item_id"), F.when(ok, F.col("first").isNotNull().cast("int")).alias("hit"), r6(F.when(ok, F.coalesce(1.0 / F.col("first"), F.lit(0.0)))).alias("rr"))


@query("m4_ranking_summary", f"WITH {_M}, vv AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), pc AS (SELECT a.query, avg(list_cosine_similarity(x.v, y.v)) AS c FROM rk a JOIN rk b ON a.query = b.query AND a.id < b.id JOIN vv x ON x.id = a.id JOIN vv y ON y.id = b.id GROUP BY 1) SELECT rk.query AS item_id, round(len(list_intersect(any_value(q.s), list_distinct(flatten(list(d.s)))))::DOUBLE / len(any_value(q.s)), 6) AS union_coverage, round(avg((gain = 0)::INT), 6) AS zero_overlap, round(1 - count(DISTINCT array_to_string(d.tok, ' '))::DOUBLE / 10, 6) AS duplicate_rate, count(DISTINCT array_to_string(d.tok, ' '))::BIGINT AS unique_templates, sum(len(d.tok))::BIGINT AS context_tokens, round(any_value(pc.c), 6) AS mean_pairwise_cosine FROM rk JOIN qs q ON q.query = rk.query JOIN ds d ON d.id = rk.id LEFT JOIN pc ON pc.query = rk.query GROUP BY 1")
def m4(spark, sf):
    toks = text.tokens(F.col("text"))
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(F.array_join(toks, " ")).alias("norm"), F.size(toks).alias("n"))
    top = files.written(gains(spark, sf), "top")
    # The sum of all pairs' cosines is the square of the unit vectors' sum, less one for each.
    v = vectors(spark, sf)
    unit = top.select("query", "id").join(v.select("id", "v", F.sqrt(R.dot("v", "v")).alias("norm")), "id").select("query", F.posexplode("v").alias("i", "x"), "norm", F.lit(1).alias("one"))
    sums = unit.groupBy("query", "i").agg(F.sum(F.col("x") / F.col("norm")).alias("s"), F.sum("one").alias("n")).groupBy("query").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))
    cosine = sums.filter("n > 1").select("query", ((F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("cosine"))
    g = top.join(d, "id").groupBy("query").agg(F.first("qs").alias("qs"), F.array_distinct(F.flatten(F.collect_list("s"))).alias("u"), F.avg((F.col("gain") == 0).cast("int")).alias("z"), F.count_distinct("norm").alias("k"), F.sum("n").alias("context_tokens"))
    return g.join(cosine, "query", "left").select(F.col("query").alias("item_id"), r6(F.size(F.array_intersect("qs", "u")) / F.size("qs")).alias("union_coverage"), r6("z").alias("zero_overlap"), r6(1 - F.col("k") / 10).alias("duplicate_rate"), F.col("k").alias("unique_templates"), "context_tokens", r6("cosine").alias("mean_pairwise_cosine"))


@query("m5_random_expectation", f"WITH {_M} SELECT query AS item_id, round(avg(gain), 6) AS expected FROM ga GROUP BY 1")
def m5(spark, sf):
    return corpus_gains(spark, sf).groupBy(F.col("query").alias("item_id")).agg(r6(F.sum(F.col("gain") * F.col("n")) / F.sum("n")).alias("expected"))


@query("m6_empty_query_as_failure", f"WITH {_M}, a AS (SELECT query, avg(gain) AS g FROM rk WHERE rank <= 5 GROUP BY 1) SELECT round(avg(coalesce(g, 0)), 6) AS mean_all, round(avg(g), 6) AS mean_answered, count(*)::BIGINT AS n FROM benchmark LEFT JOIN a ON a.query = item_id")
def m6(spark, sf):
    a = gains(spark, sf).filter("rank <= 5").groupBy("query").agg(F.avg("gain").alias("g"))
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("query")).join(a, "query", "left").agg(r6(F.avg(F.coalesce("g", F.lit(0.0)))).alias("mean_all"), r6(F.avg("g")).alias("mean_answered"), F.count(F.lit(1)).alias("n"))


@query("m7_self_retrieval", f"WITH {_BM} SELECT b.item_id, bool_or(contains(d.text, b.text)) AS verbatim, count(*)::BIGINT AS n FROM benchmark b JOIN bm ON bm.query = b.item_id JOIN documents d ON d.doc_id = bm.id WHERE rank <= 10 GROUP BY 1")
def m7(spark, sf):
    b, d = t(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("q")), t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return bm25_top(spark, sf, 10).join(b, "query").join(d, "id").groupBy(F.col("query").alias("item_id")).agg(F.bool_or(F.contains("text", "q")).alias("verbatim"), F.count(F.lit(1)).alias("n"))


@query("m8_error_attribution", f"WITH {_M}, a AS (SELECT query, avg(gain) AS g, max(gain) AS best, count(*) FILTER (gain = 0) AS zero FROM rk GROUP BY 1) SELECT query AS item_id, CASE WHEN g >= 0.7 THEN 'good' WHEN g >= 0.3 THEN 'partial' ELSE 'poor' END AS outcome, CASE WHEN g >= 0.7 THEN 'none' WHEN best = 0 THEN 'no_overlap' WHEN zero > 5 THEN 'mostly_off_topic' WHEN best >= 0.99 THEN 'ranking' ELSE 'coverage' END AS cause FROM a")
def m8(spark, sf):
    """Gains are multiples of 1/2520 (unions have at most ten keys), so at 9 places a mean of ten that equals a limit meets it, in whatever
    order it was summed."""
    a = gains(spark, sf).groupBy("query").agg(F.round(F.avg("gain"), 9).alias("g"), F.max("gain").alias("best"), F.count_if(F.col("gain") == 0).alias("zero"))
    good = F.col("g") >= 0.7
    return a.select(F.col("query").alias("item_id"), F.when(good, "good").when(F.col("g") >= 0.3, "partial").otherwise("poor").alias("outcome"), F.when(good, "none").when(F.col("best") == 0, "no_overlap").when(F.col("zero") > 5, "mostly_off_topic").when(F.col("best") >= 0.99, "ranking").otherwise("coverage").alias("cause"))


@query("m9_domain_shift", "SELECT lang, round(avg(n_chars), 6) AS mean_chars, round(quantile_cont(n_chars, 0.5), 6) AS median_chars, round(avg((toxic = 1)::INT), 6) AS toxic_share, count(*)::BIGINT AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def m9(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    g = d.groupBy("lang").agg(r6(F.avg("n_chars")).alias("mean_chars"), r6(F.avg((F.col("toxic") == 1).cast("int"))).alias("toxic_share"), F.count(F.lit(1)).alias("n"))
    return ordered.match(g, ordered.quantiles(d, ["lang"], "n_chars", [0.5]).select("lang", r6(F.col("q")[0]).alias("median_chars")), ["lang"], "left")


@query("t7_evidence_support", f"WITH {_M} SELECT rk.query AS item_id, k AS finding, count(*) FILTER (list_contains(d.s, k))::BIGINT AS support, count(*)::BIGINT AS of FROM rk JOIN ds d ON d.id = rk.id JOIN (SELECT query, unnest(s) AS k FROM qs) u ON u.query = rk.query WHERE rank <= 5 GROUP BY 1, 2")
def t7(spark, sf):
    g = gains(spark, sf).filter("rank <= 5").select("query", "s", F.explode("qs").alias("finding"))
    return g.groupBy(F.col("query").alias("item_id"), "finding").agg(F.count_if(F.array_contains("s", F.col("finding"))).alias("support"), F.count(F.lit(1)).alias("of"))
