"""Queries: scans, audits, joins, aggregates, windows, set operations, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import images
from ..operators import ordered
from ..operators import relational as R
from ..sources import files
from .base import STATES, r6, states, t
from .registry import query

WS = r"[\t\n\x0B\f\r ]+"
_WORDS = rf"(CASE WHEN trim(regexp_replace(text, '{WS}', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '{WS}', ' ', 'g')), ' ')) END)"
_KEY = rf"trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '{WS}', ' ', 'g'))"


def _strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("a1_typed_label_scan", f"SELECT doc_id, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic, md5(doc_id || ':' || quality) AS row_key FROM labels")
def a1(spark, sf):
    raw = _strings(t(spark, sf, "labels"))
    return raw.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("quality").try_cast("double").alias("quality"), F.col("toxic").try_cast("double").alias("toxic"), F.md5(F.concat_ws(":", "doc_id", "quality")).alias("row_key"))


@query("a2_report_scan", rf"SELECT doc_id::VARCHAR AS uid, length(trim(regexp_replace(text, '{WS}', ' ', 'g')))::BIGINT AS n, (count(*) OVER (PARTITION BY doc_id) > 1) AS repeated FROM documents")
def a2(spark, sf):
    d = t(spark, sf, "documents").withColumn("uid", F.coalesce(F.col("doc_id").cast("double").cast("long").cast("string"), F.col("doc_id").cast("string")))
    return d.select("uid", F.length(text.collapse(F.col("text"))).cast("long").alias("n"), (F.count(F.lit(1)).over(Window.partitionBy("uid")) > 1).alias("repeated"))


@query("a3_projection_scan", r"SELECT page_id, coalesce(nullif(regexp_extract(url, '://[^/]+/([a-z]+)/', 1), ''), 'Unknown') AS projection, lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS extension FROM pages")
def a3(spark, sf):
    ext = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return t(spark, sf, "pages").select("page_id", F.coalesce(F.nullif(F.regexp_extract("url", "://[^/]+/([a-z]+)/", 1), F.lit("")), F.lit("Unknown")).alias("projection"), ext.alias("extension"))


@query("a6_wide_predictions", "SELECT vec_id, max(p) FILTER (cls = 0) AS prob_0, max(p) FILTER (cls = 1) AS prob_1, max(y) FILTER (cls = 0) AS raw_0, max(y) FILTER (cls = 1) AS raw_1 FROM (SELECT vec_id, label % 10 AS cls, 1 AS y, round(embedding[1]::DOUBLE, 6) AS p FROM embeddings) GROUP BY vec_id")
def a6(spark, sf):
    long = t(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cls"), F.lit(1).alias("y"), F.round(F.col("embedding")[0].cast("double"), 6).alias("p"))
    at = lambda c, k: F.max(F.when(F.col("cls") == k, F.col(c)))
    return long.groupBy("vec_id").agg(at("p", 0).alias("prob_0"), at("p", 1).alias("prob_1"), at("y", 0).alias("raw_0"), at("y", 1).alias("raw_1"))


@query("a10_split_frame", "SELECT o.o_orderkey, c.c_mktsegment, o.o_totalprice FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity < 2)")
def a10(spark, sf):
    bad = t(spark, sf, "lineitem").filter("l_quantity < 2").select(F.col("l_orderkey").alias("o_orderkey"))
    kept = t(spark, sf, "orders").filter("o_orderstatus = 'O'").join(bad, "o_orderkey", "left_anti")
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return R.one_to_one(kept, c, ["o_custkey"]).select("o_orderkey", "c_mktsegment", "o_totalprice")


_AUDIT = """au AS (SELECT 'documents' AS dataset, 'warning' AS severity, 'short_text' AS issue, doc_id::VARCHAR AS record_id FROM documents WHERE n_chars < 100
UNION ALL SELECT 'documents', 'error', 'length_mismatch', doc_id::VARCHAR FROM documents WHERE n_chars <> length(text)
UNION ALL SELECT 'labels', 'info', 'toxic', doc_id::VARCHAR FROM labels WHERE toxic = 1)"""


@query("a14_audit_summary", f"WITH {_AUDIT} SELECT dataset, severity, issue, count(*)::BIGINT AS n FROM au GROUP BY 1, 2, 3")
def a14(spark, sf):
    d, labels = t(spark, sf, "documents"), t(spark, sf, "labels")
    row = lambda df, ds, sev, issue: df.select(F.lit(ds).alias("dataset"), F.lit(sev).alias("severity"), F.lit(issue).alias("issue"), F.col("doc_id").cast("string").alias("record_id"))
    return R.audit_summary(row(d.filter("n_chars < 100"), "documents", "warning", "short_text").unionByName(row(d.filter(F.col("n_chars") != F.length("text")), "documents", "error", "length_mismatch")).unionByName(row(labels.filter("toxic = 1"), "labels", "info", "toxic")))


@query("a15_round_trip", "SELECT max(abs(o_totalprice - round(o_totalprice, 1))) < 0.051 AS close, count(*) FILTER (o_totalprice = round(o_totalprice, 1)) AS identical, count(*) FILTER ((o_totalprice >= 100000) <> (round(o_totalprice, 1) >= 100000)) AS flips FROM orders")
def a15(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_totalprice").alias("a"), F.round("o_totalprice", 1).alias("b"))
    return o.agg((F.max(F.abs(F.col("a") - F.col("b"))) < 0.051).alias("close"), F.count_if(F.col("a") == F.col("b")).alias("identical"), F.count_if((F.col("a") >= 100000) != (F.col("b") >= 100000)).alias("flips"))


@query("a16_target_columns", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n_values, count(*) FILTER ({c} IS NOT NULL AND coalesce(try_cast({c} AS DOUBLE) NOT IN (-1, 0, 1), true)) AS n_bad, count(*) FILTER ({c} IS NOT NULL AND coalesce(try_cast({c} AS DOUBLE) NOT IN (-1, 0, 1), true)) = 0 AND count({c}) > 0 AS is_target FROM labels" for c in ("doc_id", "quality", "toxic")))
def a16(spark, sf):
    return R.target_columns(t(spark, sf, "labels"))


@query("a17_invalid_entries", "SELECT p_partkey, 'p_size' AS \"column\", p_size::VARCHAR AS value FROM part WHERE p_size NOT IN (-1, 0, 1) UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part")
def a17(spark, sf):
    return R.invalid_entries(t(spark, sf, "part"), ["p_partkey"], ["p_size", "p_brand"])


@query("a18_path_parse", r"WITH x AS (SELECT page_id, regexp_extract(replace(url, '\', '/'), '://([^/?#]+)/([a-z]+)/([0-9]+)', ['host', 'lang', 'number']) AS m, regexp_extract(url, '\.([a-z]+)$', 1) AS ext FROM pages) SELECT page_id, nullif(m.host, '') AS host, nullif(m.host || '/' || m.lang, '/') AS section, try_cast(m.number AS BIGINT) AS number, nullif(ext, '') AS ext FROM x")
def a18(spark, sf):
    rx = "://([^/?#]+)/([a-z]+)/([0-9]+)"
    u = F.replace("url", F.lit("\\"), F.lit("/"))
    g = lambda i: F.nullif(F.regexp_extract(u, rx, i), F.lit(""))
    return t(spark, sf, "pages").select("page_id", g(1).alias("host"), F.concat(g(1), F.lit("/"), g(2)).alias("section"), g(3).try_cast("long").alias("number"), F.nullif(F.regexp_extract("url", r"\.([a-z]+)$", 1), F.lit("")).alias("ext"))


@query("a19_state_counts", f"WITH {STATES} SELECT label, count(*) AS n, count(*) FILTER (raw = 1) AS positive, count(*) FILTER (raw = 0) AS negative, count(*) FILTER (raw = -1) AS uncertain, count(*) FILTER (raw IS NULL) AS missing, round(100.0 * count(*) FILTER (raw = 1) / count(*), 4) AS positive_pct, round(100.0 * count(*) FILTER (raw = 0) / count(*), 4) AS negative_pct, round(100.0 * count(*) FILTER (raw = -1) / count(*), 4) AS uncertain_pct, round(100.0 * count(*) FILTER (raw IS NULL) / count(*), 4) AS missing_pct, 0::BIGINT AS other FROM st GROUP BY 1")
def a19(spark, sf):
    return R.state_counts(states(spark, sf), ["label"])


@query("a20_positive_matrix", f"WITH {STATES} SELECT doc_id, label, coalesce(raw = 1, false) AS positive FROM st")
def a20(spark, sf):
    return states(spark, sf).select("doc_id", "label", F.coalesce(F.col("raw") == 1, F.lit(False)).alias("positive"))


#: Line items as image files: each measure is one expression that both engines read.
PICTURES = {
    "bytes": "CAST((l_quantity - 1) * 100 AS BIGINT)", "readable": "l_orderkey % 11 <> 0", "format": "CASE WHEN l_orderkey % 13 = 0 THEN 'GIF' ELSE 'PNG' END", "mode": "CASE WHEN l_returnflag = 'R' THEN 'RGB' ELSE 'L' END",
    "width": "CAST(l_quantity * 40 AS INT)", "height": "CAST(l_linenumber * 150 AS INT)", "mean": "l_discount * 2550", "std": "l_tax * 400", "white": "CASE WHEN l_partkey % 17 = 0 THEN 0.95 ELSE 0.1 END", "black": "CASE WHEN l_partkey % 19 = 0 THEN 0.95 ELSE 0.1 END",
    "dominant": "l_discount * 5", "colour": "CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END", "transparent": "CASE WHEN l_suppkey % 7 = 0 THEN 0.5 ELSE 0 END", "there": "l_orderkey % 23 <> 0", "used": "l_orderkey % 29 <> 0", "meta": "l_partkey % 31 = 0", "ext": "CASE WHEN l_suppkey % 5 = 0 THEN 'PNG' WHEN l_suppkey % 5 = 1 THEN 'gif' ELSE 'png' END",
}
_PIC = "pic AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, " + ", ".join(f"{e} AS {n}" for n, e in PICTURES.items()) + " FROM lineitem)"
_NAMED = lambda flags: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in flags) + "], lambda x: x IS NOT NULL)"
_AUDIT_SQL = [
    ("missing_file", "NOT there"), ("zero_byte", "there AND bytes = 0"), ("unreadable_or_corrupt", "there AND bytes > 0 AND NOT readable"), ("not_referenced", "NOT used"), ("metadata_file", "meta"), ("unusual_extension", "lower(ext) <> 'png'"), ("non_grayscale", "readable AND mode NOT IN ('L', 'I;16', 'I')"),
    ("suspiciously_small", "readable AND least(width, height) < 128"), ("near_blank", "readable AND (std < 5 OR white >= 0.9 OR black >= 0.9)"), ("unusual_aspect_ratio", "readable AND (width::DOUBLE / height < 0.5 OR width::DOUBLE / height > 2)"),
]


def pictures(spark, sf) -> DataFrame:
    return t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", *[F.expr(e).alias(n) for n, e in PICTURES.items()])


@query("a21_quality_flags", f"WITH {_PIC}, f AS (SELECT *, {_NAMED(_AUDIT_SQL)} AS f FROM pic) SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, len(f)::BIGINT AS n_flags, array_to_string(f, ';') AS flags FROM f")
def a21(spark, sf):
    n, names = R.flag_list(images.flags(F.col("there"), F.col("used"), F.col("meta"), F.col("ext"), F.lit("png")))
    return pictures(spark, sf).select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", n.alias("n_flags"), names.alias("flags"))


#: Fixed values of the text flags: words of near-empty and short texts, the quantile of long ones, the share of anonymised words.
_A22 = ["empty", "near_empty", "short", "long", "missing_first", "missing_rest", "duplicate_text", "first_equals_rest", "high_anonymisation", "malformed", "no_page"]
_KEY_OF = lambda c: _KEY.replace("text", c)


@query("a22_text_flags", f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS n, sha256({_KEY}) AS k, split_part(coalesce(text, ''), chr(10), 1) AS a, substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2) AS b FROM documents), q AS (SELECT quantile_cont(n, 0.99) FILTER (n > 0) AS q99 FROM w),
c AS (SELECT k, count(*) AS c FROM w WHERE n > 0 GROUP BY 1), g AS (SELECT DISTINCT page_id FROM pages),
f AS (SELECT w.doc_id, n, [n = 0, n BETWEEN 1 AND 3, n BETWEEN 1 AND 5, n > q99, trim(a) = '', trim(b) = '', n > 0 AND coalesce(c, 0) > 1, trim(a) <> '' AND {_KEY_OF('a')} = {_KEY_OF('b')}, n > 0 AND len(regexp_extract_all(text, '\\bX{{2,}}\\b')) >= 0.05 * n, n > 0 AND (NOT regexp_matches(text, '[A-Za-z]{{2,}}') OR regexp_matches(text, '[\\x00-\\x08\\x0E-\\x1F]')), page_id IS NULL] AS f FROM w LEFT JOIN c ON c.k = w.k LEFT JOIN g ON g.page_id = w.doc_id, q)
SELECT doc_id, n::BIGINT AS words, len(list_filter(f, lambda x: x))::BIGINT AS n_flags, array_to_string(list_filter(list_transform(range(1, 12), lambda i: CASE WHEN f[i] THEN ({_A22})[i] END), lambda x: x IS NOT NULL), ';') AS flags FROM f""")
def a22(spark, sf):
    """Eleven flags. What they need of a text is taken in one scan and written, so the text is read once; texts that repeat are counted by
    hash, and only those that do are looked up again."""
    x = F.coalesce("text", F.lit(""))
    first = F.substring_index(x, "\n", 1)
    rest = F.substring(x, F.char_length(first) + 2, F.char_length(x))
    n = F.size(text.words(x))
    bad = ~x.rlike("[A-Za-z]{2,}") | x.rlike(r"[\x00-\x08\x0E-\x1F]")
    measured = t(spark, sf, "documents").select(
        "doc_id", n.alias("n"), F.sha2(text.duplicate_key(x), 256).alias("k"), (F.trim(first) == "").alias("no_first"), (F.trim(rest) == "").alias("no_rest"),
        (text.duplicate_key(first) == text.duplicate_key(rest)).alias("same"), F.regexp_count(x, F.lit(text.ANONYMISED)).alias("xx"), bad.alias("bad"),
    )
    w = files.written(measured, "measured")
    limit = ordered.quantiles(w.filter("n > 0"), [], "n", [0.99]).select(F.col("q")[0].alias("q99"))
    copies = w.filter("n > 0").groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    paged = t(spark, sf, "pages").select(F.col("page_id").alias("doc_id")).distinct().withColumn("paged", F.lit(True))
    # A text of very many copies meets its count in several tasks; documents of empty texts have no count.
    salted = w.withColumn("salt", F.when(F.col("n") > 0, F.pmod(F.xxhash64("doc_id"), F.lit(16))).cast("int"))
    x = salted.join(copies, ["k", "salt"], "left").join(paged, "doc_id", "left").join(F.broadcast(limit))  # one row
    n = F.col("n")
    rules = [n == 0, n.between(1, 3), n.between(1, 5), n > F.col("q99"), F.col("no_first"), F.col("no_rest"), F.col("c").isNotNull(), ~F.col("no_first") & F.col("same"), (n > 0) & (F.col("xx") >= 0.05 * n), (n > 0) & F.col("bad"), F.col("paged").isNull()]
    count, names = R.flag_list(dict(zip(_A22, rules)))
    return x.select("doc_id", n.cast("long").alias("words"), count.alias("n_flags"), names.alias("flags"))


@query("a23_bands", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'middle' WHEN o_totalprice < 400000 THEN 'high' ELSE 'top' END AS band FROM orders")
def a23(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", R.band(F.col("o_totalprice"), [(50000, "low"), (200000, "middle"), (400000, "high")], "top").alias("band"))


@query("a24_cut", "SELECT o_orderkey, n, CASE WHEN n > -1 AND n <= 0 THEN 'none' WHEN n > 0 AND n <= 2 THEN 'few' WHEN n > 2 AND n <= 5 THEN 'some' END AS bucket FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def a24(spark, sf):
    n = t(spark, sf, "orders").select("o_orderkey").join(t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("c")), "o_orderkey", "left").select("o_orderkey", F.coalesce("c", F.lit(0)).alias("n"))
    return n.withColumn("bucket", R.cut(F.col("n"), [-1, 0, 2, 5], ["none", "few", "some"]))


@query("j1_one_to_one_join", "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def j1(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return R.one_to_one(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"])


@query("j2_aggregate_joined_back", "SELECT c_custkey, coalesce(n, 0)::BIGINT AS orders, coalesce(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j2(spark, sf):
    a = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))
    return t(spark, sf, "customer").select("c_custkey").join(a, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("s", F.lit(0.0)).alias("total"))


@query("j3_metric_tables", "WITH a AS (SELECT p_type AS label, count(*) AS parts FROM part GROUP BY 1), b AS (SELECT p_type AS label, round(sum(l_quantity), 4) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT label, parts, quantity FROM a JOIN b USING (label)")
def j3(spark, sf):
    p = t(spark, sf, "part").withColumnRenamed("p_type", "label")
    b = t(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("label").agg(F.round(F.sum("l_quantity"), 4).alias("quantity"))
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("parts")).join(b, "label")


@query("j4_case_insensitive_join", "SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON lower(r.r_name) = lower((SELECT r_name FROM region q WHERE q.r_regionkey = n.n_regionkey))")
def j4(spark, sf):
    r = t(spark, sf, "region")
    n = t(spark, sf, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.upper("r_name").alias("k"))
    return n.join(r.select("r_regionkey", "r_name"), F.lower("k") == F.lower("r_name")).select("n_nationkey", "r_regionkey")


@query("j5_semi_and_anti", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'referenced' ELSE 'unreferenced' END AS side FROM customer")
def j5(spark, sf):
    c, o = t(spark, sf, "customer").select("c_custkey"), t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("side", F.lit("referenced")).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("side", F.lit("unreferenced")))


@query("j6_symmetric_difference", "SELECT coalesce(a.doc_id, b.vec_id) AS id, CASE WHEN b.vec_id IS NULL THEN 'only_document' ELSE 'only_vector' END AS side FROM documents a FULL JOIN embeddings b ON a.doc_id = b.vec_id WHERE a.doc_id IS NULL OR b.vec_id IS NULL")
def j6(spark, sf):
    a, b = t(spark, sf, "documents").select("doc_id"), t(spark, sf, "embeddings").select("vec_id")
    x = a.join(b, F.col("doc_id") == F.col("vec_id"), "full").filter("doc_id is null or vec_id is null")
    return x.select(F.coalesce("doc_id", "vec_id").alias("id"), F.when(F.col("vec_id").isNull(), "only_document").otherwise("only_vector").alias("side"))


@query("j9_lookup_join", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def j9(spark, sf):
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("j10_aligned_frames", "SELECT d.doc_id, d.n_chars - length(d.text) AS difference FROM documents d JOIN labels l USING (doc_id)")
def j10(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels").select("doc_id"), "doc_id").select("doc_id", (F.col("n_chars") - F.length("text")).alias("difference"))


@query("j11_self_pairs", "SELECT a.r_name AS a, b.r_name AS b, count(*)::BIGINT AS n FROM (SELECT DISTINCT s_suppkey, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey) a JOIN (SELECT DISTINCT l_suppkey, p_type AS r_name FROM lineitem JOIN part ON p_partkey = l_partkey) b ON a.s_suppkey = b.l_suppkey GROUP BY 1, 2")
def j11(spark, sf):
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    a = t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("a")).distinct()
    b = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("s_suppkey"), F.col("p_type").alias("b")).distinct()
    return a.join(b, "s_suppkey").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("g0_group_summary", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, count(DISTINCT l_partkey)::BIGINT AS parts, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, bool_or(l_tax > 0.07) AS any_tax, array_to_string(list_sort(list(DISTINCT l_linenumber::VARCHAR)), ',') AS numbers FROM lineitem GROUP BY 1, 2")
def g0(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("parts"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.bool_or(F.col("l_tax") > 0.07).alias("any_tax"), F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ",").alias("numbers"))


@query("g0b_value_counts", "SELECT event_type, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM events GROUP BY 1")
def g0b(spark, sf):
    return R.value_counts(t(spark, sf, "events"), ["event_type"])


@query("g0c_descriptive_statistics", "SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max, round(quantile_cont(n_chars, 0.25), 6) AS q1, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.75), 6) AS q3, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents GROUP BY 1")
def g0c(spark, sf):
    return R.describe(t(spark, sf, "documents"), ["lang"], "n_chars")


@query("g0d_count_distribution", "WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS max, round(avg((n = 0)::INT), 6) AS share_0, round(avg((n = 1)::INT), 6) AS share_1, round(avg((n BETWEEN 2 AND 3)::INT), 6) AS share_2_3, round(avg((n BETWEEN 4 AND 5)::INT), 6) AS share_4_5, round(avg((n > 5)::INT), 6) AS share_over_5 FROM c")
def g0d(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey").join(t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).count(), "c_custkey", "left").select(F.coalesce("count", F.lit(0)).alias("n"))
    return R.count_summary(c)


@query("g0e_pivot", "SELECT l_shipmode, " + ", ".join(f"count(*) FILTER (l_returnflag = '{x}') AS \"{x}\"" for x in "ANR") + " FROM (SELECT l_linestatus AS l_shipmode, l_returnflag FROM lineitem) GROUP BY 1")
def g0e(spark, sf):
    return t(spark, sf, "lineitem").withColumnRenamed("l_linestatus", "l_shipmode").groupBy("l_shipmode").pivot("l_returnflag", ["A", "N", "R"]).count().fillna(0)


@query("g0f_heavy_hitters", "WITH c AS (SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY 1) SELECT user_id, n, n > (SELECT quantile_cont(n, 0.9) FROM c) AS heavy FROM c")
def g0f(spark, sf):
    c = t(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    c = files.written(c, "counts")
    return c.join(F.broadcast(ordered.quantiles(c, [], "n", [0.9]))).select("user_id", "n", (F.col("n") > F.col("q")[0]).alias("heavy"))  # one row


@query("g0g_group_consistency", "SELECT o_custkey, count(*)::BIGINT AS n, count(DISTINCT coalesce(o_orderstatus, '-'))::BIGINT AS states FROM orders GROUP BY 1 HAVING count(*) > 1")
def g0g(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("o_orderstatus", F.lit("-"))).alias("states")).filter("n > 1")


@query("g0h_imbalance", f"WITH {STATES}, c AS (SELECT label, count(*) FILTER (raw = 1) AS p, count(*) FILTER (raw = 0) AS n, count(*) FILTER (raw IS DISTINCT FROM 1) AS rest, count(*) AS total FROM st GROUP BY 1) SELECT label, round(p::DOUBLE / total, 6) AS prevalence, round(n::DOUBLE / nullif(p, 0), 6) AS explicit_ratio, round(rest::DOUBLE / nullif(p, 0), 6) AS rest_ratio, CASE WHEN n::DOUBLE / nullif(p, 0) < 3 THEN 'mild' WHEN n::DOUBLE / nullif(p, 0) < 10 THEN 'moderate' ELSE 'severe' END AS band, row_number() OVER (ORDER BY p DESC, label)::BIGINT AS rank FROM c")
def g0h(spark, sf):
    c = states(spark, sf).groupBy("label").agg(F.count_if(F.col("raw") == 1).alias("p"), F.count_if(F.col("raw") == 0).alias("n"), F.count_if(~F.col("raw").eqNullSafe(1.0)).alias("rest"), F.count(F.lit(1)).alias("total"))
    ratio = F.try_divide(F.col("n").cast("double"), F.col("p").cast("double"))
    return c.select("label", r6(F.col("p") / F.col("total")).alias("prevalence"), r6(ratio).alias("explicit_ratio"), r6(F.try_divide(F.col("rest").cast("double"), F.col("p").cast("double"))).alias("rest_ratio"), R.band(ratio, [(3, "mild"), (10, "moderate")], "severe").alias("band"), F.row_number().over(Window.orderBy(F.desc("p"), "label")).cast("long").alias("rank"))  # a row for each label


@query("g0i_sentence_document_frequency", f"WITH s AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT md5(line) AS line_md5, count(*)::BIGINT AS df FROM s WHERE line <> '' GROUP BY line HAVING count(*) > 1")
def g0i(spark, sf):
    s = t(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''").distinct()
    return s.groupBy(F.md5("line").alias("line_md5")).agg(F.count(F.lit(1)).alias("df")).filter("df > 1")


@query("w1_group_size", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders")
def w1(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", F.count(F.lit(1)).over(Window.partitionBy("o_custkey")).alias("size"))


@query("w2_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::BIGINT AS n FROM orders")
def w2(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("n"))


@query("w3_first_per_group", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1")
def w3(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("w5_cumulative_share", "SELECT c_nationkey, n, round(sum(n) OVER (ORDER BY n DESC, c_nationkey) / sum(n) OVER (), 6) AS share, CASE WHEN sum(n) OVER (ORDER BY n DESC, c_nationkey) / sum(n) OVER () <= 0.7 THEN 'train' WHEN sum(n) OVER (ORDER BY n DESC, c_nationkey) / sum(n) OVER () <= 0.85 THEN 'val' ELSE 'test' END AS part FROM (SELECT c_nationkey, count(*)::BIGINT AS n FROM customer GROUP BY 1)")
def w5(spark, sf):
    g = t(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    share = F.sum("n").over(Window.orderBy(F.desc("n"), "c_nationkey")) / F.sum("n").over(Window.partitionBy())  # a row for each nation
    return g.select("c_nationkey", "n", r6(share).alias("share"), F.when(share <= 0.7, "train").when(share <= 0.85, "val").otherwise("test").alias("part"))


@query("w6_top_n_per_group", "SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::BIGINT AS rank FROM customer) WHERE rank <= 3")
def w6(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t(spark, sf, "customer").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("c_nationkey", "c_custkey", F.col("rank").cast("long").alias("rank"))


@query("w7_lag_difference", "WITH m AS (SELECT event_type, date_trunc('day', ts)::DATE AS day, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT event_type, day::VARCHAR AS day, round(total - lag(total) OVER (PARTITION BY event_type ORDER BY day), 4) AS change, coalesce(total >= lag(total) OVER (PARTITION BY event_type ORDER BY day), true) AS rising FROM m")
def w7(spark, sf):
    m = t(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("total"))
    before = F.lag("total").over(Window.partitionBy("event_type").orderBy("day"))
    return m.select("event_type", F.col("day").cast("string").alias("day"), F.round(F.col("total") - before, 4).alias("change"), F.coalesce(F.col("total") >= before, F.lit(True)).alias("rising"))


@query("w8_spearman", "WITH x AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x) SELECT round(corr(ra, rb), 6) AS rho, count(*)::BIGINT AS n FROM r")
def w8(spark, sf):
    x = t(spark, sf, "part").select(F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    # Average ranks from counts of distinct values: no window over all rows at once.
    def ranks(c: str, out: str) -> DataFrame:
        g = R.running_total(x.groupBy(c).agg(F.count(F.lit(1)).alias("k")), [c], "k", "upto")
        return g.select(c, (F.col("upto") - (F.col("k") - 1) / 2).alias(out))
    y = x.join(ranks("a", "ra"), "a").join(ranks("b", "rb"), "b")
    m = y.agg(F.count(F.lit(1)).alias("n"), *[F.avg(e).alias(k) for k, e in (("ma", F.col("ra")), ("mb", F.col("rb")), ("ab", F.col("ra") * F.col("rb")), ("aa", F.col("ra") ** 2), ("bb", F.col("rb") ** 2))])
    return m.select(r6(F.try_divide(F.col("ab") - F.col("ma") * F.col("mb"), F.sqrt((F.col("aa") - F.col("ma") ** 2) * (F.col("bb") - F.col("mb") ** 2)))).alias("rho"), "n")


@query("w9_interpolation", "WITH k AS (SELECT c_nationkey::DOUBLE AS x, round(avg(c_acctbal), 6) AS y FROM customer GROUP BY 1), s AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM k), q AS (SELECT p_partkey, p_size / 2.5 AS v FROM part) SELECT p_partkey, round(CASE WHEN s.x2 IS NULL THEN s.y ELSE s.y + (v - s.x) / (s.x2 - s.x) * (s.y2 - s.y) END, 6) AS value FROM q JOIN s ON v >= s.x AND (s.x2 IS NULL OR v < s.x2)")
def w9(spark, sf):
    k = t(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("double").alias("x")).agg(F.round(F.avg("c_acctbal"), 6).alias("y"))
    q = t(spark, sf, "part").select("p_partkey", (F.col("p_size") / 2.5).alias("v"))
    return ordered.interpolated(q, k, [], "v").select("p_partkey", r6("q").alias("value"))


@query("u1_union_with_tag", "SELECT c_custkey AS key, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def u1(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("kind")).unionByName(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("kind")))


_SETS = "sets AS (SELECT DISTINCT l_returnflag AS a, l_partkey AS k FROM lineitem)"


@query("u2_pairwise_overlap", f"WITH {_SETS} SELECT x.a, y.a AS b, count(*)::BIGINT AS n FROM sets x JOIN sets y ON x.k = y.k AND x.a < y.a GROUP BY 1, 2")
def u2(spark, sf):
    s = t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_partkey").alias("k")).distinct()
    return s.join(s.withColumnRenamed("a", "b"), "k").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("u3_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u3(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(t(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")))


@query("u4_array_sets", "WITH g AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS a, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1), h AS (SELECT o_custkey, coalesce(a, []) AS a, coalesce(b, []) AS b FROM g) SELECT o_custkey, len(list_intersect(a, b))::BIGINT AS common, len(list_distinct(list_concat(a, b)))::BIGINT AS together, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ';') AS only_a FROM h")
def u4(spark, sf):
    pick = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    g = t(spark, sf, "orders").groupBy("o_custkey").agg(pick("F").alias("a"), pick("O").alias("b"))
    return g.select("o_custkey", F.size(F.array_intersect("a", "b")).cast("long").alias("common"), F.size(F.array_union("a", "b")).cast("long").alias("together"), F.array_join(F.array_sort(F.array_except("a", "b")), ";").alias("only_a"))


@query("u5_common_to_all", f"WITH {_SETS} SELECT k FROM sets GROUP BY k HAVING count(DISTINCT a) = 3")
def u5(spark, sf):
    return t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count_distinct("l_returnflag").alias("n")).filter("n = 3").select("k")


@query("d1_duplicate_groups", f"WITH h AS (SELECT doc_id, sha256({_KEY}) AS key FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY key) AS size FROM h) SELECT key, doc_id, dense_rank() OVER (ORDER BY key)::BIGINT AS \"group\", size FROM c WHERE size > 1")
def d1(spark, sf):
    h = t(spark, sf, "documents").select("doc_id", F.sha2(text.duplicate_key(F.col("text")), 256).alias("key"))
    return R.duplicate_groups(h, ["key"], "doc_id")


@query("d2_duplicate_rate", f"WITH c AS (SELECT {_KEY} AS k, count(*) AS n FROM documents GROUP BY 1) SELECT count(*)::BIGINT AS groups, sum(n)::BIGINT AS members, max(n)::BIGINT AS largest, round(sum(n) / (SELECT count(*) FROM documents), 6) AS rate FROM c WHERE n > 1")
def d2(spark, sf):
    c = t(spark, sf, "documents").groupBy(F.md5(text.duplicate_key(F.col("text"))).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    more = F.col("n") > 1
    return c.agg(F.count_if(more).alias("groups"), F.sum(F.when(more, F.col("n"))).alias("members"), F.max(F.when(more, F.col("n"))).alias("largest"), r6(F.sum(F.when(more, F.col("n"))) / F.sum("n")).alias("rate"))


@query("d3_overlap_with_training", f"WITH k AS (SELECT doc_id, source, {_KEY} AS k FROM documents) SELECT doc_id FROM k WHERE source > 'src5' AND k IN (SELECT k FROM k WHERE source <= 'src5')")
def d3(spark, sf):
    k = t(spark, sf, "documents").select("doc_id", "source", F.md5(text.duplicate_key(F.col("text"))).alias("k"))
    return k.filter("source > 'src5'").join(k.filter("source <= 'src5'").select("k"), "k", "left_semi").select("doc_id")


@query("d8_leakage_report", "SELECT count(*) FILTER (n > 1)::BIGINT AS spanning, count(*) FILTER (k IS NULL)::BIGINT AS nameless, count(*)::BIGINT AS groups FROM (SELECT l_partkey AS k, count(DISTINCT l_linestatus) AS n FROM lineitem GROUP BY 1)")
def d8(spark, sf):
    g = t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count_distinct("l_linestatus").alias("n"))
    return g.agg(F.count_if(F.col("n") > 1).alias("spanning"), F.count_if(F.col("k").isNull()).alias("nameless"), F.count(F.lit(1)).alias("groups"))


@query("d9_prevalence_by_split", f"WITH {STATES}, g AS (SELECT lang, label, count(*) FILTER (raw = 1) AS p, count(*) AS n FROM st GROUP BY GROUPING SETS ((lang, label), (label))), o AS (SELECT label, p::DOUBLE / n AS overall, p AS positives FROM g WHERE lang IS NULL) SELECT coalesce(g.lang, 'all') AS part, label, round(p::DOUBLE / n, 6) AS prevalence, round((p::DOUBLE / n - overall) / nullif(overall, 0), 6) AS deviation FROM g JOIN o USING (label)")
def d9(spark, sf):
    s = states(spark, sf)
    g = s.groupingSets([["lang", "label"], ["label"]], "lang", "label").agg(F.count_if(F.col("raw") == 1).alias("p"), F.count(F.lit(1)).alias("n"))
    o = g.filter("lang is null").select("label", (F.col("p") / F.col("n")).alias("overall"))
    share = F.col("p") / F.col("n")
    return g.join(F.broadcast(o), "label").select(F.coalesce("lang", F.lit("all")).alias("part"), "label", r6(share).alias("prevalence"), r6(F.try_divide(share - F.col("overall"), F.col("overall"))).alias("deviation"))  # a row for each label
