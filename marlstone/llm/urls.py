"""URL filters: rules, and logistic regression on hashed character n-grams of host and path for what no rule fits.

The classifier is trained from a small labelled table of URLs, by full-batch gradient descent written as one SQL expression
over its rows. Weights are one array of DIMENSIONS numbers. Everything is DataFrame functions.

labelled_urls.csv holds 245 URLs with a label each (block: 1). They were written by hand for this repository: about half are
well-known public sites, as their owners present them, the others made up in the manner of such sites. Blocked kinds are
gambling, adult, pharmacy, money, advertising, spam, deception and piracy; ordinary ones are news, science, learning,
government, culture, travel, trade and homes, some with names that share letters with the former.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

DIMENSIONS, GRAMS, ROUNDS, RATE, RIDGE = 16384, (3, 4, 5), 80, 4.0, 0.0002
#: More labelled rows than this are an error: the fit gathers them into one row.
MOST_LABELLED = 20_000
LABELLED = Path(__file__).with_name("labelled_urls.csv")

#: Host, path prefix and verdict of the rules of the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, block (0 or 1) of the labelled table."""
    with LABELLED.open(encoding="utf-8", newline="") as f:
        return spark.createDataFrame([(r["url"], int(r["block"])) for r in csv.DictReader(f)], "url string, block int")


#: Top-level names and paths that each labelled name is also seen with in training, so that these do not tell the labels.
SHAPES = [("com", "/"), ("org", ""), ("net", "/index.html"), ("org", "/en/page/12"), ("com", "/2019/05/post.html")]


def reshaped(labelled: DataFrame, shapes: list[tuple[str, str]] = SHAPES) -> DataFrame:
    """url, block of the labelled rows as they are and with each of the shapes."""
    stem = F.regexp_extract("url", r"://([^/?#]*)\.[^./?#]+", 1)
    urls = F.array(F.col("url"), *(F.concat(F.lit("https://"), stem, F.lit(f".{top}{path}")) for top, path in shapes))
    return labelled.select(F.explode(urls).alias("url"), "block")


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _characters(text: Column) -> Column:
    return F.split(F.concat(F.lit("^"), text, F.lit("$")), "")


def _grams(chars: str, tag: str, n: int) -> Column:
    """Numbers of the n-grams of an array column of characters."""
    starts = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(tag), F.array_join(F.slice(F.col(chars), i, n), "")), F.lit(DIMENSIONS)).cast("int"))


def add_features(df: DataFrame, where: Column | None = None, sizes: tuple[int, ...] = GRAMS) -> DataFrame:
    """Adds `features`: distinct numbers of the hashed n-grams of columns host (without a leading www) and path; null where `where` does
    not hold. The characters are columns of their own, so each text is split once, however long it is."""
    keep = lambda x: x if where is None else F.when(where, x)
    split = df.withColumn("__host", keep(_characters(F.regexp_replace("host", r"^www\.", "")))).withColumn("__path", keep(_characters(F.col("path"))))
    grams = F.array_distinct(F.concat(*(_grams(chars, tag, n) for n in sizes for chars, tag in (("__host", "host"), ("__path", "path")))))
    return split.withColumn("features", keep(grams)).drop("__host", "__path")


def train(labelled: DataFrame, ridge: float = RIDGE, rounds: int = ROUNDS) -> list[float]:
    """DIMENSIONS weights and, last, the intercept; labelled: url, block, at most MOST_LABELLED rows, which are gathered into one
    (more is an error). Rows with a null in either are left out; without both labels all weights are 0."""
    rows = labelled.filter("url is not null and block is not null").select(host_of("url").alias("host"), path_of("url").alias("path"), F.col("block").cast("double").alias("y"))
    if rows.limit(MOST_LABELLED + 1).count() > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled rows")
    gathered = add_features(rows).select("y", F.col("features").alias("f")).agg(F.sort_array(F.collect_list(F.struct("y", "f"))).alias("rows"))
    # Features that occur are numbered 0, 1, ...: only they have weights while the model is fitted.
    pairs = gathered.select(F.posexplode("rows").alias("i", "r")).select("i", "r.y", F.explode("r.f").alias("f")).withColumn("k", F.dense_rank().over(Window.orderBy("f")) - 1)
    lists = pairs.groupBy("k", "f").agg(F.sort_array(F.collect_list("i")).alias("has")).agg(F.sort_array(F.collect_list(F.struct("k", "f", "has"))).alias("x"))
    data = pairs.groupBy("i", "y").agg(F.sort_array(F.collect_list("k")).alias("f")).agg(F.sort_array(F.collect_list(F.struct("i", "y", "f"))).alias("rows"))
    one = data.select("rows", F.lit(None).cast("array<struct<k:int,f:int,has:array<int>>>").alias("x")).unionByName(lists, allowMissingColumns=True)
    one = one.agg(F.first("rows", ignorenulls=True).alias("rows"), F.first("x", ignorenulls=True).alias("x"))
    one = one.select("rows", F.expr("transform(x, e -> e.f)").alias("names"), F.expr("transform(x, e -> e.has)").alias("inverted"), F.expr("transform(rows, r -> 1 / sqrt(size(r.f)))").alias("norm"), F.size("rows").alias("n"))
    step = f"""
      aggregate(sequence(1, {rounds}), named_struct('w', array_repeat(0D, size(names)), 'b', 0D), (m, t) ->
        transform(array(transform(rows, (r, i) -> (r.y - 1 / (1 + exp(-(m.b + norm[i] * aggregate(r.f, 0D, (a, f) -> a + m.w[f]))))) / n)), e ->
          named_struct('w', transform(inverted, (has, j) -> m.w[j] * (1 - {RATE * ridge}) + {RATE * 4} * aggregate(has, 0D, (a, i) -> a + e[i] * norm[i])),
                       'b', m.b + {RATE} * aggregate(e, 0D, (a, x) -> a + x)))[0])"""
    found = one.filter("exists(rows, r -> r.y = 0) and exists(rows, r -> r.y = 1)").select("names", F.expr(step).alias("m")).select("names", "m.w", "m.b").first()
    weights = [0.0] * (DIMENSIONS + 1)
    if found is not None:
        for f, w in zip(found["names"], found["w"]):
            weights[f] = w
        weights[-1] = found["b"]
    return weights


def score(weights: list[float], found: Column) -> Column:
    """P(block) from the numbers of features."""
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # constant: folded once
    total = F.aggregate(found, F.lit(0.0), lambda a, f: a + F.get(w, f))
    return 1 / (1 + F.exp(-(F.lit(weights[-1]) + total / F.sqrt(F.greatest(F.size(found), F.lit(1))))))


def fits(host: str, prefix: str) -> Column:
    return ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(prefix))


def judge(pages: DataFrame, weights: list[float], rules: list[tuple[str, str, str]] = RULES, cut: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score. The longest rule that fits decides (of equally long ones the first by name),
    else the classifier; a url that a rule decides has no score. A null url has empty host and path. Repeated rows give repeated
    results, an empty table an empty one."""
    df = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, prefix, what in reversed(ordered):
        hit = fits(host, prefix)
        rule, verdict = F.when(hit, F.lit(host + prefix)).otherwise(rule), F.when(hit, F.lit(what)).otherwise(verdict)
    ruled = df.withColumn("rule", rule).withColumn("ruled", verdict)
    scored = add_features(ruled, F.col("rule").isNull()).withColumn("score", F.when(F.col("rule").isNull(), score(weights, F.col("features"))))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= cut, "block").otherwise("allow")).alias("verdict"), "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), train(reshaped(labelled_urls(spark))))
