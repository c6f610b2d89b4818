"""Document fingerprints: threshold-scaled sketches of five-word shingles.

Every shingle is hashed to 63 bits; a sketch keeps each hash below a fixed fraction of that range. Two sketches therefore
hold the same sample of hashes, whatever the documents' sizes: likeness and containment follow from them, and a union of
sketches is the sketch of the union. So that short texts say something too, a sketch keeps at least its FLOOR smallest
hashes; `limit` records up to which value it is complete, and two sketches are compared up to the smaller limit.

Words are runs without ASCII white space, lower-cased; a text of fewer than five words has its whole sequence as one
shingle; a null, empty or blank text has none. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, materialise, table, whole_text

SHINGLE, FRACTION, FLOOR = 5, 8, 32
TOP = (1 << 63) - 1


def add_sketch(df: DataFrame, text: str, prefix: str = "", fraction: int = FRACTION, floor: int = FLOOR) -> DataFrame:
    """Adds {prefix}limit (long) and {prefix}hashes (sorted array of long) for the string column `text`."""
    w, h, s, low = (f"__{prefix}{x}" for x in ("words", "word_hashes", "shingles", "low"))
    bound = TOP // fraction
    at = lambda i, k: F.get(F.col(h), i + k)
    shingles = F.transform(F.slice(F.col(h), 1, F.size(h) - (SHINGLE - 1)), lambda x, i: F.shiftrightunsigned(F.xxhash64(x, at(i, 1), at(i, 2), at(i, 3), at(i, 4)), 1))
    few = F.shiftrightunsigned(F.xxhash64(F.array_join(h, ",")), 1)
    out = df.withColumn(w, F.array_remove(F.split(F.lower(text), SPACE), "")).withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    out = out.withColumn(s, F.sort_array(F.array_distinct(F.when(F.size(h) >= SHINGLE, shingles).when(F.size(h) > 0, F.array(few)).otherwise(F.array().cast("array<bigint>")))))
    out = out.withColumn(low, F.filter(s, lambda x: x < F.lit(bound)))
    whole, enough = F.size(s) <= floor, F.size(low) >= floor
    out = out.withColumn(f"{prefix}limit", F.when(whole, F.lit(TOP)).when(enough, F.lit(bound - 1)).otherwise(F.get(F.col(s), F.lit(floor - 1))))
    out = out.withColumn(f"{prefix}hashes", F.when(whole, F.col(s)).when(enough, F.col(low)).otherwise(F.slice(F.col(s), 1, floor)))
    return out.drop(w, h, s, low)


def fingerprint(limit: str, hashes: str) -> Column:
    """A sketch as text: limit, colon, hashes in hexadecimal with commas."""
    return F.concat(F.hex(limit), F.lit(":"), F.array_join(F.transform(hashes, lambda x: F.hex(x)), ","))


def _shared(a: str, b: str, la: str, lb: str) -> tuple[Column, Column, Column]:
    most = F.least(la, lb)
    left, right = F.filter(a, lambda x: x <= most), F.filter(b, lambda x: x <= most)
    return F.size(F.array_intersect(left, right)), F.size(left), F.size(right)


def likeness(la: str, a: str, lb: str, b: str) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two sketches without hashes are alike (1)."""
    both, left, right = _shared(a, b, la, lb)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(both.cast("double"), (left + right - both).cast("double")), F.lit(0.0)))


def containment(la: str, a: str, lb: str, b: str) -> Column:
    """Estimated share of a's shingles that b has; null where a has no shingle."""
    both, left, _ = _shared(a, b, la, lb)
    return F.try_divide(both.cast("double"), left.cast("double"))


def merge(limits: Column, hashes: Column) -> tuple[Column, Column]:
    """The sketch of a union, from the columns' values over a group: aggregates for groupBy().agg()."""
    limit = F.min(limits)
    return limit, F.filter(F.sort_array(F.array_distinct(F.flatten(F.collect_set(hashes)))), lambda x: x <= limit)


def neighbours(ids: DataFrame, parts: int) -> DataFrame:
    """doc_id, n, next_id, prev_id, prev_n in descending order of doc_id, as a ring, for distinct doc_ids with columns doc_id, n.

    Ranges are ordered inside themselves; only their ends (two rows a range) meet in one place.
    """
    ranged = materialise(ids.repartitionByRange(parts, F.col("doc_id").desc()).withColumn("part", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("part").orderBy(F.col("doc_id").desc())
    row = F.struct("doc_id", "n")
    inner = ranged.select("part", "doc_id", "n", F.lead("doc_id").over(here).alias("below"), F.lag(row).over(here).alias("above"))
    ends = ranged.groupBy("part").agg(F.max(row).alias("first"), F.min(row).alias("last"))
    order = Window.orderBy("part")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(every)).alias("after"), F.coalesce(F.lag("last").over(order), F.last("last").over(every)).alias("before"))
    above = F.coalesce("above", "before")
    return inner.join(F.broadcast(ends), "part").select("doc_id", F.coalesce("below", F.col("after.doc_id")).alias("next_id"), above["doc_id"].alias("prev_id"), above["n"].alias("prev_n"))  # ends: a row for each range


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the next document's, in
    descending order of doc_id. Null texts are empty. Rows that repeat a doc_id each get a row; as a next document, the one
    with the smallest text hash counts. Rows with a null doc_id have no place in the order: their next document is an empty
    text, and they are nobody's next. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    base = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    sizes = base.select("doc_id", F.char_length("text").alias("n"), F.xxhash64("text").alias("mark"))
    sizes = materialise(sizes.groupBy("doc_id").agg(F.max("n").alias("n"), F.min("mark").alias("mark"), F.count(F.lit(1)).alias("rows")), "sizes")
    repeated = bool(sizes.filter("rows > 1").limit(1).count())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    links = neighbours(sizes.select("doc_id", "n"), parts)
    if repeated:
        links = links.join(sizes.select("doc_id", "mark"), "doc_id")
    own = add_sketch(base, "text")
    linked = own.join(links, "doc_id")
    as_next = linked.filter(F.xxhash64("text") == F.col("mark")) if repeated else linked
    heads = as_next.select(F.col("prev_id").alias("doc_id"), F.expr("substring(text, 1, cast(floor(prev_n / 3) as int))").alias("head"), F.col("limit").alias("next_limit"), F.col("hashes").alias("next_hashes"))
    if repeated:
        heads = heads.dropDuplicates(["doc_id"])
    out = _edited(own.join(heads, "doc_id"))
    unnamed = docs.filter(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    if not unnamed.limit(1).count():
        return out  # under a union the join's two sides would no longer be one exchange
    nothing = (F.lit("").alias("head"), F.lit(TOP).alias("next_limit"), F.array().cast("array<bigint>").alias("next_hashes"))
    return out.unionByName(_edited(add_sketch(unnamed, "text").select("*", *nothing)))


def _edited(both: DataFrame) -> DataFrame:
    """The result's columns, for rows with a document's text and sketch and its next one's head and sketch."""
    both = both.withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 3) as int)), substring(head, 1, cast(floor(n_chars / 3) as int)))"))
    out = add_sketch(both, "edited", "edited_")
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("limit", "hashes").alias("fingerprint"),
        fingerprint("edited_limit", "edited_hashes").alias("edited_fingerprint"),
        likeness("limit", "hashes", "edited_limit", "edited_hashes").alias("near_edited"),
        likeness("limit", "hashes", "next_limit", "next_hashes").alias("near_next"),
    )


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
