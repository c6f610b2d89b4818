"""WARC archives: writing with revisit records, and reading with boundary-chain verification. All of it is DataFrame functions.

Writing: each page becomes one record as text, and the text sink's line separator is the end of a record, so Spark writes valid
archives to any file system.

Reading: the text source splits files at the mark every record begins with, by byte ranges where the compression allows it.
Each piece is a candidate; its header's length gives the offset of a successor, and sums of sizes give every piece's own offset.
Payloads may hold marks too. Neighbouring candidates that follow one another are one run, and pointer jumping over the runs
from the start of each file (each round doubles the reach of every link, as a join) finds which ones the chain of records
passes; only those are records. A record that holds marks is put together again from its pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, scratch, table

#: Fixed values of the format.
MARK, VERSION, END, BREAK = "WARC/1.", "1\r\n", "\r\n\r\n", "\r\n"
LEAST_REVISIT, ARCHIVE_BYTES, DATE = 100, 24 << 20, "2024-01-01T00:00:00Z"
#: A payload is frequent from this share of all pages on (1 / MOST_FREQUENT), but not below LEAST_FREQUENT pages.
MOST_FREQUENT, LEAST_FREQUENT = 4096, 1000
#: Files of these endings are compressed, so their size is not that of the text.
PACKED = r"(?i)\.(gz|bz2|zst|zstd|lz4|snappy|deflate)$"
PIECE = ["file", "block", "at"]


def decide(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html (null: empty), bytes, digest, first: the page a revisit refers to, else null.

    Of equal payloads of at least `least` bytes the one with the smallest page_id is a response; rows that repeat that
    page_id are responses too. A null page_id is never referred to and is always a response. Payloads of many pages do not
    meet in one task: those with more than 1/MOST_FREQUENT of all pages, MOST_FREQUENT at most, are looked up by broadcast.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), F.octet_length(body).cast("long").alias("bytes"), F.sha2(body, 256).alias("digest"))
    repeated = rows.filter((F.col("bytes") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("c")).filter("first < last")
    firsts = materialise(repeated.select("digest", "first", "c"), "firsts")
    bar = max((firsts.agg(F.sum("c")).first()[0] or 0) // MOST_FREQUENT, LEAST_FREQUENT)
    often = firsts.filter(F.col("c") > bar).select("digest", F.col("first").alias("near"))
    met = rows.join(F.broadcast(often), "digest", "left")  # MOST_FREQUENT rows at most
    rest = met.filter("near is null").drop("near").join(firsts.filter(F.col("c") <= bar).select("digest", "first"), "digest", "left")
    both = rest.unionByName(met.filter("near is not null").withColumnRenamed("near", "first"))
    return both.withColumn("first", F.when(F.col("page_id") > F.col("first"), F.col("first")))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip") -> None:
    """One record for each row, in archives of about archive_bytes of text under path. compression `none` lets readers split them
    by byte ranges. Null urls are written as urn:none, control characters in urls as %20. An empty table writes nothing."""
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    p = decide(pages)
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("urn:none"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    revisit = F.col("first").isNotNull()
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit(f"{MARK}{VERSION}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{BREAK}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"),
        F.lit(f"{BREAK}WARC-Date: {DATE}{BREAK}WARC-Target-URI: "), uri,
        F.lit(f"{BREAK}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{BREAK}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{BREAK}WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{BREAK}Content-Type: application/http;msgtype=response{BREAK}Content-Length: "),
    )
    record = p.select(head.alias("head"), block.alias("block")).select(F.concat("head", F.octet_length("block").cast("string"), F.lit(END), "block").alias("value"))
    each = max(100, int(archive_bytes / (mean + 500)))
    record.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", each).text(path)


def _field(name: str) -> Column:
    """A header field of column head; null if it is not there."""
    return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*$", 1), F.lit(""))


def _number(text: str, name: str = "content-length") -> Column:
    return F.regexp_extract(text, rf"(?im)^{name}:[ \t]*(\d{{1,17}})[ \t]*$", 1).try_cast("long")


def parsed(pieces: DataFrame, payloads: bool) -> DataFrame:
    """pieces (with column value, what stands between two marks) with what their headers say: header (bytes up to the block; null
    if there is no valid header), length (of the block), whole (the piece is just one record), closes (it ends as records do), kind,
    name, uri, refers, stated (digest), n, digest and payload, the last three only where the piece is whole."""
    size = F.octet_length("value").cast("long")
    first = F.substring_index("value", END, 1)
    good = F.substring("value", 1, 3).isin("0\r\n", "1\r\n") & (F.octet_length(first) < size)
    p = pieces.withColumn("size", size).withColumn("closes", F.endswith("value", F.lit(END))).withColumn("head", F.when(good, first)).withColumn("length", _number("head"))
    p = p.withColumn("header", F.when(F.col("length").isNotNull(), F.octet_length("head").cast("long") + len(END)))
    p = p.withColumn("whole", F.coalesce(F.col("closes") & (F.col("header") + F.col("length") + len(END) == F.col("size")), F.lit(False)))
    p = p.withColumn("kind", F.lower(_field("warc-type"))).withColumn("name", _field("warc-record-id")).withColumn("uri", _field("warc-target-uri")).withColumn("refers", _field("warc-refers-to"))
    p = p.withColumn("stated", F.nullif(F.regexp_extract(_field("warc-payload-digest"), r"(?i)^sha256:([0-9a-f]{64})$", 1), F.lit("")))
    part = lambda start, n: F.substr(F.col("value").cast("binary"), (start + 1).cast("int"), n.cast("int"))
    p = p.withColumn("http", F.when(F.col("whole") & F.col("kind").isin("response", "revisit"), F.substring_index(part(F.col("header"), F.col("length")).cast("string"), END, 1)))
    skip = F.when(F.col("http").isNull(), 0).otherwise(F.least(F.octet_length("http") + len(END), F.col("length"))).cast("long")
    p = p.withColumn("payload", F.when(F.col("whole") & F.coalesce(F.col("kind") != "revisit", F.lit(True)), part(F.col("header") + skip, F.col("length") - skip)))
    p = p.withColumn("n", F.when(F.col("kind") == "revisit", _number("http")).otherwise(F.octet_length("payload").cast("long"))).withColumn("digest", F.sha2("payload", 256))
    return p.drop("value", "head", "http") if payloads else p.drop("value", "head", "http", "payload")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block (of bytes that one task reads), at (order in the block), file_size, value: what stands between marks."""
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", MARK).text(path)
    return raw.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), meta["file_size"].alias("file_size"), "value")


def positions(pieces: DataFrame) -> DataFrame:
    """file, block, at, k (number in the block), offset (of the mark before the piece; the text before the first mark has
    -7), size, whole, successor (null: none), closed (what stands before ends as a record does) and closes."""
    here = Window.partitionBy("file", "block").orderBy("at")
    step = F.col("size") + len(MARK)
    blocks = pieces.groupBy("file", "block").agg(F.sum(step).alias("bytes"), F.max_by("closes", "at").alias("closed"))
    files = Window.partitionBy("file").orderBy("block")
    blocks = blocks.select("file", "block", (F.sum("bytes").over(files) - F.col("bytes")).alias("before"), F.lag("closed").over(files).alias("above"))
    p = pieces.select(*PIECE, "size", "whole", "closes", "header", "length").join(blocks, ["file", "block"])
    p = p.withColumn("offset", F.col("before") + F.sum(step).over(here) - step - len(MARK)).withColumn("k", F.row_number().over(here))
    closed = F.coalesce(F.lag("closes").over(here), "above", F.lit(True))
    return p.select(*PIECE, "k", "offset", "size", "whole", (F.col("offset") + len(MARK) + F.col("header") + F.col("length") + len(END)).alias("successor"), closed.alias("closed"), "closes")


def reached_runs(spots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces with the run they are in, the runs that the chain from offset 0 of each file passes: file, run, exit). A run begins at
    its offset; inside it every piece is one record."""
    jumps = spots.filter(~F.col("whole") & (F.col("successor") > F.col("offset") + len(MARK) + F.col("size")))
    entries = jumps.select("file", F.col("successor").alias("offset")).distinct().withColumn("entry", F.lit(True))
    here = Window.partitionBy("file", "block").orderBy("at")
    begins = F.coalesce(~F.lag("whole").over(here), F.lit(True)) | F.col("entry").isNotNull()
    p = spots.join(entries, ["file", "offset"], "left").withColumn("run", F.max(F.when(begins, F.col("offset"))).over(here)).drop("entry")
    p = materialise(p, "runs")
    exit_ = F.max_by(F.struct("successor", "offset"), "offset")["successor"]
    runs = p.groupBy("file", "run").agg(exit_.alias("exit"), F.max_by(F.struct("closed"), -F.col("offset"))["closed"].alias("closed"))
    able = runs.filter("closed").select("file", F.col("run").alias("exit"), F.col("run").alias("jump"))
    state = materialise(runs.join(able, ["file", "exit"], "left").select("file", "run", "exit", "jump", (F.col("run") == 0).alias("reached")), "chain")
    while state.filter("run = 0 and jump is not null").limit(1).count():
        further = state.select("file", F.col("run").alias("jump"), F.col("jump").alias("next"))
        hit = state.filter("reached and jump is not null").select("file", F.col("jump").alias("run")).distinct().withColumn("hit", F.lit(True))
        step = state.join(further, ["file", "jump"], "left").join(hit, ["file", "run"], "left").select("file", "run", "exit", F.col("next").alias("jump"), (F.col("reached") | F.col("hit").isNotNull()).alias("reached"))
        step = materialise(step, "chain")
        discard(state)
        state = step
    return p, state.filter("reached").select("file", "run", "exit")


def check_ends(pieces: DataFrame, runs: DataFrame, chain: DataFrame) -> None:
    """Raises unless every file begins with a record and its chain ends where the file does."""
    sizes = pieces.groupBy("file").agg(F.max("file_size").alias("file_size"))
    files = runs.groupBy("file").agg(F.max(F.col("offset") + len(MARK) + F.col("size")).alias("end"), F.max_by("closes", "offset").alias("closes"), F.max(F.when(F.col("offset") < 0, F.col("size"))).alias("before")).join(sizes, "file")
    whole = F.col("closes") & (F.col("before") == 0) & (F.col("file").rlike(PACKED) | (F.col("file_size") == F.col("end")))
    ends = chain.select("file", F.col("exit").alias("end")).distinct().withColumn("met", F.lit(True))
    bad = files.join(ends, ["file", "end"], "left").filter(~(whole & F.col("met").isNotNull())).select("file", "before").first()
    if bad is not None:
        raise ValueError(f"archive is damaged: {bad['file']} " + ("does not begin with a record" if bad["before"] else "is not a chain of records up to its end"))


def _put_together(spark: SparkSession, path: str, runs: DataFrame, chain: DataFrame, payloads: bool) -> DataFrame | None:
    """Records that hold marks, read again; None if there are none."""
    held = runs.join(chain.select("file", "run"), ["file", "run"], "left_semi").filter("not whole").select("file", "offset", "successor")
    held = materialise(held, "held")
    if not held.limit(1).count():
        return None
    # Every piece belongs to the last record that begins before it: in its block, or in an earlier one.
    chained = runs.join(chain.select("file", "run", F.lit(True).alias("chained")), ["file", "run"], "left").withColumn("start", F.when(F.col("chained"), F.col("offset")))
    files, here = Window.partitionBy("file").orderBy("block"), Window.partitionBy("file", "block").orderBy("at")
    last = chained.groupBy("file", "block").agg(F.max("start").alias("start")).select("file", "block", F.max("start").over(files.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    owned = chained.join(last, ["file", "block"]).withColumn("owner", F.coalesce(F.max("start").over(here), "earlier"))
    wanted = owned.join(held.select("file", F.col("offset").alias("owner")), ["file", "owner"]).select("file", "block", "k", "offset", "owner")
    again = _pieces(spark, path).join(held.select("file").distinct(), "file", "left_semi").withColumn("k", F.row_number().over(here))
    parts = wanted.join(again, ["file", "block", "k"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    return parsed(parts.select(F.array_join(F.transform("parts", lambda x: x["value"]), MARK).alias("value")), payloads)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id (null if the record's name is not a page's), url, record_type, refers_to, payload_bytes, payload_digest, payload
    (null for revisits, and without `payloads`) of every record.

    Digest and size are those of the payload read: of a response what follows its HTTP header, of other records the block; a
    revisit has them from its own headers. Empty files and folders have no record. A response whose payload does not have the
    digest its header states is an error, and so is an archive that is damaged or cut off. A record has to fit in a row.
    """
    pieces = materialise(parsed(_pieces(spark, path), payloads), "pieces")
    runs, chain = reached_runs(positions(pieces))
    check_ends(pieces, runs, chain)
    plain = runs.filter("whole").join(chain.select("file", "run"), ["file", "run"], "left_semi").select(*PIECE)
    columns = ["kind", "name", "uri", "refers", "stated", "n", "digest", *(["payload"] if payloads else [])]
    found = pieces.join(plain, PIECE, "left_semi").select(*columns)
    mixed = _put_together(spark, path, runs, chain, payloads)
    if mixed is not None:
        found = found.unionByName(mixed.select(*columns))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    wrong = (F.col("kind") == "response") & (F.col("stated") != F.col("digest"))
    digest = F.when(wrong, F.raise_error(F.concat(F.lit("payload does not match its digest: record "), F.coalesce("name", F.lit("?"))))).when(F.col("kind") == "revisit", F.col("stated")).otherwise(F.col("digest"))
    out = found.select(page("name").alias("page_id"), F.col("uri").alias("url"), F.col("kind").alias("record_type"), page("refers").alias("refers_to"), F.col("n").alias("payload_bytes"), digest.alias("payload_digest"), *(["payload"] if payloads else []))
    return out if payloads else out.withColumn("payload", F.lit(None).cast("binary"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
