"""Exact Jaccard join of documents on five-word shingles, as a metric-space join.

Distance is 1 - Jaccard similarity, a metric; documents link at distance 0.25 or less.

1. Documents of equal sets collapse into one class; only classes are joined.
2. First-level pivots are single shingles in one global order: shingles that a sample shows to be frequent come last, by
   their frequency, others by hash. A document belongs to the region of its first pivot. The distance bound limits how far a
   partner's first common pivot can stand: with n shingles, a document is replicated into the regions of its first
   n - ceil(3n/4) + 1 pivots, so two linked documents meet in a region; sizes differ by a factor 3/4 at most. By the same
   bound two linked documents of n and m shingles, n <= m, share at least ceil(3(n + m)/7) - ceil(3m/4) + 1 of these regions:
   pairs that meet in fewer are ruled out without a look at the texts.
3. In each region a document is the next pivot (in large regions one for each size band); members are compared with it, a row
   a member, and what is linked is one component. Regions then join once, without recursion, only what is still in different
   components. In large regions the triangle inequality must allow it, |d(x, p) - d(y, p)| <= 0.25 for a common pivot p, and the pivot's
   places must: if it is the first common one, nothing before it is shared, and what is left must be enough.
4. Candidates are compared exactly on their whole texts.

Components are found by distributed label propagation with pointer jumping. Nothing is capped: which shingles count as
frequent changes the order, not the result.

Regions of shingles stand in for a Voronoi split by document pivots. A partner within 0.25 of a document may have any pivot
for its nearest that is at most 0.5 farther than the document's own, and these distances are nearly all close to 1: on the
9,296 distinct shingle sets of a 10,000-document corpus, with 1024 document pivots, 87 % of documents are 0.5 or more from
every pivot and a document would go to 893 of the 1024 regions (with 64 pivots: 99 %, 63.5 of 64), so that recursion splits
next to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, named, sliced, table

SHINGLE = 5
#: One document in SAMPLE is read to find frequent shingles; frequent: in FREQUENT of them. At most MOST_FREQUENT are told apart.
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 4, 2_000_000
#: Regions of ordinary shingles with more members than this are treated as those of frequent ones.
SMALL = 96
#: Members of a large region are compared in shares of about so many.
SHARE, SALTS = 1024, 32
#: Bits of the filter that keeps texts nobody asks for out of an exchange; its size is fixed.
FILTER_BITS = 1 << 23
KEPT_WORDS = 100_000
#: A class is large from this share of all documents on (1 / MOST_LARGE), but not below LEAST_LARGE documents.
MOST_LARGE, LEAST_LARGE = 4096, 1000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _Hashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text: words are runs without ASCII white space, A-Z
    lower-cased; fewer than five words are one shingle; no word, none."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.array(list(map(_hashes.__getitem__, words)), dtype=np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    if len(h) < SHINGLE:
        z = (h * _ODD[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h))
    else:
        z = h[:n] * _ODD[0]
        for k in range(1, SHINGLE):
            z = z + h[k : k + n] * _ODD[k]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(z ^ (z >> np.uint64(31)))


def prefix(n: int) -> int:
    """How many of its first pivots a document of n shingles is replicated to."""
    return n - -(-3 * n // 4) + 1


def frequent_shingles(docs: DataFrame, sample: int = SAMPLE, least: int = FREQUENT, most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of shingles that are in `least` sampled documents or more; the bar rises until at most `most` are
    left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                sets = [shingle_set(t) for t in b["text"][at : at + 500]]
                yield pd.DataFrame({"h": np.concatenate([np.empty(0, dtype=np.uint64), *sets]).view("int64")})

    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0).select("text")
    counts = materialise(some.mapInPandas(run, "h long").groupBy("h").count().filter(F.col("count") >= least), "frequent")
    sizes = {r["c"]: r["n"] for r in counts.groupBy(F.least("count", F.lit(100_000)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, bar = 0, least
    for c in sorted(sizes, reverse=True):
        total += sizes[c]
        if total > most:
            bar = c + 1
            break
    found = np.array([(r["h"], r["count"]) for r in counts.filter(F.col("count") >= bar).select("h", "count").toLocalIterator()], dtype=np.int64).reshape(-1, 2)
    hashes = found[:, 0].copy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.minimum(found[order, 1], 1 << 30)


def signatures(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n, k1, k2 (a 128-bit name of the set), pivots (its first pivots in the global order), ordinary (how many of
    them are not frequent)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, often = shared.value
        for b in sliced(batches):
            n, names, firsts, ordinary = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text)
                k = prefix(len(s)) if len(s) else 0
                first, cold = s[:k], k
                if k and len(bad):
                    place = np.minimum(np.searchsorted(bad, s), len(bad) - 1)
                    hot = bad[place] == s
                    plain = s[~hot]
                    first, cold = plain[:k], min(k, len(plain))
                    if cold < k:
                        last = np.lexsort((s[hot], often[place[hot]]))
                        first = np.concatenate([first, s[hot][last[: k - cold]]])
                n.append(len(s))
                names.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8"))
                firsts.append(first.view("int64"))
                ordinary.append(cold)
            pivots = pa.ListArray.from_arrays(np.cumsum([0, *map(len, firsts)], dtype=np.int32), pa.array(np.concatenate(firsts)))
            k1, k2 = np.stack(names).T
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(k1.copy()), pa.array(k2.copy()), pivots, pa.array(ordinary, pa.int32()), b.column("doc_id")], names=["n", "k1", "k2", "pivots", "ordinary", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "n long, k1 long, k2 long, pivots array<bigint>, ordinary int, doc_id long")


def replicate(classes: DataFrame) -> DataFrame:
    """A row for each class (rep, n) and region: pivot, at (the pivot's place among the class's own), hot (a frequent pivot)."""
    r = classes.select("rep", "n", "ordinary", F.posexplode("pivots").alias("at", "pivot"))
    return r.select("pivot", "rep", "n", F.col("at").cast("long").alias("at"), (F.col("at") >= F.col("ordinary")).alias("hot"))


def meeting_rows(rows: DataFrame) -> DataFrame:
    """pivot, rep, n, at, c: the members of regions that have more than one. c: how many, null for frequent pivots, which are not
    gathered here. Ordinary rows go through one exchange, without their places (at is 0 then, a weaker bound)."""
    cold = rows.filter(~F.col("hot")).select("pivot", "rep", "n").repartition("pivot")
    met = cold.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("pivot"))).filter("c > 1")
    return met.select("pivot", "rep", "n", F.lit(0).cast("long").alias("at"), "c").unionByName(rows.filter("hot").select("pivot", "rep", "n", "at", F.lit(None).cast("long").alias("c")))


def member_lists(met: DataFrame) -> DataFrame:
    """members (n and rep, in order), weight: the small regions, and how many regions have just these members."""
    grouped = met.filter(F.col("c") <= SMALL).groupBy("pivot").agg(F.sort_array(F.collect_list(F.struct("n", "rep"))).alias("members"))
    return grouped.groupBy("members").agg(F.count(F.lit(1)).alias("weight"))


def list_stars(lists: DataFrame) -> DataFrame:
    """a, b, na, nb, c: each member of a small region with its first member of a fitting size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for members, weight in zip(b["members"], b["weight"]):
                start, size = members[0]["rep"], members[0]["n"]
                for r in members[1:]:
                    if 4 * size >= 3 * r["n"]:
                        x, y = ((start, size), (r["rep"], r["n"])) if start < r["rep"] else ((r["rep"], r["n"]), (start, size))
                        rows.append((x[0], y[0], x[1], y[1], weight))
                    else:
                        start, size = r["rep"], r["n"]
            yield pd.DataFrame(rows, columns=["a", "b", "na", "nb", "c"], dtype="int64").groupby(["a", "b", "na", "nb"], as_index=False)["c"].sum()

    return lists.mapInPandas(run, "a long, b long, na long, nb long, c long").groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))


def meetings(lists: DataFrame) -> DataFrame:
    """a, b, na, nb, c: pairs (a < b) of different labels whose sizes allow a link, and how many small regions they share.
    lists: members (array of struct n, rep, label, in order of n), weight."""

    def flush(found: list[np.ndarray]) -> pd.DataFrame:
        x = np.concatenate(found)
        flip = x[:, 0] > x[:, 1]
        x[flip] = x[flip][:, [1, 0, 3, 2, 4]]
        return pd.DataFrame(x, columns=["a", "b", "na", "nb", "c"]).groupby(["a", "b", "na", "nb"], as_index=False)["c"].sum()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[np.ndarray] = []
        size = 0
        for b in batches:
            for members, weight in zip(b["members"], b["weight"]):
                m = np.array([(r["n"], r["rep"], r["label"]) for r in members], dtype=np.int64)
                n, rep, label = m[:, 0], m[:, 1], m[:, 2]
                ends = np.searchsorted(n, 4 * n // 3, side="right")
                for i in range(len(n) - 1):
                    k = i + 1 + np.flatnonzero(label[i + 1 : ends[i]] != label[i])
                    if len(k):
                        found.append(np.stack([np.full(len(k), rep[i]), rep[k], np.full(len(k), n[i]), n[k], np.full(len(k), weight)], axis=1))
                        size += len(k)
                if size > 500_000:
                    yield flush(found)
                    found, size = [], 0
        if found:
            yield flush(found)

    return lists.mapInPandas(run, "a long, b long, na long, nb long, c long").groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))


def _enough(c: Column) -> Column:
    """Whether c common regions leave a link possible between sizes na and nb."""
    return c >= F.ceil(3 * (F.col("na") + F.col("nb")) / 7) - F.ceil(3 * F.greatest("na", "nb") / 4) + 1


def _elsewhere(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds `more`: an upper bound on the regions that a and b share besides those counted (counts: rep, k)."""
    both = pairs.join(counts.select(F.col("rep").alias("a"), F.col("k").alias("ka")), "a", "left").join(counts.select(F.col("rep").alias("b"), F.col("k").alias("kb")), "b", "left")
    return both.withColumn("more", F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0)))).drop("ka", "kb")


def _band() -> Column:
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("int")


def centres_of(wide: DataFrame, in_wide: DataFrame) -> DataFrame:
    """pivot, band, centre: the document pivot of each size band of the large regions. The member with most pivots in large
    regions has least of its own: it is near the middle of its family."""
    key = F.struct((-F.col("k")).alias("k"), "rep")
    return wide.join(in_wide, "rep").groupBy("pivot", _band().alias("band")).agg(F.min(key).alias("m")).select("pivot", "band", F.col("m.rep").alias("centre"))


def asked_for(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs that may be in wanted (distinct doc_id): tested against a bit table of fixed size, so that most texts nobody
    asks for never enter an exchange. Beyond some ten million wanted ids the table is full and lets most texts pass: the join
    that follows decides then, at the cost of an exchange of the texts."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = wanted.select((place / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    own = docs.withColumn("word", (place / 64).cast("long"))
    return own.join(F.broadcast(bits), "word").filter(F.getbit("bits", (place % 64).cast("int")) == 1).select("doc_id", "text")  # FILTER_BITS / 64 rows at most


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but those whose doc_id is in gone (one column, doc_id). Rows that the bit table shows not to be meant stay where they
    are; only the others go through an exchange to find out. A null doc_id is never meant."""
    # Names that no column of the caller's has.
    word, bits, maybe, gone_mark = (_free(docs, x) for x in ("word", "bits", "maybe", "gone"))
    cols = named(*docs.columns)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS))
    bit_table = gone.select((place / 64).cast("long").alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit")).groupBy(word).agg(F.bit_or("bit").alias(bits))
    marked = docs.withColumn(word, (place / 64).cast("long")).join(F.broadcast(bit_table), word, "left").withColumn(maybe, F.coalesce(F.getbit(bits, (place % 64).cast("int")) == 1, F.lit(False)))  # FILTER_BITS / 64 rows at most
    meant = gone.select("doc_id").distinct().withColumn(gone_mark, F.lit(True))
    rest = marked.filter(F.col(maybe)).select(*cols).join(meant, "doc_id", "left").filter(F.col(gone_mark).isNull())  # not an anti-join: that would be pushed below the filter
    return marked.filter(~F.col(maybe)).select(*cols).unionByName(rest.select(*cols))


def _free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def verify(pairs: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """a, b, common, either (sizes of intersection and union; linked: 100 x common >= 75 x either) by exact comparison of whole
    texts. pairs: a written table; repeated: whether a doc_id may repeat in docs."""
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = asked_for(docs, wanted).join(wanted, "doc_id")  # an inner join: a semi-join would be pushed below the filter
    if repeated:
        texts = texts.dropDuplicates(["doc_id"])
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(i: int, text: pa.StringScalar) -> np.ndarray:
            s = kept.get(i)
            if s is None:
                if len(kept) >= 64:
                    kept.clear()
                s = kept[i] = shingle_set(text.as_py())
            return s

        for b in batches:
            common, either = [], []
            ta, tb = b.column("ta"), b.column("tb")  # texts become Python strings one at a time
            for k, (x, y) in enumerate(zip(b.column("a").to_pylist(), b.column("b").to_pylist())):
                u, v = of(x, ta[k]), of(y, tb[k])
                common.append(len(np.intersect1d(u, v, assume_unique=True)))
                either.append(len(u) + len(v) - common[-1])
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(common, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "common", "either"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, common long, either long")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for every node that has a link (columns a, b). Each round's table is removed
    once the next one is written."""
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumn("old", F.lit(None).cast("long")), "labels")
    while True:
        now = labels.select("node", "label")
        near = edges.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = now.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = hooked.join(now.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
        step = materialise(jumped.select("node", F.least("label", F.coalesce("root", "label")).alias("label"), "old"), "labels")
        discard(labels)
        labels = step
        if not step.filter("label <> old").limit(1).count():
            discard(edges)
            return step.select("node", "label")


def _by_pivot(members: DataFrame, regions: DataFrame) -> DataFrame:
    """members with the columns of their region (one row a pivot). The members of a large region meet it in SALTS tasks."""
    salted = regions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(salted, ["pivot", "salt"]).drop("salt")


def spread_join(names: DataFrame, groups: DataFrame, labels: DataFrame) -> DataFrame:
    """names (doc_id, n, k1, k2) with `component` added: the class's label or, in a class of several documents without one,
    its smallest doc_id; null for lone documents.

    Documents find their class by its name, so a class of many copies would meet in one task. The classes with more than
    1/MOST_LARGE of all documents, MOST_LARGE at most, are broadcast and their documents stay where they are.
    """
    total = groups.agg(F.sum("c")).first()[0] or 0
    named = groups.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").filter("label is not null or c > 1").select("k1", "k2", "n", "c", F.coalesce("label", "rep").alias("component"))
    bar = max(total // MOST_LARGE, LEAST_LARGE)
    large = named.filter(F.col("c") > bar).select("k1", "k2", "n", F.col("component").alias("near"))
    met = names.join(F.broadcast(large), ["k1", "k2", "n"], "left")  # MOST_LARGE rows at most
    rest = met.filter("near is null").drop("near").join(named.filter(F.col("c") <= bar).drop("c"), ["k1", "k2", "n"], "left")
    return met.filter("near is not null").withColumnRenamed("near", "component").select(*rest.columns).unionByName(rest)


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable by links, a document's own without any. A null, empty or blank text has no
    shingle and no link. Rows that repeat a doc_id with one text are one document with a row each. Rows with a null doc_id
    link with nothing and have a null component_id. An empty table gives an empty one.
    """
    names, labels, _ = _search(docs, False)
    out = spread_join(names, _groups(names), labels)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))).alias("component_id"))


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity of every link between different sets, a < b; doc_id, representative of every row with a shingle and a
    doc_id). Documents of equal sets are one class, named by its smallest doc_id: a and b are such names, so copies are not
    expanded. Unlike jaccard_classes, which stops at components, this compares all pairs that the regions leave open, and takes
    time by the number of links."""
    names, _, links = _search(docs, True)
    named = names.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    nobody = links.select(F.col("a").alias("node"), F.col("b").alias("label")).filter("false")
    return links, spread_join(named, _groups(named), nobody).select("doc_id", F.coalesce("component", "doc_id").alias("representative"))


def _groups(names: DataFrame) -> DataFrame:
    """k1, k2, n, rep, c: the classes of equal sets, their smallest doc_id and their number of rows."""
    return names.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c"))


def _search(docs: DataFrame, every: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(names: doc_id, n, k1, k2; labels of linked representatives; with `every` all links: a, b, similarity). Without `every` pairs
    already in one component are not compared."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.filter(F.col("doc_id").isNotNull())
    signed = materialise(signatures(docs, frequent_shingles(named)), "signatures")
    usable = signed.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = usable.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("pivots").alias("pivots"), F.first("ordinary").alias("ordinary"))
    repeated = bool(signed.groupBy("doc_id").count().filter("count > 1").limit(1).count())
    met = materialise(meeting_rows(replicate(classes)), "regions")
    names = materialise(signed.drop("pivots", "ordinary"), "names")
    discard(signed)
    lists = materialise(member_lists(met), "lists")
    wide = met.filter(F.col("c").isNull() | (F.col("c") > SMALL)).select("pivot", "rep", "n", "at")
    # First: every region's members with its document pivots.
    in_wide = wide.groupBy("rep").agg(F.count(F.lit(1)).alias("k"))
    centres = materialise(centres_of(wide, in_wide), "centres")
    banded = wide.withColumn("band", _band())
    star = banded.join(centres, ["pivot", "band"]).filter("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    stars = _elsewhere(list_stars(lists), in_wide).filter(_enough(2 * F.col("c") + F.col("more"))).select("a", "b")
    first = materialise(stars.unionByName(star).distinct(), "first")
    compared = materialise(verify(first, named, repeated), "compared")
    discard(first)
    linked = F.col("common") * 100 >= F.col("either") * 75
    links = compared.filter(linked).select("a", "b")
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("label")).filter("false") if every else components(links)
    # Then: what is still in different components. Small regions:
    numbered = lists.withColumn("list", F.xxhash64("members", "weight"))
    flat = numbered.select("list", "weight", F.explode("members").alias("m")).select("list", "weight", "m.n", "m.rep")
    flat = flat.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = flat.groupBy("list", "weight").agg(F.sort_array(F.collect_list(F.struct("n", "rep", "label"))).alias("members"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("members", "weight")
    direct = _elsewhere(meetings(mixed), in_wide).filter(_enough(F.col("c") + F.col("more"))).select("a", "b")
    # Large regions:
    mine = banded.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    open_ = mine.groupBy("pivot", "label").count().groupBy("pivot").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("count", "label")).alias("main")).filter("labels > 1").select("pivot", "main")
    distance = compared.select("a", "b", (1 - F.col("common") / F.col("either")).alias("d"))
    distance = distance.unionByName(distance.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    # The largest partner with which this pivot may be the first common one: nothing before it is shared.
    mine = mine.withColumn("cap", F.floor(7 * (F.col("n") - F.col("at")) / 3) - F.col("n"))
    left = _by_pivot(mine, open_).join(centres, ["pivot", "band"]).join(distance.select(F.col("a").alias("rep"), F.col("b").alias("centre"), "d"), ["rep", "centre"], "left")
    left = materialise(left.select("pivot", "rep", "n", "cap", "label", "main", "centre", F.when(F.col("rep") == F.col("centre"), 0.0).otherwise(F.col("d")).alias("d")), "unsettled")
    # Members of a region are dealt out in shares; those outside its main component, the smaller side, go to each of them.
    span = left.groupBy("pivot").agg(F.min("n").alias("n0"), (1 + F.floor(F.count(F.lit(1)) / SHARE)).cast("int").alias("shares"))
    able = _by_pivot(left, span).filter(F.col("cap") >= F.greatest("n0", F.ceil(3 * F.col("n") / 4)))
    x = able.filter("label <> main").select("pivot", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), *(F.col(c).alias("x" + c) for c in ("rep", "n", "cap", "label", "centre", "d")))
    y = able.select(F.col("pivot").alias("ypivot"), F.pmod(F.xxhash64("rep"), F.col("shares")).cast("int").alias("yshare"), *(F.col(c).alias("y" + c) for c in ("rep", "n", "cap", "label", "main", "centre", "d")))
    fit = (F.col("xlabel") != F.col("ylabel")) & ((F.col("ylabel") == F.col("ymain")) | (F.col("xrep") < F.col("yrep")))
    sizes = (4 * F.col("xn") >= 3 * F.col("yn")) & (4 * F.col("yn") >= 3 * F.col("xn")) & (F.col("yn") <= F.col("xcap")) & (F.col("xn") <= F.col("ycap"))
    window = (F.col("xcentre") != F.col("ycentre")) | F.coalesce(F.abs(F.col("xd") - F.col("yd")) <= 0.25 + 1e-9, F.lit(True))
    across = x.join(y, (F.col("pivot") == F.col("ypivot")) & (F.col("share") == F.col("yshare")) & fit & sizes & window).select(F.least("xrep", "yrep").alias("a"), F.greatest("xrep", "yrep").alias("b"))
    second = direct.unionByName(across).distinct().join(compared.select("a", "b"), ["a", "b"], "left_anti")
    second = materialise(second, "second")
    more = materialise(verify(second, named, repeated), "compared-more")
    again = more.filter(linked).select("a", "b")
    found = None
    if every:
        found = materialise(compared.unionByName(more).filter(linked).select("a", "b", (F.col("common") / F.col("either")).alias("similarity")), "links")
    elif again.limit(1).count():
        labels = components(links.unionByName(again))
    for done in (met, lists, centres, left, second, more, compared):
        discard(done)  # what follows reads names, labels and links only
    return names, labels, found


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
