"""Language identification, word first.

A known word adds its log frequency in each language. An unseen word backs off: its character 5-grams (with word ends) are
looked up, then 4-grams, down to single characters, until an order has any known one; the mean of those log frequencies
stands for the word. The language with the highest sum, with the languages' shares as a prior, wins.

The model is fitted on at most DOCS_PER_LANGUAGE labelled documents of each language (chosen by a hash of doc_id) and keeps
the WORDS most frequent words of each and the GRAMS most frequent n-grams of each order; all are parameters.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import named, sliced, table, undotted, without_names

DOCS_PER_LANGUAGE, WORDS, GRAMS, ORDERS, KEPT_WORDS, LONG_WORD = 1500, 20_000, 30_000, 5, 60_000, 64
#: A word is evidence of a learned language if it is known or has a known n-gram of this order or a higher one.
TELLING = 4
LETTERS = re.compile(r"[^\W\d_]+")
NONE = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, words: int = WORDS) -> dict:
    """The model: languages, their log shares, words and n-grams with their log frequencies. docs: doc_id, text, lang of
    labelled rows. No labelled row with a letter gives a model without languages."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return {"langs": []}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    tokens = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).filter("word <> ''")
    counts = tokens.groupBy("lang", "word").count()
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).filter(F.col("k") <= words).select("lang", "word", "count")
    langs = sorted(sizes)
    place = {x: i for i, x in enumerate(langs)}
    known: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
    grams: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(len(langs))) for _ in range(ORDERS + 1)]
    for lang, word, n in best.collect():  # at most `words` rows a language
        known[word][place[lang]] += n
        edged = f" {word} "
        for order in range(1, ORDERS + 1):
            for i in range(len(edged) - order + 1):
                grams[order][edged[i : i + order]][place[lang]] += n
    if not known:
        return {"langs": []}

    def logs(found: dict[str, np.ndarray], least: int, most: int | None = None) -> tuple[dict[str, int], np.ndarray]:
        """Entries seen `least` times, the `most` most frequent ones, as rows of one matrix of log frequencies."""
        total = sum(found.values())
        smooth = 0.5
        floor = np.log(total + smooth * len(found))
        kept = sorted((k for k, v in found.items() if v.sum() >= least), key=lambda k: (-found[k].sum(), k))[:most]
        return {k: i for i, k in enumerate(kept)}, np.array([np.log(found[k] + smooth) - floor for k in kept], dtype=np.float32).reshape(-1, len(langs))

    every = sum(sizes.values())
    return {"langs": langs, "prior": np.array([math.log(sizes[x] / every) for x in langs]), "words": logs(known, 2), "grams": [None] + [logs(g, 3, GRAMS) for g in grams[1:]]}


class Scorer:
    """Known words are rows of the model itself. Up to about KEPT_WORDS others are kept as rows of a matrix, so that their n-grams are looked
    up once."""

    def __init__(self, model: dict):
        self.model, self.langs = model, model["langs"]
        self.rows: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.rows.clear()
        self.matrix = np.zeros((1024, len(self.langs) + 1), dtype=np.float64)

    def backoff(self, word: str) -> np.ndarray | None:
        """Log frequencies by language of a word that is not known and, last, 1 if it is evidence of a learned language; none if no
        character of it is known."""
        edged = f" {word} "
        for order in range(min(ORDERS, len(edged)), 0, -1):
            known, values = self.model["grams"][order]
            hits = [v for i in range(len(edged) - order + 1) if (v := known.get(edged[i : i + order])) is not None]
            if hits:
                out = np.empty(len(self.langs) + 1)
                out[:-1] = np.add.reduce(values.take(hits, axis=0), axis=0) / np.float32(len(hits))
                out[-1] = order >= TELLING
                return out
        return None

    def vector(self, word: str) -> np.ndarray:
        """Log frequencies by language and, last, 1 if the word is evidence of a learned language."""
        known, values = self.model["words"]
        found = known.get(word)
        if found is not None:
            return np.append(values[found], 1)
        out = self.backoff(word)
        return np.zeros(len(self.langs) + 1) if out is None else out

    def row(self, word: str) -> int:
        n = len(self.rows)
        if n >= len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        out = self.backoff(word)
        self.matrix[n] = 0 if out is None else out
        self.rows[word] = n
        return n

    def vectors(self, index: list[int]) -> np.ndarray:
        """The vectors of known words (their rows of the model) and of others (-1 less their rows of the matrix)."""
        at = np.array(index)
        out, other = np.empty((len(at), len(self.langs) + 1)), at < 0
        values = self.model["words"][1]
        if len(values):
            out[:, :-1] = values.take(at, axis=0, mode="clip")
        out[:, -1] = 1
        out[other] = self.matrix.take(-1 - at[other], axis=0)
        return out

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and the share of words that are evidence of a learned language."""
        words = LETTERS.findall(text.lower()) if text else []
        if not words or not self.langs or not any(c.isalpha() for w in words for c in w):
            return NONE, 0.0, 0.0
        if len(self.rows) > KEPT_WORDS:
            self._reset()
        found = Counter(words)
        total, index, counts, known = np.zeros(len(self.langs) + 1), [], [], self.model["words"][0]
        for w, c in found.items():
            if len(w) > LONG_WORD:
                total += c * self.vector(w)
            else:
                k = known.get(w)
                if k is None:
                    r = self.rows.get(w)
                    k = -1 - (self.row(w) if r is None else r)
                index.append(k)
                counts.append(c)
        if index:
            total += (np.array(counts, dtype=np.float64)[:, None] * self.vectors(index)).sum(axis=0)
        # The share of the best language, with the evidence of a long text counted as that of 20 words.
        evidence = total[-1] / len(words)
        total = total[:-1] * (min(len(words), 20) / len(words)) + self.model["prior"]
        p = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.langs[best], float(p[best] / p.sum()), float(evidence)


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """Adds lang_pred, score and evidence (share of words known to any language) to docs (columns kept, other columns of these
    names replaced).

    `und` with score 0 where the text is null or has no letter, or the model knows no language. Whole texts are read. Repeated
    rows give repeated results, an empty table an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS and the number of languages
    added = ["lang_pred", "score", "evidence"]
    names = without_names(docs, added)
    kept = undotted(docs.select(*named(*names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in sliced(batches):
            lang, score, evidence = zip(*(scorer.predict(t) for t in b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(evidence, pa.float64())], names=[*b.schema.names, *added])

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType())])
    return kept.mapInArrow(run, schema).toDF(*names, *added)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
