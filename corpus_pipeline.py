"""A corpus pipeline: toxic documents go, then those in no known language, then near duplicates but one of each group; what is
left is packed into sequences. Each stage works on what its predecessor kept, and what a stage wrote is removed once its
successor is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm import jaccard, language, packing, toxicity
from marlstone.llm.common import discard, materialise, named, table
from marlstone.llm.tokens import default_ranks


#: Least share of a document's words that must be known to some learned language. Documents of the learned ones have 0.63 or more
#: (61,000 synthetic ones measured), texts in other scripts 0.
LEAST_EVIDENCE = 0.3


def _aside(docs: DataFrame, taken: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of the names an operator adds (in any case) put aside, and how to name them back."""
    clash = {c: f"__aside_{c}" for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed(clash), {v: k for k, v in clash.items()}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not judge toxic. Null and empty texts stay for the next stage, rows that repeat a document
    share its fate, an empty table stays empty."""
    added = {"severity", "p_toxic", "toxic"}
    held, back = _aside(docs, added)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.judge(held, model).filter(~F.col("toxic")).drop(*added).withColumnsRenamed(back).select(*named(*docs.columns))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows: null texts and texts without a letter go, and those of whose words less than
    LEAST_EVIDENCE are known. Rows that repeat a document share its fate. Where no document has a language label nothing is learned and only texts without a letter go."""
    added = {"lang_pred", "score", "evidence"}
    held, back = _aside(docs, added)
    model = language.train(docs.select("doc_id", "text", "lang"))
    if not model["langs"]:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return language.identify(held, model).filter((F.col("lang_pred") != language.NONE) & (F.col("evidence") >= LEAST_EVIDENCE)).drop(*added).withColumnsRenamed(back).select(*named(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates (texts without words are in no group). Of
    rows that repeat a doc_id the one with the smallest text (null before others, then by bytes) stays. Rows without a doc_id
    stay."""
    classes = materialise(jaccard.jaccard_classes(docs), "classes")
    gone = classes.filter(F.col("component_id") != F.col("doc_id")).select("doc_id")
    kept = jaccard.without(docs, gone)
    if classes.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").limit(1).count():
        place = next(c for c in (f"turn{'_' * k}" for k in range(len(kept.columns) + 1)) if c not in {x.lower() for x in kept.columns})
        with_id, rest = kept.filter(F.col("doc_id").isNotNull()), [named(c)[0].cast("string").asc_nulls_first() for c in sorted(kept.columns) if c not in ("doc_id", "text")]
        turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first(), *rest))
        kept = with_id.withColumn(place, turn).filter(F.col(place) == 1).drop(place).unionByName(kept.filter(F.col("doc_id").isNull()))
    return kept


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 2048 tokens. A null or empty text is one piece, its end id; rows
    that repeat a document are packed each; an empty table gives none."""
    return packing.pack_documents(docs, default_ranks())


STAGES = [("toxicity", drop_toxic), ("language ID", keep_languages), ("n-gram Jaccard join", drop_near_duplicates), ("best-fit packing", best_fit_packing)]

#: The stages learn models and tokenise: SQL cannot express them. tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, "stage-" + name.replace(" ", "-"))
            if before is not None:
                discard(before)
            before = docs
    return docs
