"""Checks of structured answers (JSON) of text generators, as column expressions: evidence tables and reviews of drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labels, text

#: What an answer may say, and how long a summary may be.
STATUS = ["supported", "partially_supported", "unsupported"]
ISSUES = ["unsupported_finding_stated", "missed_strongly_supported_finding", "no_finding_contradiction", "abnormal_to_normal_collapse", "invented_measurement_history_or_comparison", "excessive_certainty", "duplication_or_repetition", "malformed_structure", "none"]
SUMMARY_WORDS, SHARED_WORDS = 20, 6

_ENTRY = "array<struct<finding: string, supporting_ranks: array<string>, support_status: string, evidence_summary: string>>"
EVIDENCE = f"classifier_findings {_ENTRY}, retrieval_only_candidates {_ENTRY}, normal_report_ranks array<string>"
REVIEW = "decision string, issues_detected array<string>, findings string, impression string"


def _none() -> Column:
    return F.array().cast("array<string>")


def _when(test: Column, flag: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.array(F.lit(flag))).otherwise(_none())


def ranks(stated: Column, k: Column) -> Column:
    """The distinct whole numbers from 1 to k among the stated ones, in order."""
    whole = F.transform(F.filter(F.coalesce(stated, _none()), lambda x: x.rlike(r"^\d{1,9}$")), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(whole, lambda x: x.between(1, k))))


def _grams(x: Column) -> Column:
    return text.ngrams(text.tokens(x), SHARED_WORDS)


def _summary(stated: Column, found: Column, k: Column, sources: Column) -> Column:
    """struct(text, truncated, replaced): one line of at most SUMMARY_WORDS words; one that is empty or shares SHARED_WORDS words in a
    row with a source gives way to a fixed sentence."""
    fixed = F.when(F.size(found) > 0, F.format_string("Stated in %d of %d retrieved reports.", F.size(found), k)).otherwise(F.lit("Not stated in any retrieved report."))

    def of(words: Column, line: Column) -> Column:
        made = lambda replaced: F.struct(F.when(replaced, fixed).otherwise(line).alias("text"), (F.size(words) > SUMMARY_WORDS).alias("truncated"), replaced.alias("replaced"))
        return text.bound((line == "") | F.arrays_overlap(_grams(line), F.flatten(F.transform(sources, _grams))), made)

    # Each is used several times, by an expression in a lambda: it is computed once.
    return text.bound(text.words(stated), lambda words: text.bound(F.array_join(F.slice(words, 1, SUMMARY_WORDS), " "), lambda line: of(words, line)))


def validate_evidence(df: DataFrame, raw: str, positives: str, k: str, sources: str, names: list[str]) -> DataFrame:
    """df with entries, candidates, normal_ranks and flags.

    raw: the answer; positives: array of struct(finding, probability); k: how many reports were retrieved; sources: their texts
    (array). entries: one for each positive finding in order of `names`, with ranks restricted to 1 .. k, count and status
    recomputed from them, and the status the answer stated. candidates: other findings of `names` with a valid rank, each once,
    most ranks first. An answer that is no JSON object counts as empty. flags: sorted, each once.
    """
    place = lambda f: F.array_position(F.array(*map(F.lit, names)), f)
    out = df.withColumn("__a", text.json_field(F.col(raw), EVIDENCE)).withColumn("__given", F.coalesce("__a.classifier_findings", F.array().cast(_ENTRY.replace(": ", ":"))))
    out = out.withColumn("__pos", F.transform(F.array_sort(F.transform(positives, lambda p: F.struct(place(p["finding"]).alias("at"), p.alias("p")))), lambda s: s["p"]))
    own = lambda e: F.array_contains(F.transform("__pos", lambda p: p["finding"]), e["finding"])
    kept = F.filter("__given", lambda e, i: own(e) & (F.array_position(F.transform("__given", lambda x: x["finding"]), e["finding"]) == i + 1))
    out = out.withColumn("__kept", kept)

    def entry(p: Column) -> Column:
        return text.bound(F.get(F.filter("__kept", lambda x: x["finding"] == p["finding"]), F.lit(0)), lambda e: text.bound(ranks(e["supporting_ranks"], F.col(k)), lambda found: made(p, e, found)))

    def made(p: Column, e: Column, found: Column) -> Column:
        stated = F.when(e["support_status"].isin(STATUS), e["support_status"])
        return F.struct(
            p["finding"].alias("finding"), F.round(p["probability"], 4).alias("probability"), F.size(found).alias("count"), found.alias("ranks"),
            _summary(e["evidence_summary"], found, F.col(k), F.col(sources)).alias("summary"), labels.support_status(F.size(found)).alias("status"), stated.alias("stated_status"), e.isNull().alias("omitted"),
        )

    out = out.withColumn("entries", F.transform("__pos", entry))
    other = F.coalesce("__a.retrieval_only_candidates", F.array().cast(_ENTRY.replace(": ", ":")))
    other = F.filter(other, lambda e: (place(e["finding"]) > 0) & ~own(e) & (F.size(ranks(e["supporting_ranks"], F.col(k))) > 0))
    out = out.withColumn("__other", other)
    once = F.filter("__other", lambda e, i: F.array_position(F.transform("__other", lambda x: x["finding"]), e["finding"]) == i + 1)
    candidate = lambda e, found: F.struct((-F.size(found)).alias("order"), place(e["finding"]).alias("place"), e["finding"].alias("finding"), found.alias("ranks"), _summary(e["evidence_summary"], found, F.col(k), F.col(sources)).alias("summary"))
    out = out.withColumn("candidates", F.array_sort(F.transform(once, lambda e: text.bound(ranks(e["supporting_ranks"], F.col(k)), lambda found: candidate(e, found)))))
    said = F.concat(F.transform("entries", lambda e: e["summary"]), F.transform("candidates", lambda e: e["summary"]))
    flags = F.concat(
        _when(F.col("__a").isNull(), "unparseable"),
        _when(F.size("__given") > F.size("__kept"), "extra_or_duplicate_entry"),
        _when(F.exists("entries", lambda e: e["omitted"]), "omitted_finding"),
        _when(F.exists("entries", lambda e: ~e["stated_status"].eqNullSafe(e["status"])), "status_inconsistent_with_count"),
        _when(F.exists(said, lambda s: s["truncated"]), "summary_truncated"),
        _when(F.exists(said, lambda s: s["replaced"]), "summary_replaced"),
    )
    return out.withColumn("normal_ranks", ranks(F.col("__a.normal_report_ranks"), F.col(k))).withColumn("flags", F.array_sort(flags)).drop("__a", "__given", "__pos", "__kept", "__other")


def parse_review(df: DataFrame, raw: str, findings: str, impression: str) -> DataFrame:
    """df with action, final_findings, final_impression, issues, same_copy and flags, from a review (raw) of a draft.

    APPROVE keeps the draft exactly; REVISE gives the corrected report, if it is complete and says something else; anything else
    keeps the draft and is flagged. Nothing is made up.
    """
    out = df.withColumn("__a", text.json_field(F.col(raw), REVIEW))
    out = out.withColumn("__f", text.collapse(F.col("__a.findings"))).withColumn("__i", text.collapse(F.col("__a.impression")))
    plain = lambda c: F.array_join(text.tokens(c), " ")
    same = (plain(F.col("__f")) == plain(F.col(findings))) & (plain(F.col("__i")) == plain(F.col(impression)))
    out = out.withColumn("same_copy", F.when(F.col("__a").isNotNull(), same)).withColumn("issues", F.when(F.col("__a").isNull(), _none()).otherwise(F.filter(F.coalesce("__a.issues_detected", _none()), lambda i: i.isin(ISSUES))))
    says, complete = F.col("__a.decision"), (F.col("__f") != "") & (F.col("__i") != "")
    action = F.when(F.col("__a").isNull(), "unparseable_kept_draft").when(says == "APPROVE", "approve").when(says == "REVISE", F.when(~complete, "revise_unusable_kept_draft").when(F.col("same_copy"), "approve").otherwise("revise")).otherwise("unparseable_kept_draft")
    approve, revise = F.coalesce(says == "APPROVE", F.lit(False)), F.coalesce(says == "REVISE", F.lit(False))
    flags = F.concat(
        _when(F.col("__a").isNull(), "unparseable"),
        _when(approve & ~F.col("same_copy"), "approve_with_changed_copy_ignored"),
        _when(approve & (F.size("issues") > 0) & (F.col("issues") != F.array(F.lit("none"))), "approve_with_issues"),
        _when(revise & ~complete, "revise_without_complete_report"),
        _when(revise & complete & F.col("same_copy"), "revise_but_identical"),
        _when(F.col("__a").isNotNull() & ~approve & ~revise, "missing_decision"),
    )
    new = action == "revise"
    out = out.withColumn("action", action).withColumn("final_findings", F.when(new, F.col("__f")).otherwise(F.col(findings))).withColumn("final_impression", F.when(new, F.col("__i")).otherwise(F.col(impression)))
    return out.withColumn("flags", flags).drop("__a", "__f", "__i")
