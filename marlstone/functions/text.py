"""Text functions: columns to columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t\n\x0B\f\r ]+"
#: What a section says when it says nothing.
PLACEHOLDERS = ["", "none", "none.", "n/a", "na", "nan", "null", "-", "."]
#: Fixed value: words (with an apostrophe part), numbers, single marks.
TOKEN = r"[A-Za-z]+(?:'[a-z]+)?|\d+(?:\.\d+)?|[^\sA-Za-z\d]"


#: Patterns of markup, of a heading at the start of a section, and of anonymised words.
MARKUP = "<[^>]+>|&(?:amp|lt|gt|quot|nbsp);"
HEADING = r"(?i)^\s*(?:findings?|impressions?|comparison|indication)\s*[:\-]\s*"
ANONYMISED = r"\bX{2,}\b"


def collapse(x: Column) -> Column:
    """White space runs to one space, ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), WS, " "))


def duplicate_key(x: Column) -> Column:
    """Lower case; what is not a-z, 0-9 or space becomes space; runs collapse."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9 ]", " "))


def identity_key(x: Column) -> Column:
    """Lower case; what is not a-z, 0-9 or space is deleted."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9 ]", ""))


def words(x: Column) -> Column:
    clean = collapse(x)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def token_count(x: Column) -> Column:
    """Words, numbers and punctuation marks."""
    return F.size(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(TOKEN), F.lit(0)))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def section_status(first: Column, rest: Column) -> Column:
    a, b = first != "", rest != ""
    return F.when(a & b, "both").when(a, "findings_only").when(b, "impression_only").otherwise("neither")


def clean_section(x: Column) -> Column:
    """Tags, entities, a leading heading and placeholder letters removed, punctuation tightened; empty if nothing is left."""
    s = F.regexp_replace(F.coalesce(x, F.lit("")), MARKUP, " ")
    s = F.regexp_replace(s, HEADING, "")
    s = F.regexp_replace(s, ANONYMISED, " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, WS, " "), r" +([.,;:])", "$1"))
    s = F.regexp_replace(s, r"^[.,;: ]+", "")
    return F.when(F.lower(s).isin(PLACEHOLDERS) | ~s.rlike("[A-Za-z]{2,}"), F.lit("")).otherwise(s)


def retrieval_text(first: Column, rest: Column) -> Column:
    """struct(text, source) of two cleaned sections."""
    same = identity_key(first) == identity_key(rest)
    both = (first != "") & (rest != "")
    text = F.when(both & ~same, F.concat_ws(" ", first, rest)).when(first != "", first).otherwise(rest)
    source = F.when(both & same, "both_identical").when(both, "findings+impression").when(first != "", "findings_only").when(rest != "", "impression_only").otherwise("none")
    return F.struct(text.alias("text"), source.alias("source"))


def sentences(x: Column) -> Column:
    parts = F.split(F.coalesce(x, F.lit("")), rf"(?<=[.;!?]){WS}|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, WS, " "))), lambda s: s != "")


def norm_sentences(x: Column) -> Column:
    """Sentences as their tokens joined by spaces; empty ones stay empty strings."""
    return F.transform(sentences(x), lambda s: F.array_join(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0)), " "))


def bound(x: Column, use) -> Column:
    """use(x), with x computed once: an expression inside a lambda would be computed anew for every element."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def ngrams(toks: Column, n: int) -> Column:
    """n-grams with multiplicity, as space-joined strings."""
    starts = lambda t: F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return bound(toks, lambda t: F.transform(starts(t), lambda i: F.array_join(F.slice(t, i, n), " ")))


def json_field(x: Column, schema: str) -> Column:
    """The JSON object in a text: the text itself, else its widest span in braces; null if neither is an object."""
    span = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    is_object = lambda t: F.startswith(F.schema_of_variant(F.try_parse_json(t)), F.lit("OBJECT"))
    return F.from_json(F.when(is_object(x), x).when(is_object(span), span), schema)


def parse_terms(x: Column) -> Column:
    """'A/b/C;D' as array of struct(term, quals): trimmed, qualifiers lower-cased, empty ones dropped."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), ";"), lambda p: F.transform(F.split(p, "/"), lambda b: F.trim(b)))
    kept = F.filter(parts, lambda b: b[0] != "")
    return F.transform(kept, lambda b: F.struct(b[0].alias("term"), F.filter(F.transform(F.slice(b, 2, 1000), lambda q: F.lower(q)), lambda q: q != "").alias("quals")))


def phrase(names: Column, separator: str = ", ") -> Column:
    """Names as one lower-case phrase with underscores and spaces alike; null for none."""
    return F.when(F.size(names) > 0, F.array_join(F.transform(names, lambda n: F.lower(F.regexp_replace(n, "[_ ]+", " "))), separator))
