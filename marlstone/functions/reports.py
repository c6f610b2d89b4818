"""Two-section reports from generated text, as column expressions.

A heading line opens a section; a findings heading after an impression heading ends the report. Up to there all findings
headings stand before all impression headings, so three line numbers cut the text: the first heading, the first impression
heading and the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of a section heading.
HEADING = r"(?iU)^[\s>*#_`-]*\**\s*(FINDINGS?|IMPRESSIONS?)\s*\**\s*[:\-]?\s*\**\s*(.*)$"
#: Where an echo of the prompt begins; a longer line is no heading.
ECHOES = ("A. AUTOMATED CLASSIFIER OUTPUT", "B. RETRIEVED EVIDENCE", "C. EVIDENCE SUMMARY")
LONGEST_HEADING = 400


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def _line(x: Column) -> Column:
    """kind (F, I or empty) and what the line adds to its section."""
    kind = F.when(F.char_length(_bare(x)) < LONGEST_HEADING, F.upper(F.substring(F.regexp_extract(x, HEADING, 1), 1, 1))).otherwise("")
    rest = F.regexp_extract(x, HEADING, 2)
    return F.struct(kind.alias("kind"), F.when(kind == "", _bare(x)).when(F.regexp_replace(rest, "[ *_]", "") != "", _bare(rest)).otherwise("").alias("adds"))


def parsed(df: DataFrame, text_col: str) -> DataFrame:
    """df with findings, impression, format_ok and flags (an array, in order of finding) added.

    A text without headings is findings as a whole; from an echo mark on, and from a findings heading after an impression
    heading on, nothing counts, and each heading there is a flag. Null is empty text. Columns of the added names are replaced.
    """
    added = ("findings", "impression", "format_ok", "flags")
    out = df.drop(*(c for c in added if c != text_col)).withColumn("__t", F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\r"), F.lit("")))
    echo = F.least(*(F.nullif(F.locate(m, F.col("__t")), F.lit(0)) for m in ECHOES))
    out = out.withColumn("__echo", echo).withColumn("__t", F.when(F.col("__echo").isNotNull(), F.substring("__t", F.lit(1), F.col("__echo") - 1)).otherwise(F.col("__t")))
    out = out.withColumn("__lines", F.transform(F.split("__t", "\n", -1), _line))
    numbered = F.transform("__lines", lambda x, i: F.struct(i.alias("at"), x["kind"].alias("kind")))
    out = out.withColumn("__heads", F.filter(numbered, lambda h: h["kind"] != ""))
    turns = F.filter(F.transform("__heads", lambda h, j: F.struct(h["at"].alias("at"), j.alias("j"), ((h["kind"] == "F") & (F.get("__heads", j - 1)["kind"] == "I")).alias("ends"))), lambda h: h["ends"])
    end = F.coalesce(F.get(turns, F.lit(0))["at"], F.size("__lines"))
    out = out.withColumn("__end", end).withColumn("__again", F.size(F.filter("__heads", lambda h: h["at"] >= F.col("__end"))))
    first = F.coalesce(F.get("__heads", F.lit(0))["at"], F.col("__end"))
    second = F.coalesce(F.get(F.filter("__heads", lambda h: (h["kind"] == "I") & (h["at"] < F.col("__end"))), F.lit(0))["at"], F.col("__end"))
    part = lambda a, b: F.array_join(F.filter(F.transform(F.slice("__lines", a + 1, F.greatest(b - a, F.lit(0))), lambda x: x["adds"]), lambda x: x != ""), " ")
    out = out.withColumn("__before", part(F.lit(0), first)).withColumn("__none", F.size("__heads") == 0)
    out = out.withColumn("findings", _bare(F.when(F.col("__none"), F.col("__before")).otherwise(part(first, second)))).withColumn("impression", _bare(part(second, F.col("__end"))))
    when = lambda test, flag: F.when(test, F.array(F.lit(flag))).otherwise(F.array().cast("array<string>"))
    soft = F.concat(when(F.col("__echo").isNotNull(), "echoed_input_removed"), F.array_repeat(F.lit("repeated_section_ignored"), F.col("__again")))
    hard = F.concat(
        when(F.col("__none"), "no_headings_whole_text_as_findings"),
        when(~F.col("__none") & (F.col("__before") != ""), "text_before_first_heading"),
        when(F.col("findings") == "", "empty_findings"),
        when(F.col("impression") == "", "empty_impression"),
    )
    out = out.withColumn("__hard", hard).withColumn("format_ok", F.size("__hard") == 0).withColumn("flags", F.concat(soft, "__hard"))
    return out.drop("__t", "__echo", "__lines", "__heads", "__end", "__again", "__before", "__none", "__hard")


def parse_reports(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, findings, impression, format_ok, flags (joined by ;)."""
    slim = parsed(df.select(F.col(id_col).alias(id_col), F.col(text_col).alias("t")), "t")
    return slim.select(id_col, "findings", "impression", "format_ok", F.array_join("flags", ";").alias("flags"))
