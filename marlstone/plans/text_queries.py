"""Queries: text cleaning, parsing, term mapping and assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import assertion, reports, text
from .base import SECTIONS, r6, sections, t
from .registry import query

WS = r"[\t\n\x0B\f\r ]+"
_CLEAN = rf"trim(regexp_replace(%s, '{WS}', ' ', 'g'))"
_KEY = rf"trim(regexp_replace(regexp_replace(lower(%s), '[^a-z0-9 ]', ' ', 'g'), '{WS}', ' ', 'g'))"
_SENT = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace(%s, '([.;!?]){WS}', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '{WS}', ' ', 'g'))), lambda s: s <> '')"
_TOK = "regexp_extract_all(lower(%s), '[a-z0-9]+')"
_SECTION = r"regexp_replace(regexp_replace(regexp_replace(%s, '<[^>]+>|&(?:amp|lt|gt|quot|nbsp);', ' ', 'g'), '(?i)^\s*(?:findings?|impressions?|comparison|indication)\s*[:\-]\s*', ''), '\bX{2,}\b', ' ', 'g')"
_SECTION = rf"regexp_replace(trim(regexp_replace(regexp_replace({_SECTION}, '{WS}', ' ', 'g'), ' +([.,;:])', '\1', 'g')), '^[.,;: ]+', '')"


def _section(x: str) -> str:
    s = _SECTION % x
    return f"(CASE WHEN lower({s}) IN ('', 'none', 'none.', 'n/a', 'na', 'nan', 'null', '-', '.') OR NOT regexp_matches({s}, '[A-Za-z]{{2,}}') THEN '' ELSE {s} END)"


@query("e1_clean_whitespace", f"SELECT doc_id, md5({_CLEAN % 'text'}) AS clean_md5, length({_CLEAN % 'text'})::BIGINT AS n FROM documents")
def e1(spark, sf) -> DataFrame:
    c = text.collapse(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("long").alias("n"))


@query("e2_duplicate_key", f"SELECT doc_id, md5({_KEY % 'text'}) AS key_md5 FROM documents")
def e2(spark, sf) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", F.md5(text.duplicate_key(F.col("text"))).alias("key_md5"))


@query("e3_word_and_token_counts", rf"SELECT doc_id, (CASE WHEN {_CLEAN % 'text'} = '' THEN 0 ELSE len(string_split({_CLEAN % 'text'}, ' ')) END)::BIGINT AS words, len(regexp_extract_all(text, '{text.TOKEN.replace(chr(39), chr(39) * 2)}'))::BIGINT AS tokens FROM documents")
def e3(spark, sf) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("words"), text.token_count(F.col("text")).cast("long").alias("tokens"))


@query("e4_section_status", f"WITH {SECTIONS}, c AS (SELECT doc_id, {_CLEAN % 'first'} AS a, {_CLEAN % 'rest'} AS b FROM sec) SELECT doc_id, CASE WHEN a <> '' AND b <> '' THEN 'both' WHEN a <> '' THEN 'findings_only' WHEN b <> '' THEN 'impression_only' ELSE 'neither' END AS status, md5(concat_ws(' ', nullif(a, ''), nullif(b, ''))) AS combined_md5 FROM c")
def e4(spark, sf) -> DataFrame:
    c = sections(spark, sf).select("doc_id", text.collapse(F.col("first")).alias("a"), text.collapse(F.col("rest")).alias("b"))
    return c.select("doc_id", text.section_status(F.col("a"), F.col("b")).alias("status"), F.md5(F.concat_ws(" ", F.nullif("a", F.lit("")), F.nullif("b", F.lit("")))).alias("combined_md5"))


@query("e5_clean_html_section", f"SELECT page_id, md5({_section('html')}) AS clean_md5, length({_section('html')})::BIGINT AS n FROM pages")
def e5(spark, sf) -> DataFrame:
    c = text.clean_section(F.col("html"))
    return t(spark, sf, "pages").select("page_id", c.alias("c")).select("page_id", F.md5("c").alias("clean_md5"), F.length("c").cast("long").alias("n"))


@query("e6_retrieval_text", f"""WITH {SECTIONS}, c AS (SELECT doc_id, {_section('first')} AS a, {_section('rest')} AS b FROM sec),
k AS (SELECT *, trim(regexp_replace(lower(a), '[^a-z0-9 ]', '', 'g')) = trim(regexp_replace(lower(b), '[^a-z0-9 ]', '', 'g')) AS same FROM c)
SELECT doc_id, md5(CASE WHEN a <> '' AND b <> '' AND NOT same THEN a || ' ' || b WHEN a <> '' THEN a ELSE b END) AS text_md5,
CASE WHEN a <> '' AND b <> '' AND same THEN 'both_identical' WHEN a <> '' AND b <> '' THEN 'findings+impression' WHEN a <> '' THEN 'findings_only' WHEN b <> '' THEN 'impression_only' ELSE 'none' END AS source FROM k""")
def e6(spark, sf) -> DataFrame:
    c = sections(spark, sf).select("doc_id", text.clean_section(F.col("first")).alias("a"), text.clean_section(F.col("rest")).alias("b"))
    return c.select("doc_id", text.retrieval_text(F.col("a"), F.col("b")).alias("r")).select("doc_id", F.md5("r.text").alias("text_md5"), "r.source")


@query("e7_norm_text_templates", f"SELECT md5(k) AS template_md5, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, {_KEY % 'text'} AS k FROM documents) GROUP BY k")
def e7(spark, sf) -> DataFrame:
    k = t(spark, sf, "documents").select("doc_id", F.md5(text.duplicate_key(F.col("text"))).alias("template_md5"))
    return k.groupBy("template_md5").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("e8_tokens", f"SELECT doc_id, len({_TOK % 'text'})::BIGINT AS n_tokens, md5(array_to_string({_TOK % 'text'}, ' ')) AS tokens_md5 FROM documents")
def e8(spark, sf) -> DataFrame:
    k = t(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.md5(F.array_join("k", " ")).alias("tokens_md5"))


@query("e9_sentences", f"SELECT doc_id, len({_SENT % 'text'})::BIGINT AS n_sentences, md5(array_to_string(list_transform({_SENT % 'text'}, lambda s: array_to_string(regexp_extract_all(lower(s), '[a-z0-9]+'), ' ')), '|')) AS norm_md5 FROM documents")
def e9(spark, sf) -> DataFrame:
    k = t(spark, sf, "documents").select("doc_id", text.norm_sentences(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").cast("long").alias("n_sentences"), F.md5(F.array_join("k", "|")).alias("norm_md5"))


@query("e10_ngram_counts", f"WITH k AS (SELECT item_id, {_TOK % 'text'} AS k FROM benchmark), g AS (SELECT item_id, unnest(list_transform(range(1, len(k) - 1), lambda i: array_to_string(k[i:i + 2], ' '))) AS gram FROM k) SELECT item_id, gram, count(*)::BIGINT AS n FROM g GROUP BY 1, 2")
def e10(spark, sf) -> DataFrame:
    k = t(spark, sf, "benchmark").select("item_id", F.explode(text.ngrams(text.tokens(F.col("text")), 3)).alias("gram"))
    return k.groupBy("item_id", "gram").agg(F.count(F.lit(1)).alias("n"))


_BODY = "array_to_string(list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' ')"
#: What a report is made to look like, by conversation: well formed, without headings, with text before and repeated after, echoing.
_SHAPES = ["FINDINGS:\n{t}\nIMPRESSION: {r}", "{t}", "note\n**FINDINGS:**\n{t}\nIMPRESSION: {r}\nFINDINGS: again\nmore", "FINDINGS:\n{t}\nIMPRESSION - {r}\nB. RETRIEVED EVIDENCE x"]


@query("e11_report_parser", f"""WITH c AS (SELECT conv_id * 1000 + turn AS row_id, conv_id % 4 AS kind, role, {_BODY} AS body FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)),
f AS (SELECT row_id, body AS findings, CASE WHEN kind = 1 THEN '' ELSE role END AS impression, list_filter([CASE WHEN kind = 3 THEN 'echoed_input_removed' END, CASE WHEN kind = 2 THEN 'repeated_section_ignored' END, CASE WHEN kind = 1 THEN 'no_headings_whole_text_as_findings' END, CASE WHEN kind = 2 THEN 'text_before_first_heading' END, CASE WHEN body = '' THEN 'empty_findings' END, CASE WHEN kind = 1 THEN 'empty_impression' END], lambda x: x IS NOT NULL) AS flags FROM c)
SELECT row_id, findings, impression, len(list_filter(flags, lambda x: x NOT IN ('echoed_input_removed', 'repeated_section_ignored'))) = 0 AS format_ok, array_to_string(flags, ';') AS flags FROM f""")
def e11(spark, sf) -> DataFrame:
    made = F.lit(None).cast("string")
    for k, shape in enumerate(_SHAPES):
        before, after = shape.split("{t}")
        ending = [F.lit(x) if i % 2 == 0 else F.col("role") for i, x in enumerate(after.replace("{r}", "\0{r}\0").split("\0"))]
        made = F.when(F.col("conv_id") % 4 == k, F.concat(F.lit(before), F.coalesce("text", F.lit("")), *ending)).otherwise(made)
    c = t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), made.alias("text"))
    return reports.parse_reports(c, "row_id")


@query("e12_json_fields", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def e12(spark, sf) -> DataFrame:
    return t(spark, sf, "events").select("event_id", text.json_field(F.col("props"), "k bigint")["k"].alias("k"))


_TERMS = "concat(p_type, '/', split_part(p_name, ' ', 1), '/', split_part(p_name, ' ', 2), '; ', p_brand, '/', p_size)"


def _terms(spark, sf) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", F.expr("concat(p_type, '/', split_part(p_name, ' ', 1), '/', split_part(p_name, ' ', 2), '; ', p_brand, '/', p_size)").alias("value"))


_PARSED = f"""tm AS (SELECT p_partkey, unnest(string_split({_TERMS}, ';')) AS part FROM part),
bits AS (SELECT p_partkey, list_transform(string_split(part, '/'), lambda b: trim(b)) AS b FROM tm),
pt AS (SELECT p_partkey, b[1] AS term, list_filter(list_transform(b[2:], lambda q: lower(q)), lambda q: q <> '') AS quals FROM bits WHERE b[1] <> '')"""


@query("e13_parse_terms", f"WITH {_PARSED} SELECT p_partkey, term, array_to_string(quals, '+') AS quals FROM pt")
def e13(spark, sf) -> DataFrame:
    k = _terms(spark, sf).select("p_partkey", F.explode(text.parse_terms(F.col("value"))).alias("x"))
    return k.select("p_partkey", "x.term", F.array_join("x.quals", "+").alias("quals"))


#: The mapping of the demonstration: term to class; term and qualifiers to class; terms too vague; the term for nothing found.
DIRECT, CONDITIONAL, VAGUE, NORMAL = {"PROMO": "promotion", "LARGE": "bulk"}, [("ECONOMY", ["small", "red", "tiny"], "budget"), ("MEDIUM", ["ring", "gear"], "machined")], ["STANDARD"], "small"
CLASSES = ["promotion", "bulk", "budget", "machined"]


def map_terms(terms: DataFrame, id_col: str) -> DataFrame:
    """id, findings (in class order), normal, uncertain_terms, unmapped_terms. terms: id, term, quals."""
    direct = F.create_map(*[F.lit(x) for kv in DIRECT.items() for x in kv])
    rule = F.lit(None).cast("string")
    for term, quals, cls in CONDITIONAL:
        rule = F.when((F.col("term") == term) & F.arrays_overlap("quals", F.array(*map(F.lit, quals))), cls).otherwise(rule)
    normal = F.lower("term") == NORMAL
    cls = F.when(~normal, F.coalesce(direct[F.col("term")], rule))
    vague = ~normal & cls.isNull() & F.col("term").isin(VAGUE)
    rest = ~normal & cls.isNull() & ~F.col("term").isin(VAGUE)
    order = F.array(*map(F.lit, CLASSES))
    g = terms.groupBy(id_col).agg(F.collect_set(cls).alias("c"), F.bool_or(normal).alias("normal"), F.collect_set(F.when(vague, F.col("term"))).alias("u"), F.collect_set(F.when(rest, F.col("term"))).alias("n"))
    return g.select(id_col, F.filter(order, lambda x: F.array_contains("c", x)).alias("findings"), "normal", F.array_sort("u").alias("uncertain_terms"), F.array_sort("n").alias("unmapped_terms"))


_MAPPED = f"""{_PARSED}, mp AS (SELECT p_partkey, term, lower(term) = 'small' AS normal,
  CASE WHEN lower(term) = 'small' THEN NULL WHEN term = 'PROMO' THEN 'promotion' WHEN term = 'LARGE' THEN 'bulk'
    WHEN term = 'ECONOMY' AND list_has_any(quals, ['small', 'red', 'tiny']) THEN 'budget' WHEN term = 'MEDIUM' AND list_has_any(quals, ['ring', 'gear']) THEN 'machined' END AS cls FROM pt),
g AS (SELECT p_partkey, bool_or(normal) AS normal, list(DISTINCT cls) FILTER (cls IS NOT NULL) AS c,
  list_sort(list(DISTINCT term) FILTER (NOT normal AND cls IS NULL AND term = 'STANDARD')) AS u, list_sort(list(DISTINCT term) FILTER (NOT normal AND cls IS NULL AND term <> 'STANDARD')) AS n FROM mp GROUP BY 1),
ev AS (SELECT p_partkey, normal, list_filter(['promotion', 'bulk', 'budget', 'machined'], lambda x: list_contains(coalesce(c, []), x)) AS f, coalesce(u, []) AS u, coalesce(n, []) AS n FROM g)"""


def _mapped(spark, sf) -> DataFrame:
    k = _terms(spark, sf).select("p_partkey", F.explode(text.parse_terms(F.col("value"))).alias("x")).select("p_partkey", "x.term", "x.quals")
    return map_terms(k, "p_partkey")


@query("e14_map_terms", f"WITH {_MAPPED} SELECT p_partkey, array_to_string(f, ';') AS findings, normal, array_to_string(u, ';') AS uncertain_terms, array_to_string(n, ';') AS unmapped_terms FROM ev")
def e14(spark, sf) -> DataFrame:
    j = lambda c: F.array_join(c, ";").alias(c)
    return _mapped(spark, sf).select("p_partkey", j("findings"), "normal", j("uncertain_terms"), j("unmapped_terms"))


@query("e15_evaluation_set", f"WITH {_MAPPED} SELECT p_partkey, CASE WHEN len(f) > 0 THEN array_to_string(f, ';') WHEN normal THEN 'nothing' END AS eval_set FROM ev")
def e15(spark, sf) -> DataFrame:
    return _mapped(spark, sf).select("p_partkey", F.when(F.size("findings") > 0, F.array_join("findings", ";")).when(F.col("normal"), "nothing").alias("eval_set"))


#: Common short words of the test texts as concepts, so that the query has mentions to judge.
COMMON = {"article": ["the", "la", "der"], "verb": ["is", "are", "est", "ist"], "linking": ["and", "et", "und", "y"]}


def _any_sql(patterns: list[str]) -> str:
    return (r"(?i)\b(?:" + "|".join(f"(?:{p})" for p in patterns) + r")\b").replace("'", "''")


def _mentions_sql(lexicon: dict[str, list[str]]) -> str:
    """mn: item_id, concept, match, status, sentence. Matching is done on a copy whose letters outside ASCII are q, since word borders of
    this engine know ASCII only; texts are cut from the original at the places found."""
    rule = {k: _any_sql(v) for k, v in assertion.TRIGGERS.items()}
    concepts = ", ".join(f"('{c}', '{_any_sql(p)}')" for c, p in lexicon.items())
    words = lambda x: f"regexp_extract_all(lower({x}), '{assertion.WORD}')"
    return f"""ss AS (SELECT item_id, unnest(regexp_split_to_array(regexp_replace(replace(coalesce(text, ''), 'XXXX', 'xxxx'), '([.;!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+')) AS sentence FROM benchmark),
sh AS (SELECT *, regexp_replace(sentence, '[^\\x00-\\x7F]', 'q', 'g') AS plain FROM ss), hh AS (SELECT item_id, sentence, plain, concept, regexp_split_to_array(plain, pat) AS parts, regexp_extract_all(plain, pat) AS hits FROM sh, (VALUES {concepts}) c(concept, pat)),
kk AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM hh), st AS (SELECT item_id, sentence, plain, concept, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0))::BIGINT AS a, length(hits[k]) AS n FROM kk),
lr AS (SELECT *, length(regexp_split_to_array(substr(plain, 1, a), '{rule['scope_terminators']}')[-1]) AS l, length(regexp_split_to_array(substr(plain, a + n + 1), '{rule['scope_terminators']}')[1]) AS r FROM st),
ba AS (SELECT *, regexp_replace(array_to_string({words('substr(sentence, a - l + 1, l)')}[-12:], ' '), '{rule['pseudo_negation']}', ' ', 'g') AS before, array_to_string({words('substr(sentence, a + n + 1, r)')}[1:6], ' ') AS after FROM lr),
mn AS (SELECT item_id, concept, substr(sentence, a + 1, n) AS match, CASE WHEN regexp_matches(before, '{rule['negation_pre']}') OR regexp_matches(after, '^{rule['negation_post']}') OR regexp_matches(substr(after, 1, 60), '{rule['negation_post']}') THEN 'negated' WHEN regexp_matches(before, '{rule['uncertainty_pre']}') OR regexp_matches(after, '{rule['uncertainty_post']}') THEN 'uncertain' ELSE 'positive' END AS status, sentence FROM ba)"""


def _status_sql(lexicon: dict[str, list[str]]) -> str:
    """cs: item_id, concept, status for each passage and concept."""
    names = ", ".join(f"('{c}')" for c in lexicon)
    return f"{_mentions_sql(lexicon)}, cs AS (SELECT item_id, concept, coalesce(arg_max(status, CASE status WHEN 'positive' THEN 3 WHEN 'uncertain' THEN 2 ELSE 1 END), 'not_mentioned') AS status FROM benchmark CROSS JOIN (VALUES {names}) c(concept) LEFT JOIN mn USING (item_id, concept) GROUP BY 1, 2)"


@query("e16_assertion_mentions", f"WITH {_mentions_sql(COMMON)} SELECT * FROM mn")
def e16(spark, sf) -> DataFrame:
    return assertion.mentions(t(spark, sf, "benchmark"), COMMON, "item_id")


@query("e17_concept_status", f"WITH {_status_sql(COMMON)} SELECT * FROM cs")
def e17(spark, sf) -> DataFrame:
    b = t(spark, sf, "benchmark")
    return assertion.status(b, assertion.mentions(b, COMMON, "item_id"), list(COMMON), "item_id")


_LEXICON = assertion.overlay(COMMON, remove={"verb": ["est"]}, add={"verb": ["was"]})


@query("e18_report_state", f"WITH {_status_sql(_LEXICON)}, ag AS (SELECT item_id, list_sort(coalesce(list(concept) FILTER (status IN ('positive', 'uncertain')), [])) AS stated, list_sort(coalesce(list(concept) FILTER (status = 'positive'), [])) AS definite FROM cs GROUP BY 1) SELECT item_id, stated, definite, CASE WHEN len(stated) > 0 THEN 'abnormal' WHEN regexp_matches(regexp_replace(text, '[^\\x00-\\x7F]', 'q', 'g'), '{_any_sql(assertion.NORMAL)}') THEN 'normal' ELSE 'indeterminate' END AS state FROM ag JOIN benchmark USING (item_id)")
def e18(spark, sf) -> DataFrame:
    b = t(spark, sf, "benchmark")
    s = assertion.status(b, assertion.mentions(b, _LEXICON, "item_id"), list(_LEXICON), "item_id")
    sets = s.groupBy("item_id").agg(F.array_sort(F.collect_set(F.when(F.col("status").isin("positive", "uncertain"), F.col("concept")))).alias("stated"), F.array_sort(F.collect_set(F.when(F.col("status") == "positive", F.col("concept")))).alias("definite"))
    state = F.when(F.size("stated") > 0, "abnormal").when(F.col("text").rlike(assertion.any_of(assertion.NORMAL)), "normal").otherwise("indeterminate")
    return sets.join(b, "item_id").select("item_id", "stated", "definite", state.alias("state"))


@query("e18b_unmappable_sentences", f"WITH ss AS (SELECT item_id, regexp_split_to_array(regexp_replace(replace(coalesce(text, ''), 'XXXX', 'xxxx'), '([.;!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+') AS s FROM benchmark), u AS (SELECT item_id, unnest(range(0, len(s)))::INT AS position, regexp_replace(unnest(s), '^\\s+|\\s+$', '', 'g') AS sentence FROM ss) SELECT * FROM u WHERE sentence <> '' AND NOT regexp_matches(regexp_replace(sentence, '[^\\x00-\\x7F]', 'q', 'g'), '{_any_sql([*(p for ps in COMMON.values() for p in ps), *assertion.NORMAL])}')")
def e18b(spark, sf) -> DataFrame:
    return assertion.unmappable(t(spark, sf, "benchmark"), COMMON, id_col="item_id")


@query("e19_phrases", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT lower(regexp_replace(o_orderpriority, '[_ ]+', ' ', 'g')))), ', ') AS phrase FROM orders GROUP BY 1")
def e19(spark, sf) -> DataFrame:
    g = t(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    return g.select("o_custkey", text.phrase(F.col("p")).alias("phrase"))


@query("e20_evidence_table", "SELECT o_orderstatus, string_agg('| ' || o_orderpriority || ' | ' || n || ' |', chr(10) ORDER BY o_orderpriority) AS md FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def e20(spark, sf) -> DataFrame:
    g = t(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").count()
    line = F.struct("o_orderpriority", F.format_string("| %s | %d |", "o_orderpriority", "count").alias("line"))
    return g.groupBy("o_orderstatus").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("md"))


__all__ = ["r6"]
