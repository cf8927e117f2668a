"""Registered queries of the library's own operators, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import legal, text
from clauseloom.operators import claims, curation, evaluation, extraction, linking, rewrites, score_store, scoring, spans, status, verification
from clauseloom.plans import fixtures as fx
from clauseloom.plans import sql as q
from clauseloom.plans.fixtures import derive
from clauseloom.plans.shared import fresh_path, written
from clauseloom.sources import run_log, tables
from clauseloom.streaming import meet
from clauseloom.streaming import verify as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.explode_spans(derive(spark, sf_dir, fx.PROVISIONS).withColumn("spans", spans.make_spans("text")))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.evidence_units(_spans(spark, sf_dir))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link_claims(derive(spark, sf_dir, fx.SPARK_CLAIM_ROWS), _units(spark, sf_dir), derive(spark, sf_dir, fx.PROVISIONS))


def flat(*cols: str) -> list:
    """Arrays as text, so that both engines' values compare alike."""
    return [F.concat_ws(",", x).alias(x) for x in cols]


# -- spans, units, links ------------------------------------------------------

UNITS_SQL = f"""
s AS ({fx.SPANS}),
h AS (SELECT *, regexp_matches(text, '^(((or|and)\\s*,?\\s*)?if\\b|\\([a-z]\\))', 'i') AS bare FROM s),
u AS (SELECT a.provision_id, a.span_idx AS unit_idx, a.span_id AS selected_id, a.text AS own_text,
  CASE WHEN a.bare AND b.text IS NOT NULL THEN concat(b.span_id, ',', a.span_id) ELSE a.span_id END AS ids,
  CASE WHEN a.bare AND b.text IS NOT NULL THEN concat(b.text, ' ', a.text) ELSE a.text END AS premise
  FROM h a LEFT JOIN h b ON a.bare AND b.provision_id = a.provision_id AND NOT b.bare AND b.span_idx =
    (SELECT max(x.span_idx) FROM h x WHERE x.provision_id = a.provision_id AND NOT x.bare AND x.span_idx < a.span_idx)),
"""
SCORES_SQL = f"""
cl AS (SELECT provision_id, claim_id, claim_text, {q.lex("claim_text")} AS lex, {q.numbers("claim_text")} AS num FROM ({fx.CLAIM_ROWS}) c),
ut AS (SELECT *, {q.lex("own_text")} AS lex, {q.numbers("own_text")} AS num FROM u),
sc AS (SELECT cl.provision_id, cl.claim_id, ut.unit_idx,
  len(list_intersect(cl.lex, ut.lex)) + 4 * len(list_intersect(cl.num, ut.num)) + CASE WHEN list_contains(list_intersect(cl.lex, ut.lex), 'not') THEN 3 ELSE 0 END AS score,
  len(list_intersect(cl.num, ut.num)) = len(cl.num) AS complete, len(list_intersect(cl.num, ut.num)) AS n_numbers, contains(ut.ids, ',') AS joined
  FROM cl JOIN ut USING (provision_id))
"""
LINK_SQL = f"""WITH {UNITS_SQL} {SCORES_SQL},
rk AS (SELECT *, rank() OVER w AS r FROM sc WHERE score > 0 WINDOW w AS (PARTITION BY provision_id, claim_id ORDER BY score DESC, complete DESC, n_numbers DESC, joined DESC)),
top AS (SELECT provision_id, claim_id, max(unit_idx) AS unit_idx, max(score) AS score, count(*) > 1 AS tie FROM rk WHERE r = 1 GROUP BY 1, 2),
linked AS (SELECT cl.provision_id, cl.claim_id, cl.claim_text, p.text AS source,
  CASE WHEN NOT tie THEN u.selected_id END AS evidence_span_id, CASE WHEN NOT tie THEN u.ids ELSE '' END AS evidence_span_ids,
  CASE WHEN NOT tie THEN u.premise ELSE p.text END AS evidence_text, CASE WHEN NOT tie THEN top.score ELSE 0 END AS evidence_score,
  CASE WHEN NOT tie THEN 'lexical_overlap' WHEN tie THEN 'full_provision_ambiguity_fallback' ELSE 'full_provision' END AS evidence_method,
  coalesce(tie, false) AS evidence_ambiguity
  FROM cl JOIN ({fx.PROVISIONS}) p USING (provision_id) LEFT JOIN top USING (provision_id, claim_id)
  LEFT JOIN u ON u.provision_id = cl.provision_id AND u.unit_idx = top.unit_idx)
"""
LINK_COLS = "provision_id, claim_id, claim_text, evidence_span_id, coalesce(evidence_span_ids, '') AS evidence_span_ids, evidence_text, evidence_score, evidence_method, evidence_ambiguity"


@query("make_spans", fx.SPANS)
def make_spans(spark, d):
    return _spans(spark, d)


@query("spans_with_fallback", f"SELECT provision_id, count(*) AS n_spans, 'success' AS span_status, NULL::VARCHAR AS span_method FROM ({fx.SPANS}) s GROUP BY 1")
def spans_with_fallback(spark, d):
    df = spans.spans_with_fallback(derive(spark, d, fx.PROVISIONS))
    return df.select("provision_id", F.size("spans").cast("long").alias("n_spans"), "span_status", "span_method")


# Spans of another extractor: usable, none, one that ends behind the text, or any for a text without words.
GIVEN_SQL = f"SELECT provision_id, CASE WHEN n % 13 = 0 THEN '  ' ELSE text END AS text, n % 7 AS kind FROM (SELECT *, CAST(substr(provision_id, 2) AS BIGINT) AS n FROM ({fx.PROVISIONS}) p) q"
BY_SENTENCES = r"""len(list_filter(string_split(regexp_replace(text, '\.(\s+[A-Z"(])', '.' || chr(1) || '\1', 'g'), chr(1)), lambda t: trim(t) <> ''))"""


@query(
    "given_spans_with_fallback",
    f"""WITH g AS (SELECT *, trim(text) = '' AS blank FROM ({GIVEN_SQL}) g)
SELECT provision_id, CASE WHEN blank OR kind > 1 THEN 1 ELSE {BY_SENTENCES} END AS n_spans, CASE WHEN blank THEN 'failed' WHEN kind < 2 THEN 'fallback' ELSE 'success' END AS span_status,
  CASE WHEN NOT blank AND kind < 2 THEN 'sentence_splitter' END AS span_method, CASE WHEN blank THEN 'empty_text' END AS span_reason FROM g""",
)
def given_spans_with_fallback(spark, d):
    g = derive(spark, d, GIVEN_SQL)
    end = F.length("text") + F.when(c("kind") == 1, 1).otherwise(0)
    one = F.struct(F.lit(1).alias("span_idx"), F.lit("P1").alias("span_id"), c("text"), F.lit(0).alias("start"), end.alias("end"))
    given = g.withColumn("given", F.when(c("kind") != 0, F.array(one)).cast(spans.SPANS))
    return spans.spans_with_fallback(given, given="given").select("provision_id", F.size("spans").cast("long").alias("n_spans"), "span_status", "span_method", "span_reason")


@query(
    "sentence_spans",
    r"""
WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\.(\s+[A-Z"(])', '.' || chr(1) || '\1', 'g'), chr(1))) AS t,
  generate_subscripts(string_split(regexp_replace(text, '\.(\s+[A-Z"(])', '.' || chr(1) || '\1', 'g'), chr(1)), 1) AS i FROM documents),
o AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS span_idx, """
    + q.strip("t")
    + r""" AS text, e - length(regexp_replace(t, '^\s+', '')) AS start, e AS "end"
FROM o WHERE """
    + q.strip("t")
    + " <> ''",
)
def sentence_spans(spark, d):
    return documents(spark, d).select("doc_id", F.inline(spans.sentence_spans(c("text")))).drop("span_id")


@query(
    "validate_spans",
    f"""WITH s AS (SELECT * FROM ({fx.SPANS}) x), n AS (SELECT provision_id, CAST(substr(provision_id, 2) AS BIGINT) AS n FROM ({fx.PROVISIONS}) p)
SELECT provision_id, CASE WHEN n % 30 = 0 THEN 'no_spans' WHEN n % 31 = 0 AND n % 6 <> 5 THEN 'duplicate_id' WHEN n % 37 = 0 THEN 'end_out_of_bounds' WHEN n % 41 = 0 THEN 'invalid_offsets'
  WHEN n % 43 = 0 THEN 'empty_text' END AS reason FROM n""",
)
def validate_spans(spark, d):
    n = F.substring("provision_id", 2, 20).cast("long")
    s = _spans(spark, d).where(n % 30 != 0)
    s = s.withColumn("span_id", F.when((n % 31 == 0), "P1").otherwise(c("span_id")))
    s = s.withColumn("end", F.when((n % 37 == 0) & ((n % 31 != 0) | (n % 6 == 5)), c("end") + 10_000).when((n % 41 == 0) & (n % 37 != 0), c("start")).otherwise(c("end")))
    s = s.withColumn("text", F.when((n % 43 == 0) & (n % 41 != 0) & (n % 37 != 0), " ").otherwise(c("text")))
    # a fault of an earlier kind on the first span decides; repeated ids show on the second
    s = s.withColumn("end", F.when((n % 31 == 0) & (n % 6 != 5), F.abs(F.length("text")) + c("start")).otherwise(c("end")))
    s = s.withColumn("text", F.when((n % 31 == 0) & (n % 6 != 5), F.lit("t")).otherwise(c("text"))).withColumn("end", F.when((n % 31 == 0) & (n % 6 != 5), c("start") + 1).otherwise(c("end")))
    return spans.validate_spans(s, derive(spark, d, fx.PROVISIONS))


@query("is_headless", f"SELECT provision_id, span_id, regexp_matches(text, '^(((or|and)\\s*,?\\s*)?if\\b|\\([a-z]\\))', 'i') AS headless FROM ({fx.SPANS}) s")
def is_headless(spark, d):
    return _spans(spark, d).select("provision_id", "span_id", text.is_headless(c("text")).alias("headless"))


@query("evidence_units", f"WITH {UNITS_SQL} e AS (SELECT 1) SELECT provision_id, unit_idx, selected_id, ids, premise, own_text FROM u")
def evidence_units(spark, d):
    return _units(spark, d).select("provision_id", "unit_idx", "selected_id", *flat("ids"), "premise", "own_text")


@query("score_units", f"WITH {UNITS_SQL} {SCORES_SQL} SELECT * FROM sc")
def score_units(spark, d):
    return linking.score_units(derive(spark, d, fx.SPARK_CLAIM_ROWS), _units(spark, d))


@query("link_claims", f"{LINK_SQL} SELECT {LINK_COLS} FROM linked")
def link_claims(spark, d):
    df = _linked(spark, d)
    return df.select(*[x for x in df.columns if x != "evidence_span_ids"], *flat("evidence_span_ids"))


@query(
    "verification_warnings",
    f"""{LINK_SQL} SELECT provision_id, claim_id, array_to_string({q.drop_nulls(
        f"CASE WHEN len({q.numbers('evidence_text')}) > 0 AND len({q.numbers('claim_text')}) > 0 AND {q.numbers('evidence_text')} <> {q.numbers('claim_text')} THEN 'numerical_conflict' END",
        f"CASE WHEN {q.conflict('evidence_text', 'claim_text')} THEN 'clear_modal_conflict' END")}, ',') AS verification_warnings FROM linked""",
)
def verification_warnings(spark, d):
    w = linking.verification_warnings(c("evidence_text"), c("claim_text"), F.lit("supported"))
    return _linked(spark, d).select("provision_id", "claim_id", F.concat_ws(",", w).alias("verification_warnings"))


@query(
    "evidence_recall",
    f"""{LINK_SQL}, e AS (SELECT *, CASE WHEN CAST(substr(provision_id, 2) AS BIGINT) % 6 = 2 AND claim_id = 'C2' THEN 'P1,P3' ELSE 'P1' END AS x FROM linked)
SELECT count(*) AS n_claims, count(*) FILTER (WHERE coalesce(evidence_span_ids, '') = x) AS n_matched, avg(CASE WHEN coalesce(evidence_span_ids, '') = x THEN 1.0 ELSE 0.0 END) AS recall FROM e""",
)
def evidence_recall(spark, d):
    linked = _linked(spark, d)
    list_item = (F.substring("provision_id", 2, 20).cast("long") % 6 == 2) & (c("claim_id") == "C2")
    expected = derive(spark, d, fx.SPARK_CLAIM_ROWS).select("provision_id", "claim_id", F.when(list_item, F.array(F.lit("P1"), F.lit("P3"))).otherwise(F.array(F.lit("P1"))).alias("expected_ids"))
    return linking.evidence_recall(linked, expected)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Which claims have unambiguous evidence: claims by method, with how many carry warnings."""
    w = linking.verification_warnings(c("evidence_text"), c("claim_text"), F.lit("supported"))
    return (
        _linked(spark, d).withColumn("warned", F.size(w) > 0).groupBy("evidence_method", "evidence_ambiguity")
        .agg(F.count(F.lit(1)).alias("n_claims"), F.count_if("warned").alias("n_warned"))
    )


@query(
    "claims_by_evidence",
    f"""{LINK_SQL}, w AS (SELECT *, ((len({q.numbers('evidence_text')}) > 0 AND len({q.numbers('claim_text')}) > 0 AND {q.numbers('evidence_text')} <> {q.numbers('claim_text')})
  OR {q.conflict('evidence_text', 'claim_text')}) AS warned FROM linked)
SELECT evidence_method, evidence_ambiguity, count(*) AS n_claims, count(*) FILTER (WHERE warned) AS n_warned FROM w GROUP BY 1, 2""",
)
def claims_by_evidence(spark, d):
    return flagship(spark, d)


# -- scalar functions ---------------------------------------------------------


@query("extract_numbers", f"SELECT provision_id, array_to_string({q.numbers('text')}, ',') AS numbers FROM ({fx.PROVISIONS}) p")
def extract_numbers(spark, d):
    return derive(spark, d, fx.PROVISIONS).select("provision_id", F.concat_ws(",", legal.extract_numbers(c("text"))).alias("numbers"))


@query(
    "canonical_number",
    """SELECT l_orderkey, l_linenumber, regexp_replace(regexp_replace(CASE WHEN regexp_replace(s, '^0+', '') = '' THEN '0' WHEN regexp_replace(s, '^0+', '')[1] = '.' THEN concat('0', regexp_replace(s, '^0+', ''))
  ELSE regexp_replace(s, '^0+', '') END, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS number
FROM (SELECT l_orderkey, l_linenumber, concat('00', CAST(l_partkey % 1000 AS VARCHAR), '.', lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0')) AS s FROM lineitem)""",
)
def canonical_number(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    s = F.concat(F.lit("00"), (c("l_partkey") % 1000).cast("string"), F.lit("."), F.lpad((c("l_suppkey") % 100).cast("string"), 2, "0"))
    return li.select("l_orderkey", "l_linenumber", legal.canonical_number(s).alias("number"))


@query("modality_tags", f"SELECT provision_id, array_to_string({q.tags('text')}, ',') AS tags FROM ({fx.PROVISIONS}) p")
def modality_tags(spark, d):
    return derive(spark, d, fx.PROVISIONS).select("provision_id", F.concat_ws(",", legal.modality_tags(c("text"))).alias("tags"))


@query("tokenize_parts", f"SELECT provision_id, array_to_string({q.lex('text')}, ',') AS lexical, array_to_string({q.numbers('text')}, ',') AS numbers FROM ({fx.PROVISIONS}) p")
def tokenize_parts(spark, d):
    p = derive(spark, d, fx.PROVISIONS)
    return p.select("provision_id", F.concat_ws(",", legal.lexical_tokens(c("text"))).alias("lexical"), F.concat_ws(",", legal.number_tokens(c("text"))).alias("numbers"))


@query("tokenize", f"SELECT provision_id, array_to_string(list_sort(list_distinct(list_concat({q.lex('text')}, {q.numbers('text')}))), ',') AS tokens FROM ({fx.PROVISIONS}) p")
def tokenize(spark, d):
    return derive(spark, d, fx.PROVISIONS).select("provision_id", F.concat_ws(",", legal.tokenize(c("text"))).alias("tokens"))


CLAIM_TEXT_SQL = f"({fx.CLAIM_ROWS}) c JOIN ({fx.PROVISIONS}) p USING (provision_id)"


def _claim_text(spark, d):
    return derive(spark, d, fx.SPARK_CLAIM_ROWS).join(derive(spark, d, fx.PROVISIONS), "provision_id")


@query("lexical_overlap", f"SELECT provision_id, claim_id, array_to_string(list_sort(list_intersect({q.lex('claim_text')}, {q.lex('text')})), ',') AS overlap FROM {CLAIM_TEXT_SQL}")
def lexical_overlap(spark, d):
    return _claim_text(spark, d).select("provision_id", "claim_id", F.concat_ws(",", legal.lexical_overlap(c("claim_text"), c("text"))).alias("overlap"))


@query("modal_conflict", f"SELECT provision_id, claim_id, {q.conflict('claim_text', 'text')} AS conflict FROM {CLAIM_TEXT_SQL}")
def modal_conflict(spark, d):
    return _claim_text(spark, d).select("provision_id", "claim_id", legal.modal_conflict(c("claim_text"), c("text")).alias("conflict"))


@query(
    "legal_flags",
    f"""SELECT provision_id, CAST(regexp_matches(text, '\\b(shall|may|must)\\b', 'i') AS INT) AS has_modal,
  CAST(regexp_matches(text, '\\b(if|unless|provided that|provided further that|except|notwithstanding)\\b', 'i') AS INT) AS has_exception,
  CAST(regexp_matches(text, '\\b\\d+\\b') AS INT) AS has_numbers, CAST(regexp_matches(lower(text), '{"|".join(legal.ROLES)}') AS INT) AS has_roles,
  CAST(regexp_matches(lower(text), '\\b({"|".join(legal.CROSS_REFERENCES)})\\b') AS INT) AS needs_context,
  CAST(length({q.strip("text")}) < 35 OR (regexp_matches({q.strip("text")}, '[:;]$') AND length({q.strip("text")}) < 120) AS INT) AS bad_fragment
FROM ({fx.PROVISIONS}) p""",
)
def legal_flags(spark, d):
    return derive(spark, d, fx.PROVISIONS).select("provision_id", *legal.legal_flags(c("text")).values())


@query("pair_norm", f"SELECT nli_id, split, {q.pair_key('premise', 'hypothesis')} AS key FROM ({fx.PAIRS}) p")
def pair_norm(spark, d):
    return derive(spark, d, fx.PAIRS).select("nli_id", "split", text.pair_key(c("premise"), c("hypothesis")).alias("key"))


@query(
    "paragraph_split",
    r"""SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: """ + q.strip("x") + r"""), lambda x: x <> '')) AS paragraph FROM documents""",
)
def paragraph_split(spark, d):
    return documents(spark, d).select("doc_id", F.explode(text.paragraph_split(c("text"))).alias("paragraph"))


@query("strip_preamble", f"SELECT example_id, model, {q.strip(q.preamble_cut('output'))} AS output FROM ({fx.REWRITES}) r")
def strip_preamble(spark, d):
    return derive(spark, d, fx.REWRITES).select("example_id", "model", text.strip_preamble(c("output")).alias("output"))


LINE_SQL = q.strip(r"""regexp_replace(replace(replace(replace(replace(text, chr(65534), ''), chr(8216), chr(39)), chr(8220), chr(34)), chr(8221), chr(34)), '\s+', ' ', 'g')""")


@query("normalize_line", f"SELECT doc_id, {LINE_SQL} AS line FROM documents")
def normalize_line(spark, d):
    return documents(spark, d).select("doc_id", text.normalize_line(c("text")).alias("line"))


@query("clean_unit_text", rf"SELECT doc_id, page, line_no, regexp_replace(regexp_replace({q.strip(q.norm('text').replace('lower', ''))}, '\s+([;,.:)])', '\1', 'g'), '([(\[])\s+', '\1', 'g') AS text FROM ({fx.LINES}) l")
def clean_unit_text(spark, d):
    return derive(spark, d, fx.LINES).select("doc_id", "page", "line_no", text.clean_unit_text(c("text")).alias("text"))


# -- claims -------------------------------------------------------------------

RAW = f"""
SELECT provision_id, simplified_text, CASE CAST(substr(provision_id, 2) AS BIGINT) % 5
  WHEN 0 THEN concat(chr(96), chr(96), chr(96), 'json [{{"claim_id": "C9", "claim_text": " ', simplified_text, ' "}}, {{"claim_id": "C8", "claim_text": "b"}}, {{"claim_id": "C7", "claim_text": "b"}}]', chr(96), chr(96), chr(96))
  WHEN 1 THEN '[{{"claim_id": "C1", "claim_text": 42}}]' WHEN 2 THEN '[{{"claim_id": "C1", "claim_text": "ok"}}, {{"claim_id": 2, "claim_text": "no"}}]'
  WHEN 3 THEN 'no json' ELSE '[]' END AS raw FROM ({fx.SIMPLIFIED}) s
""".replace("{{", "{").replace("}}", "}")
GOOD = "CAST(substr(provision_id, 2) AS BIGINT) % 5 = 0"


@query(
    "parse_claims_json",
    f"SELECT provision_id, 'C1' AS claim_id, simplified_text AS claim_text FROM ({RAW}) r WHERE {GOOD} UNION ALL SELECT provision_id, unnest(['C2', 'C3']), 'b' FROM ({RAW}) r WHERE {GOOD}",
)
def parse_claims_json(spark, d):
    return claims.explode_claims(derive(spark, d, RAW).select("provision_id", claims.parse_claims(c("raw")).alias("claims")))


@query(
    "dedup_claims",
    f"SELECT provision_id, 'C1' AS claim_id, simplified_text AS claim_text FROM ({RAW}) r WHERE {GOOD} UNION ALL SELECT provision_id, 'C2', 'b' FROM ({RAW}) r WHERE {GOOD}",
)
def dedup_claims(spark, d):
    return claims.explode_claims(derive(spark, d, RAW).select("provision_id", claims.dedup_claims(claims.parse_claims(c("raw"))).alias("claims")))


CLAUSES = r"list_filter(list_transform(string_split_regex(text, '(?i);\s*|,\s+(?:and|but|however|whereas)\s+'), lambda x: " + q.strip("x") + "), lambda x: x <> '')"


@query("clause_split", f"SELECT provision_id, unnest({CLAUSES}) AS clause FROM ({fx.PROVISIONS}) p")
def clause_split(spark, d):
    return derive(spark, d, fx.PROVISIONS).select("provision_id", F.explode(text.clause_split(c("text"))).alias("clause"))


SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: " + q.strip("x") + "), lambda x: x <> '')"


@query("sentence_split", f"SELECT doc_id, unnest({SENTENCES.format(t='text')}) AS sentence FROM documents")
def sentence_split(spark, d):
    return documents(spark, d).select("doc_id", F.explode(text.sentence_split(c("text"))).alias("sentence"))


@query(
    "claims_with_fallback",
    f"""WITH r AS ({RAW.replace("SELECT provision_id, simplified_text,", "SELECT provision_id, simplified_text, simplified_text AS text,")}),
t AS (SELECT *, {GOOD} AS llm, {CLAUSES} AS cl, {SENTENCES.format(t="simplified_text")} AS se FROM r)
SELECT provision_id, CASE WHEN llm THEN 'success' ELSE 'fallback' END AS claim_status,
  CASE WHEN llm THEN 'llm' WHEN len(cl) > 1 THEN 'clause_splitter' WHEN len(se) > 1 THEN 'sentence_splitter' ELSE 'whole_text_claim' END AS claim_method,
  CASE WHEN llm THEN 2 WHEN len(cl) > 1 THEN len(cl) WHEN len(se) > 1 THEN len(se) ELSE 1 END AS n_claims FROM t""",
)
def claims_with_fallback(spark, d):
    df = claims.claims_with_fallback(derive(spark, d, RAW), "raw", "simplified_text")
    return df.select("provision_id", "claim_status", "claim_method", F.size("claims").cast("long").alias("n_claims"))


@query(
    "extraction_warnings",
    f"""SELECT provision_id, claim_id, array_to_string({q.drop_nulls(
        f"CASE WHEN len(list_filter({q.numbers('claim_text')}, lambda x: NOT list_contains({q.numbers('text')}, x))) > 0 THEN 'unsupported_number' END",
        f"CASE WHEN len(list_intersect({q.lex('claim_text')}, {q.lex('text')})) = 0 THEN 'zero_lexical_overlap' END",
        f"CASE WHEN {q.conflict('claim_text', 'text')} THEN 'clear_modal_conflict' END")}, ',') AS warnings FROM {CLAIM_TEXT_SQL}""",
)
def extraction_warnings(spark, d):
    return _claim_text(spark, d).select("provision_id", "claim_id", F.concat_ws(",", claims.extraction_warnings(c("claim_text"), c("text"))).alias("warnings"))


# -- validation and curation --------------------------------------------------

DOC_TEXT = "CASE WHEN doc_id % 50 = 7 THEN '  ' WHEN doc_id % 50 = 8 THEN NULL ELSE text END"


@query(
    "validate_provisions",
    f"""WITH p AS (SELECT doc_id, nfc_normalize({DOC_TEXT}) AS text FROM documents)
SELECT doc_id, length(text) AS n, CASE WHEN text IS NULL OR {q.strip("text")} = '' THEN 'blank' WHEN length(text) > 3000 THEN 'too_long' END AS reason FROM p""",
)
def validate_provisions(spark, d):
    p = documents(spark, d).select("doc_id", F.expr(DOC_TEXT).alias("text"))
    ok, bad = curation.validate_provisions(p, 3000)
    return ok.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).select("doc_id", F.length("text").cast("long").alias("n"), "reason")


@query("blank_rows", f"SELECT doc_id FROM documents WHERE {DOC_TEXT} IS NULL OR {q.strip(DOC_TEXT)} = ''")
def blank_rows(spark, d):
    return documents(spark, d).where(text.is_blank(F.expr(DOC_TEXT))).select("doc_id")


@query("normalize_gold_label", f"SELECT nli_id, split, {q.label_id('gold_label')} AS gold_label_id FROM ({fx.PAIRS}) p")
def normalize_gold_label(spark, d):
    return derive(spark, d, fx.PAIRS).select("nli_id", "split", curation.gold_label_id(c("gold_label")).alias("gold_label_id"))


VALID_SQL = f"""SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE {q.strip("premise")} = '') AS blank_premise, count(*) FILTER (WHERE {q.strip("hypothesis")} = '') AS blank_hypothesis,
  count(*) FILTER (WHERE ({q.label_id("gold_label")}) IS NULL) AS bad_labels, count(*) - count(DISTINCT nli_id) AS duplicate_ids,
  {", ".join(f"count(*) FILTER (WHERE ({q.label_id('gold_label')}) = {i}) AS n_{k}" for i, k in enumerate(scoring.LABELS))} FROM ({fx.PAIRS}) p GROUP BY 1"""


@query("validate_nli", f"SELECT *, blank_premise + blank_hypothesis + bad_labels = 0 AS usable FROM ({VALID_SQL}) v")
def validate_nli(spark, d):
    return curation.validate_nli(derive(spark, d, fx.PAIRS), "split")


@query(
    "offending_rows",
    f"""SELECT * FROM (SELECT nli_id, split, array_to_string({q.drop_nulls(
        f"CASE WHEN {q.strip('premise')} = '' THEN 'blank_premise' END", f"CASE WHEN {q.strip('hypothesis')} = '' THEN 'blank_hypothesis' END",
        f"CASE WHEN ({q.label_id('gold_label')}) IS NULL THEN 'bad_label' END")}, ',') AS faults FROM ({fx.PAIRS}) p) o WHERE faults <> ''""",
)
def offending_rows(spark, d):
    return curation.offending_rows(derive(spark, d, fx.PAIRS)).select("nli_id", "split", *flat("faults"))


@query(
    "validate_sets",
    f"""WITH v AS ({VALID_SQL}), k AS (SELECT split AS dataset, split = 'external' AS lacks, * EXCLUDE (split) FROM v)
SELECT dataset, CASE WHEN lacks THEN 'hypothesis,gold_label' ELSE '' END AS missing, n_rows,
  {", ".join(f"CASE WHEN NOT lacks THEN {x} END AS {x}" for x in ("blank_premise", "blank_hypothesis", "bad_labels", *(f"n_{k}" for k in scoring.LABELS)))},
  CASE WHEN dataset = 'validation' THEN 0 WHEN NOT lacks THEN duplicate_ids END AS duplicate_ids, NOT lacks AND blank_premise + blank_hypothesis + bad_labels = 0 AS usable FROM k
UNION ALL SELECT 'nothing', '', 0, 0, 0, 0, 0, 0, 0, 0, true""",
)
def validate_sets(spark, d):
    p = derive(spark, d, fx.PAIRS)
    sets = {k: p.where(c("split") == k) for k in ("train", "internal", "external", "validation")}
    sets |= {"external": sets["external"].drop("hypothesis", "gold_label"), "validation": sets["validation"].drop("nli_id"), "nothing": p.where("false")}
    return curation.validate_sets(sets).withColumn("missing", F.array_join("missing", ","))


@query("duplicate_ids", f"SELECT split, count(*) - count(DISTINCT nli_id) AS duplicate_ids FROM ({fx.PAIRS}) p GROUP BY 1")
def duplicate_ids(spark, d):
    return curation.duplicate_ids(derive(spark, d, fx.PAIRS), by="split")


KEYED = f"WITH p AS (SELECT *, {q.pair_key('premise', 'hypothesis')} AS k FROM ({fx.PAIRS}) x), t AS (SELECT DISTINCT k FROM p WHERE split = 'train')"
PAIR_COLS = "nli_id, split, premise, hypothesis, gold_label, error_type"


def _split(spark, d):
    p = derive(spark, d, fx.PAIRS)
    return p.where("split != 'train'"), p.where("split = 'train'")


@query("remove_leakage", f"{KEYED} SELECT {PAIR_COLS} FROM p WHERE split <> 'train' AND k NOT IN (SELECT k FROM t)")
def remove_leakage(spark, d):
    return curation.remove_leakage(*_split(spark, d))


@query("leaked_rows", f"{KEYED} SELECT {PAIR_COLS} FROM p WHERE split <> 'train' AND k IN (SELECT k FROM t)")
def leaked_rows(spark, d):
    return curation.leaked_rows(*_split(spark, d))


@query(
    "leakage_report",
    f"""{KEYED}, f AS (SELECT split, gold_label AS label, coalesce(error_type, '(none)') AS etype, k IN (SELECT k FROM t) AS leaked FROM p WHERE split <> 'train'),
r AS (SELECT split, 'all' AS level, NULL::VARCHAR AS value, leaked FROM f UNION ALL SELECT split, 'label', label, leaked FROM f UNION ALL SELECT split, 'error_type', etype, leaked FROM f)
SELECT split, level, value, count(*) AS n_before, count(*) FILTER (WHERE leaked) AS n_removed, count(*) FILTER (WHERE NOT leaked) AS n_kept FROM r GROUP BY 1, 2, 3""",
)
def leakage_report(spark, d):
    return curation.leakage_report(*_split(spark, d))


def _labelled(spark, d):
    return derive(spark, d, fx.PAIRS).withColumn("gold_label_id", curation.gold_label_id(c("gold_label")))


@query(
    "label_distribution",
    f"""WITH p AS (SELECT split, {q.label_id("gold_label")} AS g FROM ({fx.PAIRS}) x)
SELECT s.split, l.i AS gold_label_id, l.label, (SELECT count(*) FROM p WHERE p.split = s.split AND p.g = l.i) AS n
FROM (SELECT DISTINCT split FROM p) s CROSS JOIN (VALUES (0, 'contradiction'), (1, 'entailment'), (2, 'neutral')) l(i, label)""",
)
def label_distribution(spark, d):
    return curation.label_distribution(_labelled(spark, d), "split")


@query("heldout_combined", f"SELECT {PAIR_COLS} FROM ({fx.PAIRS}) p WHERE split IN ('internal', 'external')")
def heldout_combined(spark, d):
    p = derive(spark, d, fx.PAIRS)
    return curation.heldout_combined(p.where("split = 'internal'"), p.where("split = 'external'"))


@query(
    "class_weights",
    f"""WITH p AS (SELECT {q.label_id("gold_label")} AS g FROM ({fx.PAIRS}) x WHERE split = 'train'), n AS (SELECT g, count(*) AS n FROM p WHERE g IS NOT NULL GROUP BY 1)
SELECT g AS gold_label_id, ['contradiction', 'entailment', 'neutral'][g + 1] AS label, n, round((SELECT sum(n) FROM n) / (3 * n) * CASE WHEN g = 0 THEN 1.5 ELSE 1.0 END, 9) AS weight FROM n""",
)
def class_weights(spark, d):
    return curation.class_weights(_labelled(spark, d).where("split = 'train'")).withColumn("weight", F.round("weight", 9))


# -- evaluation ---------------------------------------------------------------

SAID = [f"count(*) FILTER (WHERE pred_label_id = {i}) AS pred_{k}" for i, k in enumerate(scoring.LABELS)]


@query("confusion_matrix", f"SELECT model, dataset, gold_label_id, {', '.join(SAID)} FROM ({fx.PREDICTIONS}) p GROUP BY 1, 2, 3")
def confusion_matrix(spark, d):
    return evaluation.confusion(derive(spark, d, fx.PREDICTIONS), ["model", "dataset"])


def _metrics_sql(by: str) -> str:
    sums = ", ".join(
        f"count(*) FILTER (WHERE gold_label_id = {i} AND pred_label_id = {i})::DOUBLE AS tp_{k}, count(*) FILTER (WHERE gold_label_id = {i}) AS support_{k}, count(*) FILTER (WHERE pred_label_id = {i}) AS said_{k}"
        for i, k in enumerate(scoring.LABELS)
    )
    pr = ", ".join(f"coalesce(tp_{k} / nullif(said_{k}, 0), 0) AS precision_{k}, coalesce(tp_{k} / nullif(support_{k}, 0), 0) AS recall_{k}" for k in scoring.LABELS)
    f1 = ", ".join(f"coalesce(2 * precision_{k} * recall_{k} / nullif(precision_{k} + recall_{k}, 0), 0) AS f1_{k}" for k in scoring.LABELS)
    ks = scoring.LABELS
    return (
        f"WITH a AS (SELECT {by}, count(*) AS n_rows, count(*) FILTER (WHERE gold_label_id = pred_label_id) AS hits, {sums} FROM ({fx.PREDICTIONS}) p GROUP BY {by}), b AS (SELECT *, {pr} FROM a), m AS (SELECT *, {f1} FROM b) "
        f"SELECT {by}, n_rows, round_even(hits / n_rows, 6) AS accuracy, round_even(({' + '.join(f'f1_{k}' for k in ks)}) / 3, 6) AS macro_f1, round_even(({' + '.join(f'f1_{k} * support_{k}' for k in ks)}) / n_rows, 6) AS weighted_f1, "
        + ", ".join(f"round_even({x}_{k}, 6) AS {x}_{k}" for k in ks for x in ("precision", "recall", "f1"))
        + ", "
        + ", ".join(f"support_{k}" for k in ks)
        + " FROM m"
    )


@query("classification_metrics", _metrics_sql("model, dataset"))
def classification_metrics(spark, d):
    return evaluation.metrics(derive(spark, d, fx.PREDICTIONS), ["model", "dataset"])


WIDTHS = {"nli_id": 12, "gold_label_id": 4, "pred_label_id": 4, "error_type": 6}


@query("incorrect_predictions", f"SELECT {', '.join(f'rpad(substr(coalesce(CAST({k} AS VARCHAR), {chr(39)*2}), 1, {w}), {w}, {chr(39)} {chr(39)}) AS {k}' for k, w in WIDTHS.items())} FROM ({fx.PREDICTIONS}) p WHERE gold_label_id <> pred_label_id")
def incorrect_predictions(spark, d):
    return evaluation.incorrect_predictions(derive(spark, d, fx.PREDICTIONS), WIDTHS)


@query(
    "errors_by_type",
    f"""SELECT gold_label_id, error_type, count(*) AS n_errors, CAST(grouping(gold_label_id, error_type) AS INT) AS level
FROM (SELECT gold_label_id, coalesce(error_type, '(none)') AS error_type FROM ({fx.PREDICTIONS}) p WHERE gold_label_id <> pred_label_id) e GROUP BY ROLLUP (gold_label_id, error_type)""",
)
def errors_by_type(spark, d):
    return evaluation.errors_by_type(derive(spark, d, fx.PREDICTIONS))


@query("leaderboard", f"SELECT row_number() OVER (ORDER BY f1_contradiction DESC, recall_contradiction DESC, macro_f1 DESC, model) AS rank, model, f1_contradiction, recall_contradiction, macro_f1 FROM ({_metrics_sql('model')}) m")
def leaderboard(spark, d):
    return evaluation.leaderboard(evaluation.metrics(derive(spark, d, fx.PREDICTIONS), ["model"]))


@query(
    "run_deltas",
    f"""WITH m AS ({_metrics_sql("model, dataset")}), l AS (SELECT dataset, model, 'macro_f1' AS metric, macro_f1 AS value FROM m UNION ALL SELECT dataset, model, 'accuracy', accuracy FROM m),
p AS (SELECT *, lag(value) OVER (PARTITION BY dataset, metric ORDER BY model) AS previous FROM l)
SELECT dataset, model, metric, value, previous, round(value - previous, 9) AS delta, CASE WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' ELSE 'same' END AS direction FROM p WHERE previous IS NOT NULL""",
)
def run_deltas(spark, d):
    m = evaluation.metrics(derive(spark, d, fx.PREDICTIONS), ["model", "dataset"])
    return evaluation.run_deltas(m, "model", ["macro_f1", "accuracy"], ["dataset"]).withColumn("delta", F.round("delta", 9))


@query(
    "best_epoch",
    f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS epoch_num, row_number() OVER (PARTITION BY run ORDER BY eval_macro_f1 DESC, step) AS r FROM ({fx.EPOCHS}) x)
SELECT run, step, eval_macro_f1, epoch_num FROM e WHERE r = 1""",
)
def best_epoch(spark, d):
    return evaluation.best_epoch(derive(spark, d, fx.EPOCHS))


DOC_PAIRS = "SELECT conv_id, turn, text AS premise, concat(role, ' says so.') AS hypothesis, role AS dataset FROM conversations"
LEN = r"(len(regexp_extract_all(coalesce(premise, ''), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) + len(regexp_extract_all(coalesce(hypothesis, ''), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) + 3)"


@query("token_length_stats", f"SELECT dataset, count(*) AS n_rows, max({LEN}) AS max_tokens, avg({LEN}) AS avg_tokens, count(*) FILTER (WHERE {LEN} > 60) AS n_over FROM ({DOC_PAIRS}) p GROUP BY 1")
def token_length_stats(spark, d):
    return scoring.length_stats(scoring.pair_length(derive(spark, d, DOC_PAIRS)), max_length=60)


@query("length_gate", f"SELECT conv_id, turn, {LEN} AS n_tokens, {LEN} <= 60 AS accepted FROM ({DOC_PAIRS}) p")
def length_gate(spark, d):
    ok, over = scoring.length_gate(scoring.pair_length(derive(spark, d, DOC_PAIRS)), 60)
    both = ok.withColumn("accepted", F.lit(True)).unionByName(over.withColumn("accepted", F.lit(False)))
    return both.select("conv_id", "turn", "n_tokens", "accepted")


# -- scores and labels --------------------------------------------------------

SOFT = f"""s AS (SELECT *, exp(l0 - greatest(l0, l1, l2)) AS e0, exp(l1 - greatest(l0, l1, l2)) AS e1, exp(l2 - greatest(l0, l1, l2)) AS e2 FROM ({fx.DUCK_LOGITS}) x),
p AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 'contradiction' WHEN l1 >= l2 THEN 'entailment' ELSE 'neutral' END AS raw_label FROM s)"""


@query(
    "softmax_label",
    f"""WITH {SOFT} SELECT vec_id, round(p0, 9) AS prob_contradiction, round(p1, 9) AS prob_entailment, round(p2, 9) AS prob_neutral, round(greatest(p0, p1, p2), 9) AS confidence, raw_label,
  CASE raw_label WHEN 'entailment' THEN 'supported' WHEN 'contradiction' THEN 'unsupported' ELSE 'uncertain' END AS label FROM p""",
)
def softmax_label(spark, d):
    df = scoring.with_nli_label(derive(spark, d, fx.SPARK_LOGITS))
    return df.select("vec_id", *[F.round(x, 9).alias(x) for x in ("prob_contradiction", "prob_entailment", "prob_neutral", "confidence")], "raw_label", "label")


ORDERS = {"m0": ("entailment", "neutral", "contradiction"), "m1": ("Contradiction", "Entailment", "Neutral"), "m2": ("neutral", "neutral", "contradiction")}
LABEL_ROWS = " UNION ALL ".join(f"SELECT '{m}' AS model, {i} AS native_idx, '{x}' AS label" for m, xs in ORDERS.items() for i, x in enumerate(xs))


@query(
    "label_permutation",
    f"SELECT vec_id, CASE model WHEN 'm0' THEN l2 WHEN 'm1' THEN l0 END AS prob_contradiction, CASE model WHEN 'm0' THEN l0 WHEN 'm1' THEN l1 END AS prob_entailment, CASE model WHEN 'm0' THEN l1 WHEN 'm1' THEN l2 END AS prob_neutral FROM ({fx.DUCK_LOGITS}) x",
)
def label_permutation(spark, d):
    scores = derive(spark, d, fx.SPARK_LOGITS).select("vec_id", "model", F.array("l0", "l1", "l2").alias("probs"))
    return scoring.canonical_probs(scores, spark.sql(LABEL_ROWS)).drop("model", "probs")


@query(
    "validate_probs",
    f"""SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'missing' WHEN vec_id % 7 = 1 THEN 'not_finite' WHEN l0 < 0 OR l0 > 1 OR l1 < 0 OR l1 > 1 OR l2 < 0 OR l2 > 1 THEN 'out_of_range'
  WHEN abs(l0 + l1 + l2 - 1) > 1e-3 THEN 'bad_sum' END AS reason FROM ({fx.DUCK_LOGITS}) x""",
)
def validate_probs(spark, d):
    x = derive(spark, d, fx.SPARK_LOGITS)
    l0 = F.when(c("vec_id") % 7 == 0, None).when(c("vec_id") % 7 == 1, float("nan")).otherwise(c("l0"))
    x = x.withColumn("p0", l0).withColumn("top", F.greatest("l0", "l1", "l2"))
    # the confidence is in range wherever the others are
    top = F.when((c("l0") < 0) | (c("l1") < 0) | (c("l2") < 0), F.lit(0.5)).otherwise(c("top"))
    return x.select("vec_id", scoring.probs_reason(c("p0"), c("l1"), c("l2"), top).alias("reason"))


@query(
    "verify_reason",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'no_evidence' WHEN event_id % 5 = 0 THEN 'nli_model_unavailable' WHEN event_id % 5 = 1 THEN 'nli_input_too_long'
  WHEN event_id % 5 = 2 THEN 'nli_invalid_output' WHEN event_id % 5 = 3 THEN 'nli_inference_failed' END AS reason FROM events""",
)
def verify_reason(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    codes = F.array(*[F.lit(x) for x in ("model_unavailable", "input_too_long", "invalid_output", "inference_failed")])
    error = F.try_element_at(codes, (c("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", scoring.verify_reason(F.when(c("event_id") % 11 == 0, "").otherwise("text"), error).alias("reason"))


@query(
    "build_predictions",
    f"""WITH {SOFT} SELECT vec_id, CAST(vec_id % 3 AS INT) AS gold_label_id, ['contradiction', 'entailment', 'neutral'][vec_id % 3 + 1] AS gold_label_name, raw_label AS pred_label, round_even(greatest(p0, p1, p2), 6) AS confidence,
  raw_label = ['contradiction', 'entailment', 'neutral'][vec_id % 3 + 1] AS correct, round_even(p0, 6) AS prob_contradiction, round_even(p1, 6) AS prob_entailment, round_even(p2, 6) AS prob_neutral FROM p""",
)
def build_predictions(spark, d):
    df = scoring.with_nli_label(derive(spark, d, fx.SPARK_LOGITS)).withColumn("gold_label_id", (c("vec_id") % 3).cast("int"))
    return scoring.build_predictions(df.select("vec_id", "gold_label_id", "prob_contradiction", "prob_entailment", "prob_neutral"))


def _length_scorer():
    return lambda ev, cl: np.array([[len(a) % 7, len(b) % 5, (len(a) + len(b)) % 3] for a, b in zip(ev, cl, strict=True)], float)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked pairs as a table: scoring reads them more than once, and would link anew each time."""
    return written(_linked(spark, sf_dir).select("provision_id", "claim_id", "evidence_text", "claim_text"), "pairs")


@query("batch_score", f"{LINK_SQL} SELECT provision_id, claim_id, (length(evidence_text) % 7)::DOUBLE AS l0, (length(claim_text) % 5)::DOUBLE AS l1, ((length(evidence_text) + length(claim_text)) % 3)::DOUBLE AS l2, NULL::VARCHAR AS error FROM linked")
def batch_score(spark, d):
    return scoring.score_once(_pairs(spark, d), _length_scorer).drop("evidence_text", "claim_text")


@query("batch_generate", f"SELECT provision_id, upper(text) AS output, 1 AS attempts, NULL::VARCHAR AS gen_error FROM ({fx.PROVISIONS}) p")
def batch_generate(spark, d):
    return scoring.batch_generate(derive(spark, d, fx.PROVISIONS), lambda: str.upper, "text").drop("act_name", "text")


@query(
    "score_store",
    f"""{LINK_SQL}, k AS (SELECT *, CAST(substr(provision_id, 2) AS BIGINT) % 3 AS third FROM linked),
old AS (SELECT DISTINCT evidence_text, claim_text FROM k WHERE third < 2)
SELECT k.provision_id, k.claim_id, (length(k.evidence_text) % 7)::DOUBLE AS l0, (length(k.claim_text) % 5)::DOUBLE AS l1, ((length(k.evidence_text) + length(k.claim_text)) % 3)::DOUBLE AS l2, NULL::VARCHAR AS error,
  (SELECT count(*) FROM (SELECT DISTINCT evidence_text, claim_text FROM k) a WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.evidence_text = a.evidence_text AND old.claim_text = a.claim_text)) AS n_new
FROM k""",
)
def score_store_runs(spark, d):
    """Two thirds of the pairs are scored by a first run; the second one scores what is new, n_new pairs, and gives all scores."""
    pairs = _pairs(spark, d)
    store = fresh_path(spark, "scores")
    first = F.substring("provision_id", 2, 20).cast("long") % 3 < 2
    score_store.score_with_store(pairs.where(first), _length_scorer, store, "length")  # stored when it returns
    before = score_store.stored_scores(spark, store, "length").count()
    rows = score_store.score_with_store(pairs, _length_scorer, store, "length")
    after = score_store.stored_scores(spark, store, "length").count()
    return rows.drop("evidence_text", "claim_text").withColumn("n_new", F.lit(after - before).cast("long"))


def _claim_generators():
    """Two prompts of a generator that fails in every way, told by a text's length."""
    tried = set()

    def normal(text):
        k = len(text) % 7
        if k == 0 or (k == 4 and text not in tried):
            tried.add(text)
            raise ConnectionError("busy")
        tried.discard(text)
        if k == 1:
            raise PermissionError("denied")
        return {2: "", 3: "no json", 5: "[]"}.get(k, '[{"claim_id": "1", "claim_text": "first"}]')

    def strict(text):
        return '[{"claim_id": 1, "claim_text": "bad id"}]' if len(text) % 2 else '```json [{"claim_id": "2", "claim_text": "second"}]```'

    return [normal, strict]


def _no_generators():
    raise OSError("no weights")


@query(
    "claims_with_retries",
    f"""WITH p AS (SELECT provision_id, length(text) % 7 AS k, length(text) % 2 = 0 AS even, CAST(substr(provision_id, 2) AS BIGINT) % 10 = 9 AS lost FROM ({fx.PROVISIONS}) p)
SELECT provision_id, CASE WHEN lost OR k IN (0, 1) THEN NULL WHEN k IN (2, 3, 5) THEN CASE WHEN even THEN '```json [{{"claim_id": "2", "claim_text": "second"}}]```' END ELSE '[{{"claim_id": "1", "claim_text": "first"}}]' END AS raw,
  CAST(CASE WHEN lost THEN 0 WHEN k = 0 THEN 3 WHEN k IN (1, 6) THEN 1 ELSE 2 END AS INT) AS calls,
  CASE WHEN lost THEN 'OSError: no weights' WHEN k = 0 THEN 'ConnectionError: busy' WHEN k = 1 THEN 'PermissionError: denied' END AS call_error FROM p""",
)
def claims_with_retries(spark, d):
    """Answers within a budget of calls; a tenth of the rows meets generators that can't be loaded."""
    p = derive(spark, d, fx.PROVISIONS)
    lost = F.substring("provision_id", 2, 20).cast("long") % 10 == 9
    parts = [scoring.claims_with_retries(p.where(~lost), _claim_generators, "text"), scoring.claims_with_retries(p.where(lost), _no_generators, "text")]
    return parts[0].unionByName(parts[1]).drop("act_name", "text")


# -- runs ---------------------------------------------------------------------

STATUS_SQL = f"""
WITH r AS ({fx.RUNS}), cl AS ({fx.RUN_CLAIMS}),
a AS (SELECT run_id, bool_or(evidence_text IS NULL) AS missing, bool_or(coalesce(evidence_method LIKE 'full%', false)) AS fullp, bool_or(evidence_ambiguity) AS tied,
  bool_or(coalesce(verification_reason = 'nli_input_too_long', false)) AS degraded, bool_or(coalesce(extraction_warning = 'unsupported_number', false) OR verification_warning IS NOT NULL) AS warned FROM cl GROUP BY 1),
st AS (SELECT r.*, CASE WHEN a.run_id IS NULL THEN 'skipped' WHEN missing THEN 'partial' WHEN fullp THEN 'fallback' WHEN tied THEN 'ambiguous' ELSE 'success' END AS evidence_status,
  CASE WHEN a.run_id IS NULL THEN 'skipped' WHEN degraded THEN 'partial' ELSE 'success' END AS nli_status, coalesce(warned, false) AS has_warning FROM r LEFT JOIN a USING (run_id))
"""


def _run_claims(spark, d):
    one = lambda x: F.when(c(x).isNotNull(), F.array(x)).otherwise(F.array().cast("array<string>"))
    return derive(spark, d, fx.RUN_CLAIMS).withColumn("extraction_warnings", one("extraction_warning")).withColumn("verification_warnings", one("verification_warning"))


def _statuses(spark, d):
    return status.stage_status(_run_claims(spark, d), derive(spark, d, fx.RUNS))


@query("evidence_stage_status", f"{STATUS_SQL} SELECT run_id, evidence_status FROM st")
def evidence_stage_status(spark, d):
    return _statuses(spark, d).select("run_id", "evidence_status")


@query("nli_stage_status", f"{STATUS_SQL} SELECT run_id, nli_status FROM st")
def nli_stage_status(spark, d):
    return _statuses(spark, d).select("run_id", "nli_status")


@query(
    "overall_status",
    f"""{STATUS_SQL} SELECT run_id, CASE WHEN span_status = 'failed' OR simplify_status = 'failed' THEN 'failed' WHEN span_status = 'fallback' OR claim_status = 'fallback'
  OR evidence_status IN ('fallback', 'partial', 'ambiguous') OR nli_status = 'partial' OR has_warning THEN 'partial' ELSE 'success' END AS overall FROM st""",
)
def overall_status(spark, d):
    return status.overall_status(_statuses(spark, d)).select("run_id", "overall")


@query(
    "assemble_run",
    f"""{LINK_SQL}, n AS (SELECT provision_id, count(*) AS n_claims, string_agg(claim_id, ',' ORDER BY claim_id) AS claim_ids FROM linked GROUP BY 1), sp AS (SELECT provision_id, string_agg(span_id, ',' ORDER BY span_idx) AS span_ids FROM s GROUP BY 1)
SELECT provision_id, n_claims, claim_ids, span_ids, 'llm' AS claim_method FROM n JOIN sp USING (provision_id)""",
)
def assemble_run(spark, d):
    empty = F.array().cast("array<string>")
    linked = _linked(spark, d).withColumns(
        {"verification_label": F.lit("supported"), "verification_confidence": F.lit(None).cast("double"), "extraction_warnings": empty, "verification_warnings": empty}
    )
    linked = linked.withColumns({"nli_raw_label": F.lit("entailment"), "nli_probabilities": F.create_map(F.lit("entailment"), F.lit(1.0)), "verification_reason": F.lit(None).cast("string")})
    named = ("span_status", "simplify_status", "claim_status", "evidence_status", "nli_status", "overall")
    runs = derive(spark, d, fx.PROVISIONS).select(
        "provision_id", c("provision_id").alias("run_id"), F.lit("text").alias("simplified_text"), F.lit("llm").alias("claim_method"), F.lit(1).alias("attempts"),
        *[F.lit("success").alias(x) for x in named], *[F.lit(None).cast("string").alias(x) for x in ("span_method", "span_reason", "simplify_reason")],
    )
    nested = status.assemble_run(runs, linked, _spans(spark, d), "any", "any")
    return nested.select(
        "provision_id", F.size("claims").cast("long").alias("n_claims"), F.array_join("claims.claim_id", ",").alias("claim_ids"), F.array_join("spans.span_id", ",").alias("span_ids"),
        c("provenance.claim_extraction_method").alias("claim_method"),
    )


def _millionths(x: str) -> str:
    return f"CAST(CAST(round({x} * 1000000) AS BIGINT) AS VARCHAR)"


_WARNED = q.drop_nulls(
    f"CASE WHEN len({q.numbers('evidence_text')}) > 0 AND len({q.numbers('claim_text')}) > 0 AND {q.numbers('evidence_text')} <> {q.numbers('claim_text')} THEN 'numerical_conflict' END",
    f"CASE WHEN {q.conflict('evidence_text', 'claim_text')} THEN 'clear_modal_conflict' END",
)
_DRAWN = q.drop_nulls(
    f"CASE WHEN len(list_filter({q.numbers('claim_text')}, lambda x: NOT list_contains({q.numbers('simplified_text')}, x))) > 0 THEN 'unsupported_number' END",
    f"CASE WHEN len(list_intersect({q.lex('claim_text')}, {q.lex('simplified_text')})) = 0 THEN 'zero_lexical_overlap' END",
    f"CASE WHEN {q.conflict('claim_text', 'simplified_text')} THEN 'clear_modal_conflict' END",
)


@query(
    "verify_provisions",
    f"""{LINK_SQL}, rs AS (SELECT *, CAST(substr(provision_id, 2) AS BIGINT) AS n FROM ({fx.RESPONSES}) r),
st AS (SELECT provision_id, n, simplified_text, attempts, error, n % 31 = 0 AS no_spans, simplified_text IS NULL AS no_text, CASE WHEN n % 5 <> 0 THEN 'llm' WHEN {fx.ONE_CLAIM} THEN 'whole_text_claim' WHEN {fx.CLAUSES} THEN 'clause_splitter' ELSE 'sentence_splitter' END AS claim_method FROM rs),
z AS (SELECT l.*, st.simplified_text, CASE WHEN length(claim_text) % 11 <> 0 THEN [(length(evidence_text) % 7)::DOUBLE, (length(claim_text) % 5)::DOUBLE, ((length(evidence_text) + length(claim_text)) % 3)::DOUBLE] END AS lg
  FROM linked l JOIN st USING (provision_id) WHERE NOT no_spans AND NOT no_text AND (claim_method <> 'whole_text_claim' OR claim_id = 'C1')),
pr AS (SELECT *, list_transform(lg, lambda x: exp(x - list_max(lg)) / (exp(lg[1] - list_max(lg)) + exp(lg[2] - list_max(lg)) + exp(lg[3] - list_max(lg)))) AS p, list_position(lg, list_max(lg)) AS k FROM z),
lb AS (SELECT *, CASE WHEN lg IS NULL THEN 'unverified' ELSE ['unsupported', 'supported', 'uncertain'][k] END AS label, {_DRAWN} AS ew, CASE WHEN k = 2 THEN {_WARNED} ELSE [] END AS vw FROM pr),
cs AS (SELECT provision_id, string_agg(concat_ws('|', claim_id, claim_text, coalesce(evidence_span_id, '-'), evidence_text, evidence_score, evidence_method, label, CASE WHEN lg IS NULL THEN '-' ELSE ['contradiction', 'entailment', 'neutral'][k] END,
    coalesce({_millionths('p[k]')}, '-'), coalesce({_millionths('p[2]')}, '-'), CASE WHEN lg IS NULL THEN 'nli_inference_failed' ELSE '-' END, CASE WHEN len(vw) > 0 THEN array_to_string(vw, ',') ELSE '-' END,
    CASE WHEN len(ew) > 0 THEN array_to_string(ew, ',') ELSE '-' END, CASE WHEN evidence_ambiguity THEN 'tie' ELSE 'no tie' END, evidence_span_ids, coalesce({_millionths('p[k]')}, '0')), ';' ORDER BY claim_id) AS claims,
  bool_or(lg IS NULL) AS nli_bad, bool_or(evidence_method <> 'lexical_overlap') AS whole, bool_or(len(list_intersect(list_concat(ew, vw), ['unsupported_number', 'numerical_conflict', 'clear_modal_conflict'])) > 0) AS warned FROM lb GROUP BY 1),
sp AS (SELECT provision_id, string_agg(concat_ws('|', span_id, text, start, "end"), ';' ORDER BY span_idx) AS spans FROM s GROUP BY 1)
SELECT provision_id, concat('run-', provision_id) AS run_id, CASE WHEN NOT no_spans THEN simplified_text END AS simplified_text, coalesce(claims, '') AS claims, CASE WHEN no_spans THEN 'P1||0|0' ELSE spans END AS spans,
  CASE WHEN no_spans OR no_text THEN 'failed' WHEN n % 5 = 0 OR whole OR nli_bad OR warned THEN 'partial' ELSE 'success' END AS overall,
  CASE WHEN no_spans THEN 'failed,empty_text' ELSE 'success,-' END AS span_generation,
  CASE WHEN no_spans THEN 'skipped,-,-' WHEN no_text THEN concat('failed,', attempts, ',TimeoutError') ELSE concat('success,', attempts, ',-') END AS simplification,
  CASE WHEN no_spans OR no_text THEN 'skipped,-' ELSE concat(CASE WHEN n % 5 = 0 THEN 'fallback,' ELSE 'success,' END, claim_method) END AS claim_extraction,
  CASE WHEN no_spans OR no_text THEN 'skipped,-' WHEN whole THEN 'fallback,full_provision' ELSE 'success,lexical_overlap' END AS evidence_retrieval,
  CASE WHEN no_spans OR no_text THEN 'skipped' WHEN nli_bad THEN 'partial' ELSE 'success' END AS nli_verification,
  CASE WHEN NOT no_spans AND NOT no_text THEN concat('s,', claim_method, ',', CASE WHEN whole THEN 'full_provision' ELSE 'lexical_overlap' END, ',n') END AS provenance,
  'success' AS run_logging, CASE WHEN no_spans THEN '{status.NO_SPANS}empty_text' WHEN no_text THEN 'TimeoutError' END AS message
FROM st LEFT JOIN cs USING (provision_id) LEFT JOIN sp USING (provision_id)""",
)
def verify_provisions(spark, d):
    n = F.substring("provision_id", 2, 20).cast("long")
    provisions = derive(spark, d, fx.PROVISIONS).withColumn("text", F.when(n % 31 == 0, "").otherwise(c("text")))
    a, b = F.length("evidence_text"), F.length("claim_text")

    def score(linked):
        lost = F.when(b % 11 == 0, "inference_failed")
        return linked.withColumns({**{f"l{k}": F.when(lost.isNull(), x.cast("double")) for k, x in enumerate((a % 7, b % 5, (a + b) % 3))}, "error": lost})

    r = verification.verify_provisions(provisions, derive(spark, d, fx.RESPONSES), score, F.concat(F.lit("run-"), c("provision_id")), "s", "n", (fresh_path(spark, "log"), "all"))
    dash = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    part = lambda x: dash(F.round(x * 1_000_000).cast("long"))
    claim = lambda x: F.concat_ws(
        "|", x["claim_id"], x["claim_text"], dash(x["evidence_span_id"]), x["evidence_text"], x["evidence_score"].cast("string"), x["evidence_method"], x["verification_label"], dash(x["nli_raw_label"]),
        part(x["verification_confidence"]), part(x["nli_probabilities"]["entailment"]), dash(x["verification_reason"]), dash(F.array_join(x["verification_warnings"], ",")),
        dash(F.array_join(x["extraction_warnings"], ",")), F.when(x["evidence_ambiguity"], "tie").otherwise("no tie"), F.array_join(x["evidence_span_ids"], ","), part(x["label_confidence"]),
    )
    span = lambda x: F.concat_ws("|", x["span_id"], x["text"], x["start"].cast("string"), x["end"].cast("string"))
    s = lambda stage, *fields: F.concat_ws(",", *[dash(c(f"pipeline_status.{stage}.{f}")) for f in ("status", *fields)]).alias(stage)
    p = c("provenance")
    sources = F.concat_ws(",", p["simplification_model"], p["claim_extraction_method"], p["evidence_retrieval_method"], p["nli_model"])
    return r.select(
        "provision_id", "run_id", "simplified_text", F.array_join(F.transform("claims", claim), ";").alias("claims"), F.array_join(F.transform("spans", span), ";").alias("spans"), "pipeline_status.overall",
        s("span_generation", "reason"), s("simplification", "attempts", "reason"), s("claim_extraction", "method"), s("evidence_retrieval", "method"), s("nli_verification"), s("run_logging"), F.when(p.isNotNull(), sources).alias("provenance"), "message",
    )


@query("recent_runs", f"SELECT run_id, event_type, span_status FROM ({fx.RUNS}) r ORDER BY ts DESC, run_id LIMIT 5")
def recent_runs(spark, d):
    return status.recent_runs(derive(spark, d, fx.RUNS), drop=("simplified_text",)).select("run_id", "event_type", "span_status")


@query(
    "label_confidence_pct",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Unable to verify' ELSE concat('Supported ', printf('%.2f', (event_id % 50) / 50.0 * 100), '%') END AS badge, 'P1 + P2' AS id_text FROM events""",
)
def label_confidence_pct(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(
        "event_id", F.when(c("event_id") % 5 == 0, "unverified").otherwise("supported").alias("label"), ((c("event_id") % 50) / 50.0).alias("label_confidence"), F.array(F.lit("P1"), F.lit("P2")).alias("evidence_span_ids")
    )
    return status.label_badge(e).select("event_id", "badge", "id_text")


# -- rewrites -----------------------------------------------------------------

WORDS_SQL = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}'']+')"
SYL = r"greatest(len(regexp_extract_all(regexp_replace(w, '([^aeiouy])e$', '\1'), '[aeiouy]+')), 1)"


def _grade_sql(t: str) -> tuple[str, str]:
    words = WORDS_SQL.format(t=t)
    n, s = f"len({words})", rf"greatest(len(regexp_extract_all({t}, '[.!?]+(?:\s|$)')), 1)"
    syl, let = f"list_sum(list_transform({words}, lambda w: {SYL}))", rf"len(regexp_extract_all({t}, '[\p{{L}}\p{{N}}]'))"
    fk, ar = f"0.39 * {n} / {s} + 11.8 * {syl} / {n} - 15.59", f"4.71 * {let} / {n} + 0.5 * {n} / {s} - 21.43"
    return tuple(f"CASE WHEN {n} > 0 THEN {x} END" for x in (fk, ar))


@query("readability", f"SELECT doc_id, round({_grade_sql('text')[0]}, 9) AS fkgl, round({_grade_sql('text')[1]}, 9) AS ari FROM documents")
def readability(spark, d):
    return documents(spark, d).select("doc_id", F.round(rewrites.fkgl(c("text")), 9).alias("fkgl"), F.round(rewrites.ari(c("text")), 9).alias("ari"))


@query(
    "rouge_l",
    f"""WITH RECURSIVE r AS (SELECT example_id, model, source_text, output, regexp_extract_all(lower(source_text), '[a-z0-9]+') AS a, regexp_extract_all(lower(output), '[a-z0-9]+') AS b FROM ({fx.REWRITES}) x),
t AS (SELECT example_id, model, a, b, 1 AS i, list_transform(b, lambda w: 0) AS l FROM r WHERE len(a) > 0 AND len(b) > 0
  UNION ALL SELECT example_id, model, a, b, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1),
    lambda k: greatest(l[k], CASE WHEN a[i] = b[k] THEN 1 + CASE WHEN k > 1 THEN l[k - 1] ELSE 0 END ELSE 0 END)))) FROM t WHERE i <= len(a)),
d AS (SELECT example_id, model, l[len(l)] AS k FROM t WHERE i = len(a) + 1)
SELECT example_id, model, CASE WHEN {q.strip('source_text')} <> '' AND {q.strip('output')} <> '' THEN round(coalesce(2.0 * k / (len(a) + len(b)), 0), 6) END AS rouge_l FROM r LEFT JOIN d USING (example_id, model)""",
)
def rouge_l(spark, d):
    return derive(spark, d, fx.REWRITES).select("example_id", "model", F.round(rewrites.rouge_l(c("source_text"), c("output"), stem=False), 6).alias("rouge_l"))


@query("rouge_l_stemmed")  # the stems have no SQL; tests hold published ones
def rouge_l_stemmed(spark, d):
    return derive(spark, d, fx.REWRITES).select("example_id", "model", F.round(rewrites.rouge_l(c("source_text"), c("output")), 6).alias("rouge_l"))


SCORE_SQL = f"SELECT example_id, model, has_exception, 'length' AS metric, CASE WHEN length(output) % 13 = 0 THEN 'error' ELSE CAST(length(output) AS VARCHAR) END AS value FROM ({fx.REWRITES}) r"


def _scores(spark, d):
    n = F.length("output")
    return derive(spark, d, fx.REWRITES).select("example_id", "model", "has_exception", F.lit("length").alias("metric"), F.when(n % 13 == 0, "error").otherwise(n.cast("string")).alias("value"))


@query("model_averages", f"SELECT model, metric, round_even(avg(TRY_CAST(value AS DOUBLE)), 3) AS mean, count(TRY_CAST(value AS DOUBLE)) AS n FROM ({SCORE_SQL}) s GROUP BY 1, 2")
def model_averages(spark, d):
    return rewrites.model_averages(_scores(spark, d))


@query(
    "row_wins",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY example_id, metric ORDER BY TRY_CAST(value AS DOUBLE) DESC, model) AS r FROM ({SCORE_SQL}) s WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL)
SELECT model, metric, count(*) AS wins FROM r WHERE r = 1 GROUP BY 1, 2""",
)
def row_wins(spark, d):
    return rewrites.row_wins(_scores(spark, d).withColumn("value", c("value").try_cast("double")))


@query(
    "slice_by_flag",
    f"""WITH a AS (SELECT model, avg(TRY_CAST(value AS DOUBLE)) FILTER (WHERE has_exception = 0) AS w0, avg(TRY_CAST(value AS DOUBLE)) FILTER (WHERE has_exception = 1) AS w1 FROM ({SCORE_SQL}) s GROUP BY 1)
SELECT model, round(w0, 6) AS without, round(w1, 6) AS "with", round(w0 - w1, 6) AS "drop" FROM a""",
)
def slice_by_flag(spark, d):
    s = rewrites.slice_by_flag(_scores(spark, d).withColumn("value", c("value").try_cast("double")), "has_exception")
    return s.select("model", *[F.round(x, 6).alias(x) for x in ("without", "with", "drop")])


@query("exact_copies", f"SELECT model, count(*) FILTER (WHERE {q.strip('output')} = {q.strip('source_text')}) AS n_copies, count(*) AS n_rows FROM ({fx.REWRITES}) r GROUP BY 1")
def exact_copies(spark, d):
    return rewrites.exact_copies(derive(spark, d, fx.REWRITES))


def _counted(pattern: str, of: str = "output") -> str:
    return f"count(*) FILTER (WHERE regexp_matches({of}, '" + pattern.replace("(?iU)", "(?i)").replace("(?mdU)", "(?m)").replace("'", "''") + "'))"


@query(
    "format_defects",
    f"SELECT model, count(*) FILTER (WHERE {q.has_preamble('output')}) AS n_preamble, {_counted(rewrites.BULLET)} AS n_bullets, {_counted(rewrites.LEAKED)} AS n_leaked_label FROM ({fx.REWRITES}) r GROUP BY 1",
)
def format_defects(spark, d):
    return rewrites.format_defects(derive(spark, d, fx.REWRITES))


@query(
    "source_vs_gold",
    f"""WITH t AS (SELECT 'source' AS side, source_text AS t FROM ({fx.REWRITES}) r UNION ALL SELECT 'gold', simple_text FROM ({fx.REWRITES}) r), g AS (SELECT side, {_grade_sql("t")[0]} AS f, {_grade_sql("t")[1]} AS a FROM t)
SELECT side, round_even(avg(f), 3) AS fkgl, round_even(avg(a), 3) AS ari, count(f) AS n FROM g GROUP BY 1""",
)
def source_vs_gold(spark, d):
    return rewrites.source_vs_gold(derive(spark, d, fx.REWRITES))


# -- statute extraction -------------------------------------------------------

NOISE = r"""(trim(t) = '' OR regexp_matches(t, '^\[\s*\d+.*\]$') OR (x1 < 132 AND length(t) < 80) OR (x0 < 120 AND length(t) < 60 AND NOT regexp_matches(t, '^(\d+[A-Z]?\.|CHAPTER\b)')))"""
WORD_LINES = (
    f"l AS (SELECT *, x0 + 20.0 * (len(string_split(text, ' ')) - 1) + 15 AS x1, {q.strip(q.norm('text').replace('lower', ''))} AS t FROM ({fx.LINES}) x)"
)
CLEAN = f"{WORD_LINES}, k AS (SELECT doc_id, page, line_no, x0, y0, x1, t FROM l WHERE NOT {NOISE})"


def _words(spark, d):
    lines = derive(spark, d, fx.LINES)
    w = lines.select("doc_id", "page", F.lit(600.0).alias("page_width"), F.lit(0).alias("block_no"), "line_no", "x0", "y0", F.posexplode(F.split("text", " ")).alias("word_no", "word"))
    x0 = c("x0") + 20.0 * c("word_no")
    return w.select("doc_id", "page", "page_width", "block_no", "line_no", "word_no", x0.alias("x0"), c("y0").cast("double").alias("y0"), (x0 + 15).alias("x1"), (c("y0") + 8).cast("double").alias("y1"), "word")


def _pages(spark, d):
    return extraction.lines_to_pages(extraction.drop_margin_noise(extraction.words_to_lines(_words(spark, d))))


@query("words_to_lines", f"WITH {WORD_LINES} SELECT doc_id, page, line_no, x0::DOUBLE AS x0, y0, x1::DOUBLE AS x1, text FROM l")
def words_to_lines(spark, d):
    return extraction.words_to_lines(_words(spark, d)).select("doc_id", "page", "line_no", "x0", "y0", "x1", "text")


@query("drop_margin_noise", f"WITH {CLEAN} SELECT doc_id, page, line_no, t AS text FROM k")
def drop_margin_noise(spark, d):
    return extraction.drop_margin_noise(extraction.words_to_lines(_words(spark, d))).select("doc_id", "page", "line_no", "text")


PAGES_SQL = f"{CLEAN}, pg AS (SELECT doc_id, page, string_agg(t, chr(10) ORDER BY y0, x0) AS text FROM k GROUP BY 1, 2)"


@query("lines_to_pages", f"WITH {PAGES_SQL} SELECT * FROM pg")
def lines_to_pages(spark, d):
    return _pages(spark, d)


@query("merge_pages", f"WITH {PAGES_SQL} SELECT doc_id, string_agg(concat('--- PAGE ', CAST(page AS VARCHAR), ' ---', chr(10), text), chr(10) || chr(10) ORDER BY page) AS text FROM pg GROUP BY 1")
def merge_pages(spark, d):
    return extraction.merge_pages(_pages(spark, d))


SECTIONS_SQL = f"""{CLEAN},
v AS (SELECT *, regexp_extract(t, '^(\\d+[A-Z]?)\\.(\\s|$)', 1) AS mark FROM k),
m AS (SELECT *, mark <> '' AND length(mark) < 4 AND TRY_CAST(mark AS INT) BETWEEN 1 AND 500 AS valid FROM v),
o AS (SELECT *, count(*) FILTER (WHERE valid) OVER (PARTITION BY doc_id ORDER BY page, y0) AS section_no, max(y0) OVER (PARTITION BY doc_id, page) AS page_end FROM m),
g AS (SELECT *, max(CASE WHEN valid THEN mark END) OVER s AS section_id, min(page) OVER s AS first_page, max(page) OVER s AS last_page, max(page * 10000 + y0) OVER s AS last_at FROM o WHERE section_no > 0 WINDOW s AS (PARTITION BY doc_id, section_no)),
nx AS (SELECT doc_id, page, lead(page) OVER (PARTITION BY doc_id ORDER BY page) AS next_page, max(page * 10000 + y0) AS end_at FROM k GROUP BY doc_id, page),
se AS (SELECT g.doc_id, g.page, g.y0, g.t AS line, section_no, section_id, CASE WHEN last_page > first_page OR last_at = nx.end_at THEN nx.next_page END AS page_start
  FROM g JOIN nx ON nx.doc_id = g.doc_id AND nx.page = g.first_page)"""


@query("find_sections", f"WITH {SECTIONS_SQL} SELECT doc_id, page, line, section_no, section_id, page_start FROM se")
def find_sections(spark, d):
    return extraction.find_sections(extraction.page_lines(_pages(spark, d))).drop("line_idx")


@query("section_page_start", f"WITH {SECTIONS_SQL} SELECT DISTINCT doc_id, section_no, section_id, page_start FROM se")
def section_page_start(spark, d):
    return find_sections(spark, d).select("doc_id", "section_no", "section_id", "page_start").distinct()


UNITS_OF_SECTION = rf"""{SECTIONS_SQL},
kd AS (SELECT *, CASE WHEN regexp_matches(line, '^\(\d+\)') THEN 'subsection' WHEN regexp_matches(line, '^Provided(\s+further)?\s+that\b', 'i') THEN 'proviso' WHEN regexp_matches(line, '^Explanation', 'i') THEN 'explanation'
  WHEN regexp_matches(line, '^Illustrations?\.?$', 'i') THEN 'illustrations_header' END AS kind FROM se WHERE NOT regexp_matches(line, '^CHAPTER\b', 'i')),
un AS (SELECT *, count(kind) OVER (PARTITION BY doc_id, section_no ORDER BY page, y0) AS unit_no FROM kd),
ug AS (SELECT doc_id, section_no, section_id, page_start, unit_no, max(kind) AS kind, string_agg(line, ' ' ORDER BY page, y0) AS text, bool_or(kind IS NULL AND regexp_matches(line, '^\(([a-z]|[ivxlcdm]+)\)', 'i')) AS items FROM un GROUP BY 1, 2, 3, 4, 5),
ul AS (SELECT doc_id, section_no, section_id, page_start, unit_no, CASE kind WHEN 'subsection' THEN regexp_extract(text, '^\((\d+)\)', 1) WHEN 'proviso' THEN 'provided_that' WHEN 'explanation' THEN 'explanation' WHEN 'illustrations_header' THEN 'illustrations' ELSE '' END AS unit_label,
  CASE WHEN kind = 'illustrations_header' AND items THEN 'illustration' ELSE coalesce(kind, 'section_body') END AS unit_type, text FROM ug)"""


@query("split_units", f"WITH {UNITS_OF_SECTION} SELECT * FROM ul")
def split_units(spark, d):
    return extraction.split_units(extraction.find_sections(extraction.page_lines(_pages(spark, d))))


CLEANED = r"regexp_replace(regexp_replace(text, '\s+([;,.:)])', '\1', 'g'), '([(\[])\s+', '\1', 'g')"
CANDIDATES = f"""{UNITS_OF_SECTION}, cd AS (SELECT *, {CLEANED} AS source_text, row_number() OVER (ORDER BY doc_id, section_no, unit_no) AS no FROM ul)
SELECT concat('SL', lpad(CAST(no AS VARCHAR), CAST(greatest(5, length(CAST(no AS VARCHAR))) AS INT), '0')) AS example_id, 'Model Act' AS act_name, concat('Section ', section_id) AS section_id, unit_label, unit_type, page_start, source_text,
  CAST(regexp_matches(source_text, '\\b(shall|may|must)\\b', 'i') AS INT) AS has_modal, CAST(regexp_matches(source_text, '\\b(if|unless|provided that|provided further that|except|notwithstanding)\\b', 'i') AS INT) AS has_exception,
  CAST(regexp_matches(source_text, '\\b\\d+\\b') AS INT) AS has_numbers, CAST(regexp_matches(lower(source_text), '{"|".join(legal.ROLES)}') AS INT) AS has_roles,
  CAST(regexp_matches(lower(source_text), '\\b({"|".join(legal.CROSS_REFERENCES)})\\b') AS INT) AS needs_context,
  CAST(length(source_text) < 35 OR (regexp_matches(source_text, '[:;]$') AND length(source_text) < 120) AS INT) AS bad_fragment, '' AS simple_text, '' AS split, '' AS notes FROM cd"""


def _candidates(spark, d):
    return extraction.build_candidates(_pages(spark, d), "Model Act")


@query("build_candidates", f"WITH {CANDIDATES}")
def build_candidates(spark, d):
    return _candidates(spark, d)


# -- sources and sinks: written to the shared folder and read back -----------


@query("read_nli_csv", f"SELECT nli_id, split, premise, hypothesis, gold_label, error_type, 'all' AS dataset FROM ({fx.PAIRS}) p")
def read_nli_csv(spark, d):
    path = fresh_path(spark, "pairs")
    derive(spark, d, fx.PAIRS).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.read_nli(spark, path, "all").select("nli_id", "split", "premise", "hypothesis", "gold_label", "error_type", "dataset")


@query("read_eval_csv", f"SELECT example_id, model, source_text, simple_text FROM ({fx.REWRITES}) r")
def read_eval_csv(spark, d):
    path = fresh_path(spark, "eval")
    derive(spark, d, fx.REWRITES).select("example_id", "model", "source_text", "simple_text").write.option("header", True).option("escape", '"').csv(path)
    return tables.read_eval(spark, path)


@query("write_pages", f"WITH {PAGES_SQL} SELECT * FROM pg")
def write_pages(spark, d):
    tables.write_pages(_pages(spark, d), path := fresh_path(spark, "pages"))
    return spark.read.parquet(path)


@query("write_candidates", f"WITH {CANDIDATES}")
def write_candidates(spark, d):
    tables.write_candidates(_candidates(spark, d), path := fresh_path(spark, "candidates"))
    return spark.read.parquet(path)


@query("write_predictions", f"SELECT * FROM ({fx.PREDICTIONS}) p")
def write_predictions(spark, d):
    tables.write_predictions(derive(spark, d, fx.PREDICTIONS), path := fresh_path(spark, "predictions"))
    return spark.read.parquet(path)


@query("write_confusion", f"SELECT model, dataset, gold_label_id, {', '.join(SAID)} FROM ({fx.PREDICTIONS}) p GROUP BY 1, 2, 3")
def write_confusion(spark, d):
    tables.write_confusion(confusion_matrix(spark, d), path := fresh_path(spark, "confusion"))
    return spark.read.option("header", True).schema("model string, gold_label_id int, pred_contradiction long, pred_entailment long, pred_neutral long, dataset string").csv(path)


@query("write_summary", f"SELECT model, dataset, n_rows, accuracy, macro_f1 FROM ({_metrics_sql('model, dataset')}) m")
def write_summary(spark, d):
    tables.write_summary(classification_metrics(spark, d).select("model", "dataset", "n_rows", "accuracy", "macro_f1"), path := fresh_path(spark, "summary"))
    return spark.read.option("header", True).schema("model string, dataset string, n_rows long, accuracy double, macro_f1 double").csv(path)


@query("write_overlength", f"SELECT conv_id, turn, {LEN} AS n_tokens FROM ({DOC_PAIRS}) p WHERE {LEN} > 60")
def write_overlength(spark, d):
    _, over = scoring.length_gate(scoring.pair_length(derive(spark, d, DOC_PAIRS)), 60)
    tables.write_overlength(over.select("conv_id", "turn", "n_tokens"), path := fresh_path(spark, "overlength"))
    return spark.read.parquet(path)


@query("write_v2_splits", f"{KEYED} SELECT {PAIR_COLS} FROM p WHERE split IN ('train', 'external') OR k NOT IN (SELECT k FROM t)")
def write_v2_splits(spark, d):
    p = derive(spark, d, fx.PAIRS)
    train = p.where("split = 'train'")
    splits = {"train": train, "external": p.where("split = 'external'")} | {s: curation.remove_leakage(p.where(c("split") == s), train) for s in ("internal", "validation")}
    tables.write_v2_splits(splits, path := fresh_path(spark, "splits"))
    return spark.read.schema(p.schema).parquet(*[f"{path}/{s}" for s in splits])


@query("write_run_log", f"SELECT run_id, event_type, span_status, CAST(CAST(ts AS DATE) AS VARCHAR) AS run_date FROM ({fx.RUNS}) r")
def write_run_log(spark, d):
    runs = derive(spark, d, fx.RUNS)
    path = fresh_path(spark, "runs")
    for half in (0, 1, 1):  # a set that is written again is logged once
        tables.write_runs(runs.where(F.crc32(c("run_id").cast("binary")) % 2 == half), path, f"half {half}")
    kept = run_log.read_runs(spark, path, "run_id string, event_type string, span_status string, run_date date")
    return kept.withColumn("run_date", c("run_date").cast("string"))


@query(
    "resume_missing",
    f"""SELECT example_id, model, CASE WHEN length(output) % 3 = 0 THEN 'done' ELSE 'todo' END AS state FROM ({fx.REWRITES}) r""",
)
def resume_missing(spark, d):
    r = derive(spark, d, fx.REWRITES).withColumn("key", F.concat_ws("/", "example_id", "model"))
    done = r.select("key", F.when(F.length("output") % 3 == 0, c("output")).when(F.length("output") % 3 == 1, " ").alias("output"))
    todo, had = tables.resume_missing(r.drop("output"), done, "key", "output")
    return todo.select("example_id", "model", F.lit("todo").alias("state")).unionByName(had.select("example_id", "model", F.lit("done").alias("state")))


@query(
    "with_checkpoint",
    "WITH k AS (SELECT o_orderkey AS n, CASE x.name WHEN 'shifted' THEN o_orderkey + 1 WHEN 'doubled' THEN o_orderkey - o_orderkey % 2 ELSE o_orderkey END AS m, x.name AS checkpoint FROM orders, (VALUES ('permuted'), ('short'), ('shifted'), ('doubled')) x(name)), "
    "d AS (SELECT * FROM k WHERE checkpoint <> 'short' OR n % 10 <> 3) "
    "SELECT checkpoint, NOT EXISTS ((SELECT o_orderkey FROM orders EXCEPT ALL SELECT m FROM d WHERE d.checkpoint = c.name) UNION ALL (SELECT m FROM d WHERE d.checkpoint = c.name EXCEPT ALL SELECT o_orderkey FROM orders)) AS fits "
    "FROM (SELECT DISTINCT checkpoint, checkpoint AS name FROM k) c",
)
def with_checkpoint(spark, d):
    """Which of four written checkpoints belong to the orders: the rows in another order, some missing, other keys, keys doubled."""
    n = c("o_orderkey")
    orders = spark.read.parquet(f"{d}/orders.parquet").select(n.alias("key"), F.lit("done").alias("output"))
    cases = {
        "permuted": orders.orderBy(F.xxhash64("key")), "short": orders.where("key % 10 <> 3"), "shifted": orders.withColumn("key", c("key") + 1),
        "doubled": orders.withColumn("key", c("key") - c("key") % 2),
    }
    rows = []
    for name, done in cases.items():
        tables.write_checkpoint(done, path := fresh_path(spark, "checkpoint"), "key")
        rows.append((name, tables.checkpoint_fits(orders, path, "key")))
    return spark.createDataFrame(rows, "checkpoint string, fits boolean")


# -- streaming ----------------------------------------------------------------


@query("stream_verify", f"{LINK_SQL} SELECT provision_id, claim_id, evidence_span_id, evidence_method, evidence_ambiguity FROM linked")
def stream_verify(spark, d):
    claims_of = derive(spark, d, fx.SPARK_CLAIM_ROWS).groupBy("provision_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "claim_text"))).alias("claims"))
    rows = derive(spark, d, fx.PROVISIONS).join(derive(spark, d, fx.SIMPLIFIED), "provision_id").join(claims_of, "provision_id")
    base = fresh_path(spark, "stream")
    rows.write.json(f"{base}/in")
    streaming.stream_verify(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("provision_id", "claim_id", "evidence_span_id", "evidence_method", "evidence_ambiguity")


@query("stream_meet", f"{LINK_SQL} SELECT provision_id, claim_id, evidence_span_id, evidence_method, evidence_ambiguity, 'matched' AS met FROM linked")
def stream_meet(spark, d):
    """Claims before and after their provision, in two runs of one stream."""
    base = fresh_path(spark, "meet")
    early = F.crc32(c("provision_id").cast("binary")) % 2 == 0
    sides = {"p": derive(spark, d, fx.PROVISIONS).select("provision_id", "text"), "c": derive(spark, d, fx.SPARK_CLAIM_ROWS)}
    for now in ({"p": early, "c": ~early}, {"p": ~early, "c": early}):
        for side, rows in now.items():
            sides[side].where(rows).write.mode("append").json(f"{base}/{side}")
        meet.stream_meet(spark, f"{base}/p", f"{base}/c", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("provision_id", "claim_id", "evidence_span_id", "evidence_method", "evidence_ambiguity", "met")
