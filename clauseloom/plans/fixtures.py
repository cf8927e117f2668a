"""Inputs derived from the given tables by expressions that Spark and DuckDB both read.

The given documents hold no statute language, so provisions, claims, pairs,
predictions and lines are templates over orders: n is the order's key, m and f
numbers made of it. Each template is one text, used by the query and by its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = "SELECT o_orderkey AS n, o_orderkey % 12 + 2 AS m, CAST(o_orderkey % 12 + 2 AS STRING) AS ms, CAST(o_orderkey % 12 + 3 AS STRING) AS ms1, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS fs FROM orders"

#: By n % 6: the spans of a provision, and its claims.
PARTS = {
    0: ["concat('Whoever commits mischief shall be punished with a fine of ', fs, ' rupees;')", "concat('or, if the offence is repeated, with imprisonment which may extend to ', ms, ' months.')"],
    1: ["'(1) The Court may order costs of the suit.'", "concat('(2) The Magistrate shall decide the matter within ', ms, ' days.')"],
    2: ["'The following are offences—'", "'(a) theft of goods;'", "concat('(b) harm of ', ms, ' animals;')", "'(c) arson.'"],
    3: ["concat('Every application shall be made within ', ms, ' days.')", "concat('Provided that the Court may extend the period by ', ms1, ' days.')"],
    4: ["concat('The annual licence fee payable is ', fs, ' rupees.')", "concat('The annual licence fee payable is ', fs, ' rupees.')"],
    5: ["concat('The officer shall not disclose the record of ', ms, ' persons.')"],
}
CLAIMS = {
    0: ["concat('The offender must be punished with a fine of ', fs, ' rupees.')", "concat('A repeated offence may lead to imprisonment of ', ms, ' months.')"],
    1: ["'The Court may order costs.'", "concat('The Magistrate must decide within ', ms, ' days.')"],
    2: ["'Theft of goods is punished.'", "concat('Harm of ', ms, ' animals is punished.')"],
    3: ["concat('An application shall be made within ', ms, ' days.')", "concat('The Court may extend the period by ', ms1, ' days.')"],
    4: ["concat('The annual licence fee payable is ', fs, ' rupees.')", "'Bicycles need helmets.'"],
    5: ["concat('The officer may disclose the record of ', ms, ' persons.')", "concat('The officer shall not disclose the record of ', ms1, ' persons.')"],
}


def _case(by_shape: dict[int, str]) -> str:
    return "CASE n % 6 " + " ".join(f"WHEN {k} THEN {v}" for k, v in by_shape.items()) + " END"


_ID = "concat('o', CAST(n AS STRING)) AS provision_id"
PROVISIONS = f"SELECT {_ID}, 'Model Act' AS act_name, {_case({k: 'concat_ws(chr(32), ' + ', '.join(p) + ')' for k, p in PARTS.items()})} AS text FROM ({BASE}) b"
SPANS = " UNION ALL ".join(
    f"SELECT {_ID}, {i + 1} AS span_idx, 'P{i + 1}' AS span_id, {p} AS text, "
    f"{' + '.join(['0', *(f'length({q}) + 1' for q in parts[:i])])} AS start, {' + '.join(['0', *(f'length({q}) + 1' for q in parts[:i]), f'length({p})'])} AS \"end\" FROM ({BASE}) b WHERE n % 6 = {k}"
    for k, parts in PARTS.items()
    for i, p in enumerate(parts)
)
CLAIM_ROWS = " UNION ALL ".join(
    f"SELECT {_ID}, 'C{i + 1}' AS claim_id, {c} AS claim_text FROM ({BASE}) b WHERE n % 6 = {k}" for k, cs in CLAIMS.items() for i, c in enumerate(cs)
)
#: The same rows for Spark, by one scan.
SPARK_CLAIM_ROWS = f"SELECT {_ID}, inline_outer({_case({k: 'array(' + ', '.join(f"named_struct('claim_id', 'C{i + 1}', 'claim_text', {c})" for i, c in enumerate(cs)) + ')' for k, cs in CLAIMS.items()})}) FROM ({BASE}) b"
SIMPLIFIED = f"SELECT {_ID}, {_case({k: 'concat_ws(chr(32), ' + ', '.join(c) + ')' for k, c in CLAIMS.items()})} AS simplified_text FROM ({BASE}) b"

#: What a simplifier and a claim extractor answer: some failures, some answers that are no JSON. Of these, texts of
#: clauses, of sentences, and of one sentence only, so that each way to claims is taken.
ONE_CLAIM, CLAUSES = "n % 15 = 0", "n % 10 = 5"
RESPONSES = (
    f"SELECT {_ID}, CASE WHEN n % 29 = 0 THEN NULL WHEN {ONE_CLAIM} THEN {_case({k: c[0] for k, c in CLAIMS.items()})} "
    f"ELSE {_case({k: f'concat_ws(CASE WHEN {CLAUSES} THEN chr(59) ELSE chr(32) END, ' + ', '.join(c) + ')' for k, c in CLAIMS.items()})} END AS simplified_text, "
    "CASE WHEN n % 29 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN n % 29 = 0 THEN 'TimeoutError' END AS error, CASE WHEN n % 5 = 0 THEN 'no json' ELSE "
    + _case({k: "concat('[', " + ", ',', ".join(f"""'{{"claim_id": "x", "claim_text": "', {t}, '"}}'""" for t in c) + ", ']')" for k, c in CLAIMS.items()})
    + f" END AS raw FROM ({BASE}) b"
)

#: Labelled pairs: names, ids and unusable labels mixed; texts that repeat in other case and spacing.
PAIRS = """
SELECT concat('x', CAST(o_orderkey - CASE WHEN o_orderkey % 97 = 1 THEN 1 ELSE 0 END AS STRING)) AS nli_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'internal' WHEN 1 THEN 'external' WHEN 2 THEN 'validation' ELSE 'train' END AS split,
  CASE WHEN o_orderkey % 211 = 0 THEN '  ' WHEN o_orderkey % 2 = 0 THEN concat('  RULE  ', CAST(o_custkey % 400 AS STRING), ' applies ') ELSE concat('Rule ', CAST(o_custkey % 400 AS STRING), ' applies') END AS premise,
  concat('It costs ', CAST(o_orderkey % 9 AS STRING), ' coins') AS hypothesis,
  CASE WHEN o_orderkey % 101 = 0 THEN '1.5' ELSE CASE o_orderkey % 7 WHEN 0 THEN ' Contradiction ' WHEN 1 THEN 'entailment' WHEN 2 THEN '1' WHEN 3 THEN '2.0' WHEN 4 THEN 'NEUTRAL' WHEN 5 THEN '0' ELSE '1.0' END END AS gold_label,
  CASE o_orderkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'modality' ELSE NULL END AS error_type
FROM orders
"""

PREDICTIONS = """
SELECT concat('p', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS nli_id, concat('m', CAST(l_suppkey % 4 AS STRING)) AS model,
  CASE WHEN l_partkey % 2 = 0 THEN 'internal' ELSE 'external' END AS dataset,
  CAST(l_partkey % 3 AS INT) AS gold_label_id,
  CAST(CASE WHEN (l_orderkey + l_linenumber) % (l_suppkey % 4 + 3) = 0 THEN (l_partkey + 1 + l_linenumber % 2) % 3 ELSE l_partkey % 3 END AS INT) AS pred_label_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'modality' ELSE NULL END AS error_type
FROM lineitem
"""

#: Three logits from a vector's first components, in eighths so that both engines hold them exactly.
LOGITS = """
SELECT vec_id, concat('m', CAST(vec_id % 3 AS STRING)) AS model, round(CAST(embedding[{0}] AS DOUBLE) * 64) / 8 AS l0, round(CAST(embedding[{1}] AS DOUBLE) * 64) / 8 AS l1, round(CAST(embedding[{2}] AS DOUBLE) * 64) / 8 AS l2 FROM embeddings
"""
SPARK_LOGITS, DUCK_LOGITS = LOGITS.format(0, 1, 2), LOGITS.format(1, 2, 3)

#: Lines of statute books: one order is one line; a book has 400 keys, a page 80.
LINES = """
SELECT CAST(floor(n / 400) AS BIGINT) AS doc_id, CAST(floor((n % 400) / 80) AS INT) + 1 AS page, CAST(n % 80 AS INT) AS line_no, CASE n % 11
  WHEN 0 THEN concat(CAST(n % 600 AS STRING), '. Punishment for offence ', CAST(n % 7 AS STRING))
  WHEN 1 THEN concat('(', CAST(n % 5 + 1 AS STRING), ') Whoever offends shall pay ', ms, ' coins , and')
  WHEN 2 THEN concat('the court may order ( ', fs, ' ) days if needed')
  WHEN 3 THEN 'Provided that no person under this section is bound;'
  WHEN 4 THEN 'Explanation 1.- A child is a person'
  WHEN 5 THEN 'Illustrations'
  WHEN 6 THEN '(a) A takes the goods of B'
  WHEN 7 THEN '[ 12 of 1887 ]'
  WHEN 8 THEN 'CHAPTER IV'
  WHEN 9 THEN concat('s. ', ms)
  ELSE 'Provided further that the   officer is told:' END AS text,
  CASE WHEN n % 11 = 9 THEN 20.0 ELSE 150.0 END AS x0, CAST(n % 80 AS DOUBLE) * 10 AS y0
FROM (SELECT o_orderkey AS n, CAST(o_orderkey % 12 + 2 AS STRING) AS ms, CAST(o_orderkey % 30 AS STRING) AS fs FROM orders) b
"""

#: What the talking model says first; a preamble ends at the first line's first colon, so the last two are none by themselves.
TALKS = ("Here is the simplified version: ", "Certainly! Here it is: ", "Plain English: ", "Surely the rule: ", "Sure! ", "Note: ")
TALK = "CASE conv_id % 6 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TALKS)) + " END"

#: Rewrites of question and answer turns by three models: a copy, a cut, and one with a preamble.
REWRITES = " UNION ALL ".join(
    f"SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS example_id, '{model}' AS model, text AS source_text, lower(text) AS simple_text, "
    f"{output} AS output, CAST(conv_id % 2 AS INT) AS has_exception FROM conversations"
    for model, output in (("copy", "text || ' '"), ("cut", "substr(text, 1, 60)"), ("talk", f"({TALK}) || text"))
)

EPOCHS = """
SELECT concat('r', CAST(c_nationkey AS STRING)) AS run, c_custkey * 10 AS step, CAST(c_custkey % 41 AS DOUBLE) / 64 AS eval_macro_f1 FROM customer
"""

RUNS = """
SELECT concat('e', CAST(event_id AS STRING)) AS run_id, ts, event_type,
  CASE WHEN event_id % 19 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'fallback' ELSE 'success' END AS span_status,
  CASE WHEN event_id % 23 = 0 THEN 'failed' ELSE 'success' END AS simplify_status,
  CASE WHEN event_id % 5 = 0 THEN 'fallback' ELSE 'success' END AS claim_status, concat('text ', CAST(event_id AS STRING)) AS simplified_text
FROM events
"""
RUN_CLAIMS = " UNION ALL ".join(
    f"""
SELECT concat('e', CAST(event_id AS STRING)) AS run_id, concat('C', '{k}') AS claim_id,
  CASE WHEN (event_id + {k}) % 31 = 0 THEN NULL ELSE concat('evidence ', '{k}') END AS evidence_text,
  CASE WHEN (event_id + {k}) % 31 = 0 THEN NULL WHEN (event_id + {k}) % 13 = 0 THEN 'full_provision' WHEN (event_id + {k}) % 17 = 0 THEN 'full_provision_ambiguity_fallback' ELSE 'lexical_overlap' END AS evidence_method,
  (event_id + {k}) % 29 = 0 AS evidence_ambiguity,
  CASE WHEN (event_id + {k}) % 37 = 0 THEN 'nli_input_too_long' WHEN (event_id + {k}) % 31 = 0 THEN 'no_evidence' ELSE NULL END AS verification_reason,
  CASE WHEN (event_id * {k}) % 41 = 1 THEN 'unsupported_number' WHEN (event_id * {k}) % 41 = 2 THEN 'zero_lexical_overlap' ELSE NULL END AS extraction_warning,
  CASE WHEN (event_id * {k}) % 43 = 1 THEN 'clear_modal_conflict' ELSE NULL END AS verification_warning
FROM events WHERE event_id % 10 <> 0
"""
    for k in (1, 2, 3)
)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores where it is read as fewer partitions: a small file is one, and work on its rows costs more than moving them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of a template over the tables of one folder that it names."""
    tables = ("orders", "lineitem", "customer", "conversations", "events", "embeddings", "documents", "labels")
    named = {t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in tables if f"FROM {t}" in sql}
    text = sql.replace('AS "end"', "AS `end`").replace("{", "{{").replace("}", "}}")  # named tables are put in by format
    for t in named:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **named)
