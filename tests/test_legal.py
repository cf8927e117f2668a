from pyspark.sql import functions as F

from clauseloom.functions import legal, text
from clauseloom.operators import claims, linking, spans


def values(spark, rows, *cols):
    names = [f"c{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [tuple(r)[1:] if len(cols) > 1 else r[1] for r in df.orderBy("i").select("i", *cols).orderBy("i").collect()]


def test_numbers(spark):
    cases = {
        "a fine of 5,000 rupees": ["5000"], "3.50 percent": ["3.5"], "between 18 and 21 years, fined 5,000 rupees": ["18", "21", "5000"], "nothing": [],
        "six months, one year, twenty-five days, the first offence, or 6 units": ["1", "25", "6"], "007 and 0.00": ["0", "7"], "hundred": [], "Twentieth": ["20"],
    }
    assert values(spark, [(k,) for k in cases], legal.extract_numbers(F.col("c0"))) == list(cases.values())
    words = [("one",), ("twenty-one",), ("hundred",), ("twentieth",)]
    assert values(spark, words, legal.word_number(F.col("c0"))) == [None, "21", None, "20"]


def test_modality_and_tokens(spark):
    rows = [("You shall not go",), ("You cannot go",), ("He can not go",), ("Shall report and shall not tell",), ("may go",), ("",)]
    o, p, x = legal.OBLIGATION, legal.PERMISSION, legal.PROHIBITION
    assert values(spark, rows, legal.modality_tags(F.col("c0"))) == [[x], [x], [x], [o, x], [p], []]
    assert values(spark, [("extend to six months",)], legal.lexical_tokens(F.col("c0")), legal.number_tokens(F.col("c0"))) == [(["extend", "months"], ["6"])]
    pairs = [("you may go", "you must not go"), ("you must go", "you must not go"), ("may", "may")]
    assert values(spark, pairs, legal.modal_conflict(F.col("c0"), F.col("c1"))) == [True, False, False]


def test_text_functions(spark):
    assert values(spark, [(" \n a  b \t",), (None,)], text.norm_text(F.col("c0"))) == ["a b", None]
    assert values(spark, [("Here is a simpler version: Pay now.",), ("Pay: now",)], text.strip_preamble(F.col("c0"))) == ["Pay now.", "Pay: now"]
    assert values(spark, [("a ( b ) , c",), ("‘x’ ￾",)], text.clean_unit_text(F.col("c0"))) == ["a (b), c", "'x’"]
    assert values(spark, [("Pay it; and go, but wait",)], text.clause_split(F.col("c0"))) == [["Pay it", "and go", "wait"]]


def link(spark, provision, texts, with_source=True):
    p = spark.createDataFrame([("p", provision)], "provision_id string, text string")
    units = spans.evidence_units(spans.explode_spans(p.withColumn("spans", spans.make_spans("text"))))
    c = spark.createDataFrame([("p", f"C{i}", t, ["w"]) for i, t in enumerate(texts, 1)], "provision_id string, claim_id string, claim_text string, extraction_warnings array<string>")
    return {r.claim_id: r for r in linking.link_claims(c, units, p if with_source else None).collect()}


def test_links(spark):
    text = "Anyone who digs here shall pay five coins in full; or, if at night, must leave for six months."
    got = link(spark, text, ["The person must pay five coins.", "Whoever digs at night must leave for 6 months.", "Bananas."])
    assert [got[k].evidence_span_ids for k in ("C1", "C2", "C3")] == [["P1"], ["P1", "P2"], []]
    assert got["C3"].evidence_method == "full_provision" and got["C3"].evidence_text == text and not got["C3"].evidence_ambiguity
    assert got["C1"].extraction_warnings == ["w"]
    same = "The yearly fee of this place is ten coins. The yearly fee of this place is ten coins."
    tie, none = link(spark, same, ["The yearly fee is ten coins"]), link(spark, same, ["The yearly fee is ten coins"], False)
    assert tie["C1"].evidence_method == "full_provision_ambiguity_fallback" and tie["C1"].evidence_ambiguity and tie["C1"].evidence_score == 0
    assert none["C1"].evidence_text is None and none["C1"].evidence_ambiguity
    assert link(spark, "the penalty was 18", ["the penalty is 18"])["C1"].evidence_score == 5


def test_claims(spark):
    good = '```json\n[{"claim_id": "x", "claim_text": " A "}, {"claim_id": "y", "claim_text": "A"}, {"claim_id": "z", "claim_text": "B"}]\n```'
    bad = [
        '[{"claim_id": "C1", "claim_text": null}]', '[{"claim_id": "C1", "claim_text": ""}]', '[{"claim_id": "C1", "claim_text": "  "}]', '[{"claim_id": "C1", "claim_text": 42}]',
        '[{"claim_id": "C1", "claim_text": 3.5}]', '[{"claim_id": "C1", "claim_text": ["a"]}]', '[{"claim_id": "C1", "claim_text": {"a": 1}}]', '[{"claim_id": 1, "claim_text": "a"}]',
        '[{"claim_id": "C1"}]', '{"claim_id": "C1", "claim_text": "a"}', "[]", "[1]", "not json", '[{"claim_id": "C1", "claim_text": "a"}, {"claim_id": "C2"}]',
    ]
    got = values(spark, [(good,), *((b,) for b in bad), (None,)], claims.parse_claims(F.col("c0")), claims.dedup_claims(claims.parse_claims(F.col("c0"))))
    assert [(x.claim_id, x.claim_text) for x in got[0][0]] == [("C1", "A"), ("C2", "A"), ("C3", "B")]
    assert [(x.claim_id, x.claim_text) for x in got[0][1]] == [("C1", "A"), ("C2", "B")]
    assert all(g == (None, None) for g in got[1:])
    df = spark.createDataFrame([("no", t) for t in ("Fine shall be paid; and jail may follow.", "One is here. Two is there.", "whole")], "raw string, t string")
    out = claims.claims_with_fallback(df, "raw", "t").select("claim_method", F.size("claims")).collect()
    assert [tuple(r) for r in out] == [("clause_splitter", 2), ("sentence_splitter", 2), ("whole_text_claim", 1)]
    pairs = [("pay 50,000", "pay 5,000"), ("blue moon", "red sun"), ("tenants may leave", "tenants must not leave"), ("he pays", "he pays 5")]
    assert values(spark, pairs, claims.extraction_warnings(F.col("c0"), F.col("c1"))) == [["unsupported_number"], ["zero_lexical_overlap"], ["clear_modal_conflict"], []]
    warned = linking.verification_warnings(F.col("c0"), F.col("c1"), F.lit("supported"))
    assert values(spark, [("5 coins", "6 coins"), ("must not go", "may go"), ("5", "none")], warned) == [["numerical_conflict"], ["clear_modal_conflict"], []]


def test_warnings_compute_numbers_and_tags_once(spark):
    df = spark.createDataFrame([("shall pay 5 coins", "may not pay 6 coins")], "e string, c string")
    w = df.select(linking.verification_warnings(F.col("e"), F.col("c"), F.lit("supported")).alias("w"))
    plan = w._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cannot") == 2 and plan.count(legal.NUMBER) == 2
    assert w.first().w == ["numerical_conflict"]
