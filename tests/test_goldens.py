"""Units and links of whole provisions, published metrics, stems, preambles: results that must hold to the letter."""

import pytest
from pyspark.sql import functions as F

from clauseloom.functions import legal, text
from clauseloom.operators import evaluation, linking, rewrites, scoring, spans, status, verification
from clauseloom.sources import run_log

#: id: (provision, {claim: expected span ids}).
CASES = {
    "inline": ("Any person who is found begging commits an offence under subsection (1) of this section.", {"Begging is an offence.": ["P1"]}),
    "provided": (
        "Every application shall be lodged within thirty days.\nProvided that the Court may extend that period by ten days.",
        {"An application must be lodged within thirty days.": ["P1"], "The Court may extend the period by ten days.": ["P2"]},
    ),
    "numbered": (
        "(1) The owner shall register the vessel.\n(2) The master shall keep a log of each voyage.", {"The owner must register the vessel.": ["P1"], "The master must keep a log.": ["P2"]},
    ),
    "list": (
        "The following are offences—\n(a) theft of goods;\n(b) harm of animals;\n(c) arson of dwellings.",
        {"Theft of goods is listed.": ["P1", "P2"], "Harm of animals is listed.": ["P1", "P3"], "Arson of dwellings is listed.": ["P1", "P4"]},
    ),
    "branch": (
        "Whoever hides shall be liable to a fine of 500 rupees; or, if the summons was served by a court, to imprisonment for six months.",
        {"A person who hides pays 500 rupees.": ["P1"], "Where a court served the summons, imprisonment is six months.": ["P1", "P2"]},
    ),
}


def test_units_and_links(spark):
    p = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "provision_id string, text string")
    claims = spark.createDataFrame([(k, f"C{i}", x) for k, (_, cs) in CASES.items() for i, x in enumerate(cs)], "provision_id string, claim_id string, claim_text string")
    units = spans.evidence_units(spans.explode_spans(spans.spans_with_fallback(p)))
    got = {(r.provision_id, r.claim_text): r.evidence_span_ids for r in linking.link_claims(claims, units, p).collect()}
    assert got == {(k, x): ids for k, (_, cs) in CASES.items() for x, ids in cs.items()}


#: Published counts (rows gold, columns predicted, in the order contradiction, entailment, neutral), accuracy, macro F1, recall and F1 of contradiction.
PUBLISHED = [
    ([(85, 35, 58), (4, 349, 66), (1, 1, 210)], 0.796044, 0.757239, 0.477528, 0.634328),
    ([(139, 23, 16), (2, 381, 36), (1, 0, 211)], 0.903585, 0.894351, 0.780899, 0.86875),
    ([(100, 35, 43), (1, 378, 40), (0, 0, 212)], 0.852905, 0.820597, 0.561798, 0.716846),
    ([(84, 71, 23), (2, 375, 42), (0, 3, 209)], 0.825711, 0.786834, 0.47191, 0.636364),
    ([(71, 56, 51), (7, 253, 159), (2, 7, 203)], 0.651422, 0.629474, 0.398876, 0.550388),
    ([(145, 11, 2), (4, 360, 3), (1, 0, 196)], 0.970914, 0.967364, 0.917722, 0.941558),
    ([(135, 23, 0), (10, 357, 0), (0, 0, 197)], 0.954294, 0.948971, 0.85443, 0.891089),
    ([(122, 33, 3), (3, 364, 0), (0, 0, 197)], 0.945983, 0.935838, 0.772152, 0.862191),
    ([(132, 26, 0), (10, 357, 0), (0, 0, 197)], 0.950139, 0.944, 0.835443, 0.88),
]


def test_published_metrics(spark):
    rows = [(f"m{k}", g, p) for k, (counts, *_) in enumerate(PUBLISHED) for g, row in enumerate(counts) for p, n in enumerate(row) for _ in range(n)]
    got = evaluation.metrics(spark.createDataFrame(rows, "model string, gold_label_id int, pred_label_id int"), ["model"]).orderBy("model").collect()
    assert [(r.accuracy, r.macro_f1, r.recall_contradiction, r.f1_contradiction) for r in got] == [tuple(x[1:]) for x in PUBLISHED]


def test_published_stems():
    pairs = (
        "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan "
        "falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform "
        "radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous "
        "formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv "
        "allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt "
        "communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll"
    ).split()
    assert {a: rewrites._stem(a) for a in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2], strict=True))


def test_preambles(spark):
    said = {
        "Sure! The court may order.": "Sure! The court may order.", "Here is the rule. Stop! Now": "Here is the rule. Stop! Now", "Certainly! Here is it: X": "X", "Plain English: X": "X",
        "Surely the rule: X": "X", " here's a: b: c": "b: c", "Here is\nthe rule: X": "Here is\nthe rule: X", "The rule: X": "The rule: X",
    }
    df = spark.createDataFrame([(k,) for k in said], "t string")
    assert {r.t: r.s for r in df.withColumn("s", text.strip_preamble(F.col("t"))).collect()} == said
    assert rewrites.format_defects(df.select(F.lit("m").alias("model"), F.col("t").alias("output"))).first().n_preamble == 4


def test_unicode_spaces_and_digits(spark):
    df = spark.createDataFrame([("He shall not go.", "shall not"), ("٣ days", "x")], "a string, b string")
    rows = df.select(legal.modality_tags(F.col("a")).alias("m"), legal.extract_numbers(F.col("a")).alias("n")).collect()
    assert rows[0].m == [legal.PROHIBITION] and rows[1].n == ["٣"]


def test_a_generator_that_cannot_load_is_a_column(spark):
    def make():
        raise OSError("no weights")

    got = scoring.batch_generate(spark.createDataFrame([("a",), ("b",)], "t string"), make, "t").collect()
    assert [(r.output, r.attempts, r.gen_error) for r in got] == [(None, 0, "OSError: no weights")] * 2


def test_middle_and_last_tier_of_spans(spark, monkeypatch):
    """Where the structural tier's spans don't validate, sentences do; where these don't either, the whole text does."""
    monkeypatch.setattr(spans, "make_spans", lambda c: F.lit(None).cast(spans.SPANS))
    df = spark.createDataFrame([("a", "One rule. Two rules."), ("b", " ")], "provision_id string, text string")
    got = {r.provision_id: (r.span_status, r.span_method, len(r.spans or [])) for r in spans.spans_with_fallback(df).collect()}
    assert got == {"a": ("fallback", "sentence_splitter", 2), "b": ("failed", None, 1)}
    monkeypatch.setattr(spans, "sentence_spans", lambda c: F.lit(None).cast(spans.SPANS))
    got = {r.provision_id: (r.span_status, r.span_method) for r in spans.spans_with_fallback(df).collect()}
    assert got == {"a": ("fallback", "full_provision"), "b": ("failed", None)}


def test_whole_runs(spark, tmp_path):
    """Each stage's failure shows in the record and stops or degrades what follows."""
    p = spark.createDataFrame([(k, "The Court may order costs of the suit.") for k in ("good", "mute", "down", "talk")] + [("blank", " ")], "provision_id string, text string")
    raw = '[{"claim_id": "C1", "claim_text": "The Court may order costs."}]'
    r = spark.createDataFrame(
        [("good", "The Court may order costs.", 1, None, raw), ("mute", None, 3, "TimeoutError", None), ("down", "The Court may order costs.", 1, None, raw), ("talk", "Pay now.", 2, None, "{}"), ("blank", "x", 1, None, raw)],
        "provision_id string, simplified_text string, attempts int, error string, raw string",
    )
    score = lambda x: x.withColumns({"l0": F.lit(0.0), "l1": F.lit(5.0), "l2": F.lit(1.0), "error": F.when(F.col("provision_id") == "down", "model_unavailable")})
    got = {x.provision_id: x for x in verification.verify_provisions(p, r, score, F.col("provision_id"), "s", "n").collect()}
    s = {k: x.pipeline_status for k, x in got.items()}
    assert {k: x.overall for k, x in s.items()} == {"good": "success", "mute": "failed", "down": "partial", "talk": "partial", "blank": "failed"}
    assert (s["mute"].simplification.status, s["mute"].simplification.attempts, s["mute"].simplification.reason) == ("failed", 3, "TimeoutError")
    assert s["mute"].claim_extraction.status == s["blank"].simplification.status == "skipped" and got["blank"].claims == got["mute"].claims == []
    c = got["good"].claims[0]
    assert (c.claim_id, c.evidence_span_ids, c.verification_label, c.nli_raw_label, c.label, c.verification_reason) == ("C1", ["P1"], "supported", "entailment", "supported", None)
    assert c.label_confidence == c.verification_confidence == pytest.approx(c.nli_probabilities["entailment"]) and got["good"].provenance.claim_extraction_method == "llm"
    d = got["down"].claims[0]
    assert (d.verification_label, d.verification_reason, d.nli_probabilities, d.label_confidence) == ("unverified", "nli_model_unavailable", None, 0.0) and s["down"].nli_verification.status == "partial"
    assert s["talk"].claim_extraction.status == "fallback" and s["talk"].claim_extraction.method == "whole_text_claim"
    assert status.FULL_PROVISION and got["good"].spans[0].span_id == "P1"
    assert (got["blank"].message, got["mute"].message, got["good"].message) == (f"{status.NO_SPANS}empty_text", "TimeoutError", None)
    assert {x.pipeline_status.run_logging.status for x in got.values()} == {"skipped"}
    for path, want in ((tmp_path / "log", "success"), (tmp_path / "file", "warning")):
        (tmp_path / "file").write_text("no folder")
        rows = verification.verify_provisions(p, r, score, F.col("provision_id"), "s", "n", (str(path), "set 1")).collect()
        assert {x.pipeline_status.run_logging.status for x in rows} == {want} and {x.provision_id: x.pipeline_status.overall for x in rows} == {k: x.overall for k, x in s.items()}
    assert run_log.read_runs(spark, str(tmp_path / "log"), "provision_id string, message string").count() == 5
