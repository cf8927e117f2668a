from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauseloom.operators import spans as S

CASES = {
    "branch": (
        "Whoever deserts shall be punished with a fine of ten coins; or, if the desertion is repeated, with arrest.",
        ["Whoever deserts shall be punished with a fine of ten coins;", "or, if the desertion is repeated, with arrest."],
    ),
    "three": ("Anyone who digs here pays five coins in full; if at night, ten; and if armed, twenty.", ["Anyone who digs here pays five coins in full;", "if at night, ten;", "and if armed, twenty."]),
    "list": ("The following acts are wrong— (a) theft; (b) harm; (c) arson.", ["The following acts are wrong—", "(a) theft;", "(b) harm;", "(c) arson."]),
    "inline": ("A notice under subsection (1) or paragraph (b) shall be in writing.", ["A notice under subsection (1) or paragraph (b) shall be in writing."]),
    "subsections": ("(1) The court may hear anyone it likes.\n(2) The clerk shall keep a written record.", ["(1) The court may hear anyone it likes.", "(2) The clerk shall keep a written record."]),
    "proviso": ("A shop must close at nine every day. Provided that the mayor may allow ten.", ["A shop must close at nine every day.", "Provided that the mayor may allow ten."]),
    "header": ("A shop must close at nine every day.\nExplanation\nWhere the shop is a kiosk, ten counts as nine.", ["A shop must close at nine every day.", "Explanation Where the shop is a kiosk, ten counts as nine."]),
    "hyphen": ("The pre-(a) wording stays in force for ever and ever.", ["The pre-(a) wording stays in force for ever and ever."]),
    "bare semicolon": ("The owner shall pay the fee; the tenant shall pay the rest.", ["The owner shall pay the fee; the tenant shall pay the rest."]),
    "short tail": ("The owner shall pay the whole fee at once. He may.", ["The owner shall pay the whole fee at once. He may."]),
    "empty": ("", []),
}


def test_cases():
    for name, (text, want) in CASES.items():
        assert [t for _, _, t in S.split_provision(text)] == want, name


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. ;\n(1)AOrif,Provided that—", max_size=120))
def test_offsets_stay_inside_and_in_order(text):
    got = S.split_provision(text)
    assert all(0 <= a < b <= len(text) for a, b, _ in got)
    assert all(x[0] < y[0] for x, y in zip(got, got[1:], strict=False))
    assert "".join("".join(t.split()) for _, _, t in got) == "".join(text.split())


def test_sentence_spans_and_fallback(spark):
    texts = ["One goes first. Two goes second.  (Three) ends.", "no end", "   ", ""]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "provision_id string, text string").orderBy("provision_id")
    got = [[(x.text, x.start, x.end) for x in r[0]] for r in df.select(S.sentence_spans(F.col("text"))).collect()]
    assert got == [[("One goes first.", 0, 15), ("Two goes second.", 16, 32), ("(Three) ends.", 34, 47)], [("no end", 0, 6)], [], []]
    back = {r.provision_id: (r.span_status, r.span_method) for r in S.spans_with_fallback(df).collect()}
    assert back == {"0": ("success", None), "1": ("success", None), "2": ("failed", None), "3": ("failed", None)}


def test_span_faults(spark):
    one = lambda **k: {"span_idx": 1, "span_id": "P1", "text": "x", "start": 0, "end": 1} | k
    rows = [
        ([], "no_spans"), ([one(span_id="")], "missing_id"), ([one(), one(span_idx=2)], "duplicate_id"), ([one(text=" ")], "empty_text"),
        ([one(start=1)], "invalid_offsets"), ([one(end=99)], "end_out_of_bounds"), ([one()], None), ([one(end=9), one(span_idx=2)], "end_out_of_bounds"),
    ]
    df = spark.createDataFrame([(i, s, "abc") for i, (s, _) in enumerate(rows)], "i int, spans array<struct<span_idx:int,span_id:string,text:string,start:int,end:int>>, text string")
    got = [r[0] for r in df.orderBy("i").select(S.spans_reason(F.col("spans"), F.col("text"))).collect()]
    assert got == [w for _, w in rows]


def test_units_join_the_nearest_head(spark):
    def units(*texts):
        df = spark.createDataFrame([("p", i, f"P{i}", t, 0, 1) for i, t in enumerate(texts, 1)], "provision_id string, span_idx int, span_id string, text string, start int, end int")
        return [(r.ids, r.premise) for r in S.evidence_units(df).orderBy("unit_idx").collect()]

    assert units("A head", "or, if so", "(b) more", "Next", "(iv) last") == [
        (["P1"], "A head"), (["P1", "P2"], "A head or, if so"), (["P1", "P3"], "A head (b) more"), (["P4"], "Next"), (["P4", "P5"], "Next (iv) last"),
    ]
    assert units("(a) first", "(1) numbered") == [(["P1"], "(a) first"), (["P2"], "(1) numbered")]


def test_sentences_are_cut_only_where_structure_fails(spark):
    df = spark.createDataFrame([("a", "One is here. Two is there.")], "provision_id string, text string")
    plan = S.spans_with_fallback(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN isnotnull(_r1" in plan
    assert S.spans_with_fallback(df).first().span_status == "success"
