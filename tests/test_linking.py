import random
import time

from pyspark.sql import functions as F

from clauseloom.operators import claims, extraction, linking

WORDS = "court officer shall may not fine order licence vessel record theft harm thirty 5 12 500 days rupees begging arson".split()


def frames(spark, claims, units):
    c = spark.createDataFrame(claims, "provision_id string, claim_id string, claim_text string")
    u = spark.createDataFrame([(p, k, f"P{k}", ["P0", f"P{k}"] if j else [f"P{k}"], f"premise {t}", t) for p, k, j, t in units], "provision_id string, unit_idx int, selected_id string, ids array<string>, premise string, own_text string")
    return c, u


def test_postings_give_the_links_of_all_pairs(spark):
    rng = random.Random(3)
    say = lambda: " ".join(rng.choices(WORDS, k=rng.randint(0, 7)))
    claims = [(f"p{p}", f"C{k}", say()) for p in range(12) for k in range(25)] + [("p0", "C99", None), ("alone", "C1", "the court"), (None, "C1", "the court")]
    units = [(f"p{p}", k, rng.random() < 0.3, say()) for p in range(12) for k in range(30)] + [("p0", 99, False, None), ("other", 1, False, "the court"), (None, 1, False, "the court")]
    units += [("p1", 100 + k, False, "court fine 500") for k in range(3)]  # equal units tie
    c, u = frames(spark, claims, units)
    rows = {few: sorted(map(str, linking.link_claims(c, u, few_pairs=few).collect())) for few in (0, 300, 10**9)}
    assert rows[0] == rows[300] == rows[10**9] and len(rows[0]) == len(claims)
    met = {r.provision_id: r for r in linking.link_claims(c, u, few_pairs=0).where("claim_id = 'C1'").collect()}
    assert met["alone"].evidence_method is None and met[None].evidence_span_id is None
    assert len({r.evidence_ambiguity for r in linking.link_claims(c, u, few_pairs=0).collect()}) == 2


def test_winner_ties_and_ranks_by_all_pairs_in_python(spark):
    claims = [("p", "C1", "The officer pays 500 rupees."), ("p", "C2", "theft and arson"), ("p", "C3", "a licence"), ("p", "C4", "nothing here matches")]
    units = [("p", 1, False, "officer pays"), ("p", 2, False, "500 and 12 rupees"), ("p", 3, True, "theft harm"), ("p", 4, False, "arson harm"), ("p", 5, False, "licence a"), ("p", 6, False, "licence b")]
    for few in (0, 10**9):
        got = {r.claim_id: (r.evidence_span_id, r.evidence_score, r.evidence_ambiguity) for r in linking.link_claims(*frames(spark, claims, units), few_pairs=few).collect()}
        # C1: the number and a word; C2: one word each, the joined unit first; C3: two units tie; C4: no unit
        assert got == {"C1": ("P2", 5, False), "C2": ("P3", 1, False), "C3": (None, 0, True), "C4": (None, 0, False)}


def test_a_hot_provision_is_no_square(spark):
    """40,000 claims and 40,000 units of one provision share three words; 1.6 billion pairs are not scored."""
    n = 40_000
    ids = spark.range(n).withColumn("t", F.concat(F.lit("the officer shall record vessel "), F.concat(F.lit("name"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")), F.lit(" after "), F.col("id") + 1000, F.lit(" days")))
    c = ids.select(F.lit("hot").alias("provision_id"), F.concat(F.lit("C"), "id").alias("claim_id"), F.col("t").alias("claim_text"))
    u = ids.select(F.lit("hot").alias("provision_id"), F.col("id").cast("int").alias("unit_idx"), F.concat(F.lit("P"), "id").alias("selected_id"), F.array(F.concat(F.lit("P"), "id")).alias("ids"), F.col("t").alias("premise"), F.col("t").alias("own_text"))
    got = linking.link_claims(c, u)
    right = F.concat(F.lit("P"), F.substring("claim_id", 2, 9)) == F.col("evidence_span_id")
    assert got.agg(F.count_if(right), F.count_if("evidence_ambiguity")).first()[:2] == (n, 0)


def plain_sections(lines, lo=1, hi=500):
    """(page, line) in order -> (page, line, section_no, section_id, page_start), by looking at the whole document."""
    opens = [k for k, (_, t) in enumerate(lines) if extraction._section_mark(t, lo, hi)]
    for no, (a, b) in enumerate(zip(opens, [*opens[1:], None], strict=False), 1):
        first = lines[a][0]
        # the next page's mark counts if it stands in front of the next section
        later = [p for p, _ in lines[a : None if b is None else b + 1] if p != first]
        for p, t in lines[a:b]:
            yield p, t, no, extraction._section_mark(lines[a][1], lo, hi), later[0] if later else None


def test_sections_of_random_documents(spark):
    rng = random.Random(8)
    kinds = ["1. One", "22A. Two", "1999. year", "600. high", "text", "", "12345678901234567890. no", "٣. three"]
    docs = {f"d{d}": [(page, rng.choice(kinds)) for page in sorted(rng.choices(range(1, 6), k=rng.randint(0, 14)))] for d in range(60)}
    rows = [(d, p, k, t) for d, lines in docs.items() for k, (p, t) in enumerate(lines)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id string, page int, line_idx int, line string").withColumn("text", F.lit("mine"))
    got = {}
    for r in extraction.find_sections(df).orderBy("doc_id", "page", "line_idx").collect():
        got.setdefault(r.doc_id, []).append((r.page, r.line, r.section_no, r.section_id, r.page_start))
    assert got == {d: rows for d, lines in docs.items() if (rows := list(plain_sections(lines)))}
    fused = extraction.section_units(df).drop("seq")
    apart = extraction.split_units(extraction.find_sections(df))
    assert sorted(map(str, fused.collect())) == sorted(map(str, apart.collect()))
    assert extraction.find_sections(df.limit(0)).collect() == extraction.section_units(df.limit(0)).collect() == []


def test_a_document_of_200000_lines(spark):
    """One section of 150,000 lines, with a page break at every 100th line, and many small ones: time grows with the lines."""
    n = 200_000
    line = F.when(F.col("id") == 0, "1. Long").when((F.col("id") >= 150_000) & (F.col("id") % 10 == 0), F.concat((F.col("id") % 500 + 1).cast("string"), F.lit(". Short"))).otherwise("words of law")
    df = spark.range(n).select(F.lit("d").alias("doc_id"), (F.col("id") / 100).cast("int").alias("page"), F.col("id").cast("int").alias("line_idx"), line.alias("line"))
    start = time.monotonic()
    rows = extraction.find_sections(df).agg(F.count(F.lit(1)), F.max("section_no"), F.count_if(F.expr("page_start = 1 and section_no = 1"))).first()
    assert time.monotonic() - start < 30
    assert tuple(rows) == (n, 5001, 150_000)


def test_costly_steps_are_computed_once(spark):
    """A response is parsed once, whatever uses its claims, and a pair's score is not computed again by a filter."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    raw = '[{"claim_id": "C1", "claim_text": " one "}, {"claim_id": "C2", "claim_text": "one"}]'
    odd = ['[{"claim_id": "C1", "claim_text": 1}]', '[{"claim_id": "C1", "claim_text": "  "}]', "[]", "{}", None]
    df = claims.claims_with_fallback(spark.createDataFrame([(raw, "x; y"), *[(o, "a; b") for o in odd], (None, None)], "raw string, t string"), "raw", "t")
    got = sorted((r.claim_method, [(x.claim_id, x.claim_text) for x in r.claims]) for r in df.collect())
    assert got == [*[("clause_splitter", [("C1", "a"), ("C2", "b")])] * 5, ("llm", [("C1", "one")]), ("whole_text_claim", [])]
    assert plan(df).lower().replace("_", "").count("parsejson") == 1
    side = lambda cols: spark.createDataFrame([], f"provision_id string, {cols}")
    c, u = side("claim_id string, c_lex array<string>, c_num array<string>"), side("unit_idx int, joined boolean, u_lex array<string>, u_num array<string>")
    assert sum("array_intersect" in line for line in plan(linking._best_of_all_pairs(c, u)).split("\n")) == 1
    said = claims.extraction_warnings(F.col("a"), F.col("b"))
    rows = spark.createDataFrame([("5 men shall not dig", "men may dig", 1), (None, "x", 2), ("x", None, 3), ("dig", "dig", 4)], "a string, b string, k int").select("k", said.alias("w")).collect()
    assert {r.k: r.w for r in rows} == {1: ["unsupported_number", "clear_modal_conflict"], 2: [], 3: [], 4: []}
