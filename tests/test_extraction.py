import re

from clauseloom.operators import extraction as X
from clauseloom.sources import tables


def pages(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts, 1)], "doc_id string, page int, text string")


def test_words_make_lines(spark):
    words = [("d", 1, 100.0, 0, 0, n, x, 5.0, x + 4, 9.0, w) for n, (x, w) in enumerate([(50.0, "world"), (30.0, "hello"), (50.0, "again")])]
    df = spark.createDataFrame(words, "doc_id string, page int, page_width double, block_no int, line_no int, word_no int, x0 double, y0 double, x1 double, y1 double, word string")
    r = X.words_to_lines(df).first()
    assert (r.text, r.x0, r.x1) == ("hello world again", 30.0, 54.0)


def test_margin_noise(spark):
    lines = [("12. Theft", 10.0, 90.0), ("short note", 10.0, 90.0), ("[ 3 of 1901 ]", 50.0, 90.0), ("PENAL CODE", 50.0, 90.0), ("CHAPTER II", 10.0, 90.0), ("left", 1.0, 20.0), ("body", 50.0, 90.0), (" ", 50.0, 90.0)]
    df = spark.createDataFrame([("d", 1, 100.0, t, a, b) for t, a, b in lines], "doc_id string, page int, page_width double, text string, x0 double, x1 double")
    assert [r.text for r in X.drop_margin_noise(df).collect()] == ["12. Theft", "CHAPTER II", "body"]


def test_sections_and_their_page(spark):
    p = pages(spark, "before\n1. One\nmore", "still one\n2. Two\nend of two", "3A. Three\n1887. a year\n501. too high", "", "4. Four")
    got = {(r.section_no, r.section_id, r.page_start) for r in X.find_sections(X.page_lines(p)).collect()}
    assert got == {(1, "1", 2), (2, "2", 3), (3, "3A", 5), (4, "4", None)}
    assert X.find_sections(X.page_lines(pages(spark, "1. x", "2. y")), 2, 9).select("section_id").distinct().count() == 1


def test_units(spark):
    p = pages(spark, "7. Head of it\nCHAPTER III\n(1) First part\n(a) item\nProvided that no one\nProvided further that some\nExplanation 2.-A person\nIllustrations\n(a) A takes\nIllustration\nplain")
    got = [(r.unit_label, r.unit_type, r.text) for r in X.split_units(X.find_sections(X.page_lines(p))).orderBy("unit_no").collect()]
    assert got == [
        ("", "section_body", "7. Head of it"), ("1", "subsection", "(1) First part (a) item"), ("provided_that", "proviso", "Provided that no one"),
        ("provided_that", "proviso", "Provided further that some"), ("explanation", "explanation", "Explanation 2.-A person"),
        ("illustrations", "illustration", "Illustrations (a) A takes"), ("illustrations", "illustrations_header", "Illustration plain"),
    ]


def test_candidates_are_numbered_in_order(spark):
    one, two = pages(spark, "1. The officer shall pay ( 5 ) coins under this section ;", "2. short"), pages(spark, "9. May a child do it unless told so by the court", doc="e")
    rows = X.build_candidates(two.unionByName(one).repartition(5), "Act").orderBy("example_id").collect()
    assert [(r.example_id, r.section_id) for r in rows] == [("SL00001", "Section 1"), ("SL00002", "Section 2"), ("SL00003", "Section 9")]
    flags = lambda r: (r.has_modal, r.has_exception, r.has_numbers, r.has_roles, r.needs_context, r.bad_fragment)
    assert rows[0].source_text == "1. The officer shall pay (5) coins under this section;"
    assert [flags(r) for r in rows] == [(1, 0, 1, 1, 1, 1), (0, 0, 1, 0, 0, 1), (1, 1, 1, 1, 0, 0)]


def test_units_and_documents_counts_do_not_pass_the_driver(spark):
    many = pages(spark, "1. The officer shall pay").unionByName(pages(spark, "2. The court may order", doc="e"))
    plan = X.build_candidates(many, "Act")._jdf.queryExecution().executedPlan().toString()
    by_document = [line for line in plan.splitlines() if "Join [doc_id" in line]
    assert by_document and all("SortMergeJoin" in line for line in by_document)


def test_merged_pages_and_text_sink(spark, tmp_path):
    p = pages(spark, " a ", " ", "b\nc")
    assert X.merge_pages(p).first().text == "--- PAGE 1 ---\na\n\n--- PAGE 3 ---\nb\nc"
    tables.write_pages(p, f"{tmp_path}/t", "text")
    whole = "".join(f.read_text() for f in sorted((tmp_path / "t").glob("part-*")))
    assert re.findall(r"--- PAGE (\d) ---", whole) == ["1", "2", "3"]
