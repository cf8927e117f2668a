from pyspark.sql import functions as F

from clauseloom.operators import curation, prefilter


def hashes(spark, a, b):
    return spark.range(a, b).select(F.xxhash64("id").alias("h"))


def test_filter_passes_every_key_and_few_others(spark):
    n = 20_000
    words = prefilter.key_filter(hashes(spark, 0, n), n)
    passed = lambda a, b: hashes(spark, a, b).where(prefilter.may_match(words, F.col("h"), spark)).count()
    assert passed(0, n) == n
    assert passed(n, 3 * n) < 0.01 * 2 * n
    assert prefilter.key_filter(hashes(spark, 0, 10), 10, most=64) is None
    assert hashes(spark, 0, 5).where(prefilter.may_match(None, F.col("h"), spark)).count() == 5
    none = prefilter.key_filter(hashes(spark, 0, 0), 0)
    assert hashes(spark, 0, 5).where(prefilter.may_match(none, F.col("h"), spark)).count() == 0


def test_leaks_with_and_without_the_filter(spark, monkeypatch):
    train = spark.createDataFrame([(f"Rule {k}", "it  costs") for k in range(300)] + [(None, "x"), ("", "")], "premise string, hypothesis string")
    rows = [(f"RULE {k}", " It costs ", "entailment") for k in range(250, 900)] + [(None, "x", None), ("", None, "neutral"), ("new", None, "neutral")]
    ev = spark.createDataFrame(rows, "premise string, hypothesis string, gold_label string").withColumn("_may", F.lit("mine"))
    seen = []
    for most in (prefilter.MOST_BITS, 0):
        monkeypatch.setattr(curation, "key_filter", lambda keys, n, most=most: prefilter.key_filter(keys, n, most))
        kept, gone = curation.remove_leakage(ev, train), curation.leaked_rows(ev, train)
        flagged = curation.with_leak(ev, train)
        assert kept.columns == gone.columns == ev.columns and flagged.columns == [*ev.columns, "leaked"]
        seen.append((sorted(map(str, kept.collect())), sorted(map(str, gone.collect())), sorted(map(str, flagged.collect()))))
        assert len(seen[-1][1]) == 52 and len(seen[-1][0]) == len(rows) - 52
    assert seen[0] == seen[1]
