import pytest
from pyspark.sql import functions as F

from clauseloom.operators import claims, score_store, scoring
from clauseloom.plans import catalog
from clauseloom.sources import run_log, tables
from clauseloom.streaming import verify


def test_csv_cells_keep_their_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('nli_id,premise,hypothesis,gold_label\n01,"says ""no""\nand goes",h,1\n2,,h,2.0\n')
    rows = tables.read_nli(spark, str(tmp_path / "a.csv"), "s").orderBy("nli_id").collect()
    assert [(r.nli_id, r.premise, r.gold_label, r.error_type, r.dataset) for r in rows] == [("01", 'says "no"\nand goes', "1", None, "s"), ("2", None, "2.0", None, "s")]
    (tmp_path / "b.csv").write_text("premise,x\na,b\n")
    with pytest.raises(ValueError, match="hypothesis"):
        tables.read_nli(spark, str(tmp_path / "b.csv"), "s")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_eval(spark, str(tmp_path / "none.csv"))


def test_nothing_is_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    tables.write_v2_splits({"train": df}, f"{tmp_path}/v")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_v2_splits({"train": df}, f"{tmp_path}/v")


def test_run_log_failure_is_a_warning(spark, tmp_path):
    df = spark.createDataFrame([("r", "2024-05-01 10:00:00", [1.5])], "run_id string, t string, probs array<double>").withColumn("ts", F.to_timestamp("t"))
    assert tables.write_runs(df, f"{tmp_path}/log", "one") == "success"
    assert tables.write_runs(df.drop("ts"), f"{tmp_path}/log", "two") == "warning"
    (tmp_path / "file").write_text("no folder")
    assert tables.write_runs(df, f"{tmp_path}/file", "one") == "warning"
    assert run_log.read_runs(spark, f"{tmp_path}/log", "run_id string, probs array<double>").first().probs == [1.5]


def test_a_run_is_logged_once(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "run_id string"
    runs = lambda *ids: spark.createDataFrame([(i,) for i in ids], schema)
    kept = lambda: sorted(r.run_id for r in run_log.read_runs(spark, log, schema).collect())
    # a writer that died behind its files, and one that died behind an empty marker
    runs("a", "b").write.json(f"{log}/data/run={run_log._folder('k1')}/attempt=adead")
    (tmp_path / "log" / "commits").mkdir()
    (tmp_path / "log" / "commits" / run_log._folder("k2")).write_text("")
    assert [run_log.log_runs(runs("a", "b"), log, "k1"), run_log.log_runs(runs("c"), log, "k2"), run_log.log_runs(runs("d"), log, "../odd key")] == ["success"] * 3
    assert kept() == ["a", "b", "c", "d"]
    assert run_log.log_runs(runs("a", "b"), log, "k1") == "success" and kept() == ["a", "b", "c", "d"]
    with pytest.raises(Exception, match="exists"):
        run_log._Marker(spark, log, "k1").create("k1 late\n")
    assert kept() == ["a", "b", "c", "d"]


def test_resume(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    done = spark.createDataFrame([("a", "x", 2), ("b", " ", 1), ("a", "y", 1), ("c", None, 1)], "k string, o string, at int")
    todo, had = tables.resume_missing(df, done, "k", "o", "at")
    assert sorted(r.k for r in todo.collect()) == ["b", "c"] and [tuple(r) for r in had.collect()] == [("a", "x")]
    assert [tuple(r) for r in tables.resume_missing(df, done, "k", "o")[1].collect()] == [("a", "y")]
    assert tables.with_checkpoint(df, df.orderBy(F.desc("k")), "k") and not tables.with_checkpoint(df, done, "k")
    assert not tables.with_checkpoint(df, spark.createDataFrame([("a",), ("b",), ("b",)], "k string"), "k")
    tables.write_checkpoint(df.repartition(3).withColumn("o", F.lit("x")), f"{tmp_path}/c", "k")
    assert tables.checkpoint_fits(df, f"{tmp_path}/c", "k") and not tables.checkpoint_fits(df.where("k <> 'a'"), f"{tmp_path}/c", "k")
    empty = df.limit(0)
    assert tables.with_checkpoint(empty, empty, "k") and not tables.with_checkpoint(empty, df, "k")


def test_scores_are_kept_across_runs(spark, tmp_path):
    calls, store = spark.sparkContext.accumulator(0), str(tmp_path / "s")

    def make():
        def score(ev, cl):
            calls.add(len(ev))
            if "bad" in cl:
                raise ValueError
            return [[len(e), len(c), 0] for e, c in zip(ev, cl, strict=True)]

        return score

    rows = lambda *pairs: spark.createDataFrame(list(pairs), "evidence_text string, claim_text string").withColumn("key", F.lit("mine"))
    run = lambda df, model="m": sorted(map(str, score_store.score_with_store(df, make, store, model).select("evidence_text", "claim_text", "l0", "l1", "error", "key").collect()))
    first = rows(("e", "c"), ("e", "c"), (None, "c"), ("", "c"), ("e", None))
    plain = lambda df: sorted(map(str, scoring.score_once(df, make).select("evidence_text", "claim_text", "l0", "l1", "error", "key").collect()))
    assert run(first) == plain(first)
    calls.value = 0
    assert run(rows(("e", "c"))) == plain(rows(("e", "c")))[:1] and calls.value == 1  # the plain call's
    calls.value = 0
    again = rows(("e", "c"), ("new", "c"), ("new", "c"), ("x", "bad"))
    assert "inference_failed" in str(run(again)) and calls.value in (3, 4)  # the new pair, and the bad one with its neighbour and alone
    assert score_store.stored_scores(spark, store, "m").count() == 2
    calls.value = 0
    run(rows(("e", "c")), "other model")
    assert calls.value == 1


def test_claim_calls_stop_where_generators_fail(spark):
    def denied():
        def call(t):
            raise PermissionError("no")

        return [call, call]

    def lost():
        raise OSError("no weights")

    df = spark.createDataFrame([(str(k),) for k in range(6)], "t string").coalesce(1)
    got = lambda make, **how: [(r.raw, r.calls, r.call_error) for r in scoring.claims_with_retries(df, make, "t", **how).collect()]
    assert got(lost) == [(None, 0, "OSError: no weights")] * 6
    assert got(denied, trip=2) == [(None, 1, "PermissionError: no")] * 2 + [(None, 0, "circuit_open")] * 4
    assert got(denied) == [(None, 1, "PermissionError: no")] * 6


@pytest.mark.parametrize("raw", ['[{"claim_id": "1", "claim_text": "a"}]', '```json [{"claim_id": "1", "claim_text": "a"}]```', "[]", "no", '{"claim_id": "1"}', '[{"claim_id": 1, "claim_text": "a"}]', '[{"claim_id": "1", "claim_text": " "}]', '["a"]', "null"])
def test_usable_answers_are_those_that_parse(spark, raw):
    df = spark.createDataFrame([(raw,)], "raw string").select(claims.parse_claims(F.col("raw")).isNotNull().alias("ok"))
    assert scoring.usable_claims(raw) == df.first().ok


def test_claim_calls_share_a_budget(spark):
    def make():
        def busy(t):
            raise ConnectionError

        def denied(t):
            raise PermissionError

        return [denied if False else (lambda t: busy(t) if t == "busy" else denied(t) if t == "denied" else "[]" if t == "ok" else ""), lambda t: "second"]

    df = spark.createDataFrame([("ok",), ("busy",), ("denied",), ("empty",)], "t string").coalesce(1)
    got = [(r.raw, r.calls) for r in scoring.claims_with_retries(df, make, "t", usable=bool).collect()]
    assert got == [("[]", 1), (None, 3), (None, 1), ("second", 2)]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    row = lambda i, t, *c: (f"p{i}", "a", t, " ".join(c), [(f"C{k}", x) for k, x in enumerate(c, 1)])
    rows = [row(1, "Anyone who digs here shall pay five coins in full.", "The digger must pay five coins.", "Bananas."), row(2, "The clerk shall not tell anyone about the ten records.", "The clerk may tell about 10 records.")]
    df = spark.createDataFrame(rows, verify.INPUT)
    want = sorted(str(r.asDict()) for r in verify.verify(df).collect())
    df.where("provision_id = 'p1'").write.json(f"{tmp_path}/in")
    args = (spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state")
    verify.stream_verify(*args).awaitTermination()
    df.where("provision_id = 'p2'").write.mode("append").json(f"{tmp_path}/in")
    verify.stream_verify(*args).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(str(r.asDict()) for r in got.collect()) == want


def test_a_store_has_a_file_for_each_folder_and_pairs_are_made_once(spark, tmp_path, monkeypatch):
    pairs = spark.range(0, 600, 1, 6).select(F.concat(F.lit("evidence "), "id").alias("evidence_text"), F.lit("claim").alias("claim_text"))
    make = lambda: lambda ev, cl: [[len(e), len(c), 0] for e, c in zip(ev, cl, strict=True)]
    assert score_store.score_with_store(pairs, make, str(tmp_path / "s"), "m").where("l0 is not null").count() == 600
    files = list((tmp_path / "s").glob("*/*/*.parquet"))
    assert len(files) == len({f.parent for f in files}) > 200
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            made.add(len(f))
            yield f

    linked = pairs.withColumns({"provision_id": F.concat(F.lit("o"), F.substring("evidence_text", 10, 9)), "claim_id": F.lit("C1")})
    monkeypatch.setattr(catalog, "_linked", lambda spark, d: linked.mapInPandas(count, linked.schema))
    for query in ("score_store", "batch_score"):
        made.value = 0
        rows = catalog.QUERIES[query](spark, "no folder").collect()
        assert len(rows) == 600 and made.value == 600
