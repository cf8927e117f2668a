import time

from clauseloom.streaming import meet

TEXT = "Anyone who digs here shall pay five coins in full.\nProvided that the clerk may let the digger off."
FIRST, SECOND = "The digger must pay five coins.", "The clerk may let the digger off."


def test_claims_before_after_and_without_their_provision(spark, tmp_path):
    def add(kind, *rows):
        schema = meet.PROVISIONS if kind == "p" else meet.CLAIMS
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").json(f"{tmp_path}/{kind}")

    def run():
        q = meet.stream_meet(spark, f"{tmp_path}/p", f"{tmp_path}/c", f"{tmp_path}/out", f"{tmp_path}/state", wait=1.0)
        q.awaitTermination()
        return sorted((r.provision_id or "", r.claim_id or "", r.met, r.evidence_span_id or "") for r in spark.read.parquet(f"{tmp_path}/out").collect())

    setting = spark.conf.get(meet.STORE, None)
    add("p", ("a", TEXT), ("lonely", TEXT))
    add("c", ("a", "C1", FIRST), ("b", "C1", FIRST), ("lost", "C1", FIRST), (None, "C1", FIRST))
    one = [("a", "C1", "matched", "P1")]
    assert run() == one
    # a new start: the waiting claim of b meets its provision, a gets another claim and an old one again
    add("p", ("b", TEXT), ("b", "another text"))
    add("c", ("a", "C2", SECOND), ("a", "C1", FIRST), ("b", "C2", SECOND), ("b", "C2", SECOND))
    two = sorted([*one, ("a", "C2", "matched", "P2"), ("b", "C1", "matched", "P1"), ("b", "C2", "matched", "P2")])
    rows = run()
    assert [r for r in rows if r[2] == "matched"] == two
    time.sleep(1.5)
    add("c", ("a", "C3", "Bananas."))
    left = [("", "C1", "no_provision", ""), ("lonely", "", "no_claims", ""), ("lost", "C1", "no_provision", "")]
    rows = run()
    assert rows == sorted([*two, ("a", "C3", "matched", ""), *left])
    # a late provision is kept for claims to come; nothing is told twice
    add("p", ("lost", TEXT))
    add("c", ("lost", "C2", SECOND), ("lost", "C1", FIRST))
    assert run() == sorted([*rows, ("lost", "C2", "matched", "P2")])
    assert spark.conf.get(meet.STORE, None) == setting


def test_a_batch_of_the_kept_table(spark):
    """Each claim waits its own time, repeats are passed over while they are kept, and no row goes through Python."""
    new = lambda *rows: spark.createDataFrame([*rows], "provision_id string, kind string, claim_id string, body string")
    kept = spark.createDataFrame([], meet.KEPT)
    step = lambda kept, now, *rows: meet.meet_batch(kept, new(*rows), now, 100, 1000)

    def run(now, *rows):
        nonlocal kept
        kept = spark.createDataFrame(step(kept, now, *rows).collect(), meet.KEPT)
        left = kept.where("met is not null and (kind = 'c' or met <> 'matched')").collect()
        return sorted((r.provision_id or "", r.claim_id or "", r.body, r.met) for r in left)

    many = [("much", "c", f"C{i}", "t") for i in range(200)]
    assert run(0, ("a", "c", "C1", "one"), (None, "c", None, "x"), *many, *many) == []
    assert run(60, ("a", "c", "C2", "two"), ("a", "c", "C1", "again"), ("lone", "p", None, "text")) == []
    first = run(120)  # C2 of a came 60 ago
    assert first[:2] == [("", "", "x", "no_provision"), ("a", "C1", "one", "no_provision")] and len(first) == 202
    assert run(130, ("a", "p", None, "text"), ("a", "p", None, "other"), ("a", "c", "C1", "again")) == [("a", "C2", "two", "matched")]
    assert kept.where("provision_id = 'a' and kind = 'p'").select("body", "settled").collect() == [("text", True)]
    assert run(200, *many[:3]) == [("lone", "", "text", "no_claims")]
    assert run(1059, ("a", "c", "C1", "new"), ("a", "c", "C2", "two")) == [("a", "C1", "new", "matched")]  # C1 is forgotten, C2 is not
    assert run(2058, ("a", "c", "C3", "three")) == [("a", "C3", "three", "matched")]  # the provision stays as long as rows come
    assert run(3058, ("a", "c", "C4", "four")) == [] and kept.where("kind = 'p'").isEmpty()
    plan = step(kept, 0, ("a", "p", None, "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "SortMergeJoin" not in plan


def test_what_is_due_leaves_without_new_files(spark, tmp_path):
    spark.createDataFrame([("b", "C1", FIRST)], meet.CLAIMS).write.json(f"{tmp_path}/c")
    (tmp_path / "p").mkdir()
    q = meet.stream_meet(spark, f"{tmp_path}/p", f"{tmp_path}/c", f"{tmp_path}/out", f"{tmp_path}/state", wait=1.0, available_now=False, every=1.0)
    try:
        until, rows = time.time() + 90, []
        while not rows and time.time() < until and q.exception() is None:
            time.sleep(1)
            rows = spark.read.schema("provision_id string, met string").parquet(f"{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
    finally:
        q.stop()
    assert rows and {(r.provision_id, r.met) for r in rows} == {("b", "no_provision")} and len(list((tmp_path / "state/kept").iterdir())) <= 3
