"""The pipeline's stages on a small fixture, each against a brute-force version of what it must keep."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from clauseloom.llm import op2_toxicity, tokens

pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _tie string"


def prose(rng, n):
    return " ".join(f"{'abcdefgh'[rng.integers(8)]}{rng.integers(400)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, docs, labels = np.random.default_rng(21), [], []
    for i in range(500):
        toxic = i % 5 == 0
        words = prose(rng, int(rng.integers(20, 80))).split(" ")
        for k in rng.choice(len(words), 3 if toxic else 0, replace=False):
            words[k] = f"vile{rng.integers(3)}"
        docs.append((i, " ".join(words), "en" if i % 3 else None, "abc"[i % 3] if i % 7 else None))
        labels.append((i, 1, int(toxic)))
    base = prose(rng, 200)
    docs += [(600 + k, base.replace(" ", "  ") if k % 2 else base, "en", "a") for k in range(40)]  # exact copies
    docs += [(700 + k, base + f" end{k}", "en", "b") for k in range(30)]  # near copies
    docs += [(800, None, None, None), (801, "", "en", "a"), (802, " \n", "en", "a"), (803, "word " * 5000, "de", "c"), (None, "no id at all", "en", "a")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*d, len(d[1] or ""), "t") for d in docs], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def grams(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False))


def test_stages_keep_what_they_must(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    toxicity, exact, near, mix, pack = (f for _, f in pipeline.STAGES)

    clean = toxicity(spark, docs, tables)
    assert clean.columns == docs.columns
    left = {i for i, _ in rows(clean)}
    vile = {i for i in range(0, 500, 5)}
    assert len(vile & left) <= 5 and len({i for i, _ in rows(docs)} - vile - left) <= 5

    once = exact(spark, docs, tables)
    assert once.columns == docs.columns
    lowest = {}
    for i, t in rows(docs):
        k = norm(t)
        lowest[k] = i if k not in lowest or (i is not None and (lowest[k] is None or i < lowest[k])) else lowest[k]
    assert sorted(map(str, ((i, norm(t)) for i, t in rows(once)))) == sorted(map(str, ((i, k) for k, i in lowest.items())))

    apart = near(spark, once, tables)
    assert apart.columns == docs.columns
    kept, comp = [], {}
    for i, t in sorted(rows(once), key=lambda r: (r[0] is None, r[0] or 0)):
        g = grams(t)
        if not g or i is None or not any(len(g & h) >= 0.8 * len(g | h) for h in comp.values()):
            kept.append(i)
        if g:
            comp[i] = g
    assert sorted(map(str, (i for i, _ in rows(apart)))) == sorted(map(str, kept))

    mixed = mix(spark, apart, tables)
    assert mixed.columns == docs.columns and {r._tie for r in mixed.collect()} == {"t"}
    size, got = Counter(), Counter()
    for i, t in rows(apart):
        size[i] += len((t or "").split())
    for i, t in rows(mixed):
        got[i] += len(t.split())
    assert all(got[i] <= 2 * size[i] for i in got) and abs(sum(got.values()) - 1.5 * sum(size.values())) <= 5

    packed = pack(spark, mixed, tables).collect()
    encode, want = tokens.ByteLevel(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, t in rows(mixed):
        want[i] += len(encode(t or "")) // 4 + 1
    held = Counter()
    for r in packed:
        held[r.doc_id] += r.length
    assert held == want
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024


def test_whole_run_and_empty_tables(spark, tables):
    out = pipeline.run(spark, tables)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 300
    for _, stage in pipeline.STAGES:
        none = stage(spark, spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < -1"), tables)
        assert none.count() == 0
    bare = spark.read.parquet(f"{tables}/documents.parquet").drop("lang")
    assert pipeline.STAGES[0][1](spark, bare, tables).columns == bare.columns


def test_a_missing_crc_means_a_wrong_piece(spark, tables):
    """Pieces' checksums are those of the mixed texts' ids."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").where(F.col("doc_id") == 803)
    got = sorted((r.start, r.length, r.ids_crc32) for r in pipeline.STAGES[-1][1](spark, docs, tables).collect())
    ids = tokens.ByteLevel(public_tokenizers.path("byte_bpe_50k.json"))("word " * 5000) + (2).to_bytes(4, "little")
    assert got and all(crc == zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n, crc in got) and sum(n for _, n, _ in got) == len(ids) // 4


def test_idle_workers_hold_no_memos(spark, tables):
    """Stages without Python come behind these, and need the memory; the same workers say what they hold."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")

    def held(batches):
        from clauseloom.llm import op2_toxicity, op7_ngram_join, tokens

        found = sum(len(m) + len(m.old) for m in (op2_toxicity._MEMO, op7_ngram_join._MEMO))
        if tokens.byte_level_ids.cache_info().currsize:
            e = tokens.byte_level_ids(path)
            found += len(e.now) + len(e.old) + len(e.tails)
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([found], pa.int64())})

    path = public_tokenizers.path("byte_bpe_50k.json")
    for at in (0, 2, 4):
        pipeline.STAGES[at][1](spark, docs, tables).write.format("noop").mode("overwrite").save()
        left = spark.range(0, 8, 1, 4).mapInArrow(held, "n long").collect()
        assert left and {r.n for r in left} == {0}, pipeline.STAGES[at][0]


def test_another_steps_model_is_let_go():
    encode = tokens.only(tokens.byte_level_ids(public_tokenizers.path("byte_bpe_50k.json")))
    want = encode("some words, and more")
    assert list(tokens._MODELS) == [encode.path]
    tokens.only(op2_toxicity._MEMO)
    assert not tokens._MODELS and encode("some words, and more") == want


def test_thresholds_start_no_workers_of_another_kind(spark, tables, monkeypatch):
    """Rows of Python would go through workers, and their parent, that nothing else uses."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **k: pytest.fail("rows went through Python workers"))
    assert pipeline.STAGES[0][1](spark, docs, tables).count() > 400
