import csv
import io
import random
from collections import Counter

import pytest

from clauseloom.sources import quoted_csv as Q

CELLS = ["", "a", "b c", 'say "hi"', "two\nlines", "a,b", '"', '""', '\n\n', 'x"y', "é😀", " lead", "trail ", ",\n\"\n,", "1\r\n2", "q" * 700, "\n" * 300, '","']


def made(rng, n, end):
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=end, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    w.writerow(["k", "first text", "t"])
    for k in range(n):
        w.writerow([f"k{k}", rng.choice(CELLS), rng.choice(CELLS)])
    text = out.getvalue()
    # cells that hold a quote but don't begin with one are text as they stand
    return text.replace('"x""y"', 'x"y') if rng.random() < 0.5 else text


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_files_read_like_the_whole_file_reader(spark, tmp_path, seed):
    """Splits of some hundred bytes cut records, cells and quotes anywhere."""
    rng = random.Random(seed)
    end = ["\n", "\r\n"][seed % 2]
    for f in range(rng.choice([1, 3])):
        (tmp_path / f"{f}.csv").write_bytes(made(rng, rng.randint(0, 120), end).encode())
    want = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("97", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = Q.read_quoted_csv(spark, str(tmp_path))
            assert got.columns == want.columns
            # where lines end in \r\n, Spark's reader makes \n of that inside cells too; here cells keep their text
            mine = Counter(tuple(x if x is None or end == "\n" else x.replace("\r\n", "\n") for x in r) for r in got.collect())
            assert mine == rows(want), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_one_file_is_many_tasks(spark, tmp_path):
    n = 60_000
    with open(tmp_path / "one.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["k", "t"])
        w.writerows([k, f'line one of {k}\nand "two"\n'] for k in range(n))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        df = Q.read_quoted_csv(spark, str(tmp_path / "one.csv"))
        assert Q.csv_records(spark, str(tmp_path / "one.csv")).rdd.getNumPartitions() >= 8
        assert df.count() == n and df.where("t = concat('line one of ', k, '\\nand \"two\"\\n')").count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quotes_of_lines():
    assert Q.ends_inside('a,"b', False) and not Q.ends_inside('b",c', True) and not Q.ends_inside('a"b,c', False)
    assert Q.ends_inside('""', True) and not Q.ends_inside('""', False) and Q.ends_inside('"a""', False) and not Q.ends_inside('"a"""', False)
    assert Q.ends_inside('x","y', True) and Q.ends_inside("plain", True)


def test_an_empty_file_and_a_lone_header(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert Q.read_quoted_csv(spark, str(tmp_path / "h.csv")).collect() == []
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,3\n')
    assert Q.read_quoted_csv(spark, str(tmp_path / "open.csv")).count() == 1
