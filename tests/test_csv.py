"""CSV files cut into byte ranges against Spark's reader, which reads a file in one task."""

import csv as plain_csv
import io
import random

import pytest

from fleetgauge.sources import csv


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few lines, so that cells and rows go through several."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "97")
    spark.conf.set(names[1], "1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def cell(rng):
    return "".join(rng.choices(["a", "b", ",", '"', "\n", "\r\n", " ", "é", "", "x" * rng.choice([1, 40])], k=rng.randrange(6)))


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_random_files_equal_the_single_task_reader(spark, tmp_path, small_ranges, seed):
    rng = random.Random(seed)
    for k in range(rng.randrange(1, 3)):
        out = io.StringIO()
        writer = plain_csv.writer(out, quoting=plain_csv.QUOTE_ALL if seed % 2 else plain_csv.QUOTE_MINIMAL, lineterminator="\r\n" if seed == 5 else "\n")
        writer.writerow(["id", 'odd "title"' if seed % 3 == 0 else "title", "two\nlines" if seed == 1 else "text"])
        writer.writerows([[f"{k}-{i}", cell(rng), cell(rng)] for i in range(60)])
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.csv").write_text(out.getvalue(), newline="")
    path = str(tmp_path / "in")
    usual = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    found = csv.read(spark, path)
    assert found.columns == usual.columns and found.count() == usual.count()
    assert csv._lines(spark, path).rdd.getNumPartitions() > 8
    ours, theirs = in_order(found.collect()), in_order(usual.collect())
    if seed == 5:  # Spark's reader makes every line break in a cell a single one
        ours = in_order(tuple(c and c.replace("\r\n", "\n") for c in r) for r in ours)
        theirs = in_order(tuple(c and c.replace("\r\n", "\n") for c in r) for r in theirs)
    assert ours == theirs


def test_repeated_headers_short_rows_and_empty_files(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text("a,b\n\n1,2\na,b\n3\n\n4,5,6\n")
    assert in_order(csv.read(spark, str(tmp_path / "a.csv")).collect()) == in_order([("1", "2"), ("a", "b"), ("3", None), ("4", "5")])
    (tmp_path / "b.csv").write_text("a,b\n")
    assert csv.read(spark, str(tmp_path / "b.csv")).collect() == []
    (tmp_path / "c.csv").write_text("")
    assert csv.read(spark, str(tmp_path / "c.csv")).collect() == []


def test_one_row_over_many_ranges(spark, tmp_path, small_ranges):
    long = "\n".join(f"line {i}" for i in range(200))
    (tmp_path / "a.csv").write_text(f'a,b\n1,"{long}"\n2,"{long}"\n3,x\n')
    assert in_order(csv.read(spark, str(tmp_path / "a.csv")).collect()) == in_order([("1", long), ("2", long), ("3", "x")])
