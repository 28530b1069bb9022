"""Parallel reading of lines and CSV records against one-task readers."""

import contextlib
import random

import pytest
from pyspark.sql import functions as F

from civiltext.sources import corpus, records

ONE_TASK = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


@contextlib.contextmanager
def split_size(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def write(folder, name, text):
    (folder / name).write_bytes(text.encode())


def quoted(rng, value):
    return '"' + value.replace('"', '""') + '"' if rng.random() < 0.7 or any(c in value for c in ',"\n\r') else value


def random_csv(rng, rows, end="\n"):
    """A file and its rows, with commas, quotes and line breaks in cells."""
    pieces = ["a", "é𝄞", ",", '"', '""', "\n", "\n\n", " ", "\r\n", "word", "\\", "'"]
    kept, lines = [], ["text,extra,y"]
    for _ in range(rows):
        text, extra = ("x" + "".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(2))
        y = rng.randrange(2)
        kept.append((text, y))
        lines.append(",".join((quoted(rng, text), quoted(rng, extra), str(y))))
        if rng.random() < 0.1:
            lines.append("")  # a blank line between records is none
    return end.join(lines) + (end if rng.random() < 0.5 else ""), kept


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_random_csv_in_blocks(spark, tmp_path, size):
    rng, expected = random.Random(size), []
    for k in range(3):
        text, rows = random_csv(rng, 60, "\r\n" if k == 1 else "\n")
        write(tmp_path, f"{k}.csv", text)
        expected += rows
    with split_size(spark, size):
        got = corpus.read_binary_csv(spark, str(tmp_path), "text", "y", "s").orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(180))
    assert [(r.text, r.y) for r in got] == expected


@pytest.mark.parametrize("seed", range(2))
def test_stray_quotes_as_in_the_one_task_reader(spark, tmp_path, seed):
    rng = random.Random(seed)
    # blanks after a closing quote are left out: the library's parser treats these cells differently at the end of a file's line
    lines = ["a,b"] + ["".join(rng.choice(["x", ",", '"', '""', '"y"', "w", "z"]) for _ in range(rng.randrange(1, 7))) for _ in range(120)]
    write(tmp_path, "a.csv", "\n".join(lines) + '\nlast,"1"\n')
    plain = spark.read.options(**ONE_TASK).schema("a string, b string").csv(str(tmp_path))
    expected = [(r.a, r.b) for r in plain.collect()]
    with split_size(spark, 90):
        got = corpus.read_csv(spark, str(tmp_path), {"a": "string", "b": "string"}).orderBy("row_id").collect()
    assert [(r.a, r.b) for r in got] == expected


def test_many_tasks_read_one_file(spark, tmp_path):
    write(tmp_path, "a.csv", "text,y\n" + "".join(f'"line {i}\nand, more",{i % 2}\n' for i in range(2000)))
    with split_size(spark, 5000):
        lines = records.text_lines(spark, str(tmp_path), lineSep="\n")
        assert lines.rdd.getNumPartitions() >= 8
        got = corpus.read_binary_csv(spark, str(tmp_path), "text", "y", "s").orderBy("row_id").collect()
    assert [(r.row_id, r.text, r.y) for r in got] == [(i, f"line {i}\nand, more", i % 2) for i in range(2000)]


def test_single_line_records_are_not_shuffled(spark, tmp_path):
    write(tmp_path, "a.csv", "text,y\n" + '"a, b",1\n' * 100)
    rows, _ = records.csv_records(spark, str(tmp_path))
    single = rows._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
    assert "Union" in single and "Repartition" not in single and "Sort" not in single


@pytest.mark.parametrize("kind", ["fasttext", "csv"])
def test_rows_outlive_a_change_of_the_cluster(spark, tmp_path, kind):
    for k in range(3):
        lines = [f"__label__A line {k} {i}" if kind == "fasttext" else f'"line {k}\n{i}",1' for i in range(4000)]
        write(tmp_path, f"{k}.txt", "\n".join(lines if kind == "fasttext" else ["text,y", *lines]) + "\n")
    with split_size(spark, 1 << 20):
        rows = corpus.read_fasttext(spark, str(tmp_path)) if kind == "fasttext" else corpus.read_binary_csv(spark, str(tmp_path), "text", "y", "s")
    with split_size(spark, 9999):  # blocks of another size by the time the rows are asked for
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "64")
        try:
            got = rows.orderBy("row_id").collect()
        finally:
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    gap = " " if kind == "fasttext" else "\n"
    assert [(r.row_id, r.text) for r in got] == [(k * 4000 + i, f"line {k}{gap}{i}") for k in range(3) for i in range(4000)]


def test_blocks_beyond_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MOST_BLOCKS", 2)
    write(tmp_path, "a.csv", "text,y\n" + "".join(f'"{i}",1\n' for i in range(300)))
    with split_size(spark, 100):
        got = corpus.read_binary_csv(spark, str(tmp_path), "text", "y", "s").orderBy("row_id").collect()
    assert [(r.row_id, r.text) for r in got] == [(i, str(i)) for i in range(300)]


def test_headers_with_line_breaks_and_empty_files(spark, tmp_path):
    write(tmp_path, "a.csv", '"the\ntext",y\nfirst,1\n')
    write(tmp_path, "b.csv", "")
    write(tmp_path, "c.csv", 'y,"the\ntext"\n')
    write(tmp_path, "d.csv", '﻿y,"the\ntext"\n0,second\n')
    got = corpus.read_csv(spark, str(tmp_path), {"the\ntext": "string", "y": "int"}).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [("first", 1, 0), ("second", 0, 1)]


def test_no_records(spark, tmp_path):
    write(tmp_path, "a.csv", "")
    assert corpus.read_csv(spark, str(tmp_path), {"text": "string"}).collect() == []
    write(tmp_path, "a.csv", "text\n")
    read = corpus.read_csv(spark, str(tmp_path), {"text": "string"})
    assert read.columns == ["text", "row_id"] and read.agg(F.count("*")).first()[0] == 0


def test_states_of_lines():
    cases = {
        'a,b': (0, 1), 'a,"b': (1, 0), '"a","b"': (0, 0), '"a""': (1, 0), '"a"""': (0, 0), 'a"b,c': (0, 0), '"a"b,"c': (1, 1), 'x",y': (0, 0),
        'x","y': (1, 1), '': (0, 1), '"': (1, 0), '""': (0, 1), ' "a': (0, 0), '"a"\r': (0, 0), 'x""y': (0, 1),
    }
    assert {line: tuple(map(int, records._ends(line))) for line in cases} == cases
