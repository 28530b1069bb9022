import pytest
from pyspark.sql import functions as F

from civiltext.operators.classifiers import logreg_fit
from civiltext.operators.sampling import make_splits
from civiltext.sources import artifacts, corpus


def write(folder, name, text):
    target = folder / name
    target.write_text(text, encoding="utf-8")
    return str(target)


def test_multilabel_csv(spark, tmp_path):
    header = "comment_text," + ",".join(corpus.TOXICITY_FLAGS)
    body = '"say ""hi""",0,0,0,0,0,0\n"two\nlines",,,1,,,\nNA,,,,,,\nback\\,0,0,0,0,0,1\n'
    rows = corpus.read_multilabel_csv(spark, write(tmp_path, "a.csv", f"{header}\n{body}"), source="s").orderBy("row_id").collect()
    assert [(r.source, r.text, r.y) for r in rows] == [
        ("s", 'say "hi"', 0), ("s", "two\nlines", 1), ("s", "NA", 0), ("s", "back\\", 1)
    ]


def test_binary_csv_takes_float_labels_and_keeps_missing_ones(spark, tmp_path):
    path = write(tmp_path, "b.csv", 'comment,toxic\nфу,1.0\n"ok, fine",0.0\nnone,\n')
    rows = corpus.read_binary_csv(spark, path, "comment", "toxic", "b").orderBy("row_id").collect()
    assert [(r.text, r.y) for r in rows] == [("фу", 1), ("ok, fine", 0), ("none", None)]


def test_fasttext_lines(spark, tmp_path):
    lines = "__label__NORMAL hi\n__label__A,__label__B x\n__label__X\nplain\n\n  __label__NORMAL two words \n"
    rows = corpus.read_fasttext(spark, write(tmp_path, "c.txt", lines)).orderBy("row_id").collect()
    assert [(r.text, r.y) for r in rows] == [("hi", 0), ("x", 1), ("two words", 0)]


def test_union_keeps_order_and_duplicates(spark):
    first = spark.createDataFrame([(5, "a", "t", 0)], corpus.CORPUS_SCHEMA)
    second = spark.createDataFrame([(0, "b", "t", 1), (1, "b", "t", 1)], corpus.CORPUS_SCHEMA)
    rows = corpus.union_corpora(first, second).orderBy("row_id").collect()
    assert [r.source for r in rows] == ["a", "b", "b"]
    assert len({r.row_id for r in rows}) == 3


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_corpus_round_trip(spark, path, fmt):
    rows = [(1, "s", 'a "q"\n\t x ', 0), (2, "s", "NA", 1), (3, "s", "\\", 1)]
    corpus.write_corpus(spark.createDataFrame(rows, corpus.CORPUS_SCHEMA), path("c"), fmt)
    read = corpus.read_corpus(spark, path("c"), fmt)
    assert sorted(map(tuple, read.collect())) == rows
    dropped = corpus.read_corpus(spark, path("c"), fmt, na_literals="drop")
    assert {r.row_id for r in dropped.collect()} == {1, 3}


def labelled(spark, n=60):
    return spark.range(n).select(
        F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("y"),
        F.when(F.col("id") % 3 == 0, "you awful fool go away").otherwise("a nice calm day today").alias("text"),
    )


def test_splits_fall_back_and_read_one_folder(spark, path):
    artifacts.write_splits(make_splits(labelled(spark)), path("splits"))
    read = artifacts.read_splits(spark, path("missing"), path("splits")).filter("split = 'val'")
    assert "PartitionFilters: [isnotnull(split" in read._jdf.queryExecution().executedPlan().toString()
    assert read.count() == 5
    with pytest.raises(FileNotFoundError):
        artifacts.read_splits(spark, path("missing"))


def test_model_files(spark, path):
    with pytest.raises(ValueError):
        artifacts.save_model(None, path("m"))
    splits = make_splits(labelled(spark))
    model = logreg_fit(splits, min_df=1, max_df=0.99)
    artifacts.save_model(model, path("src/model"))
    artifacts.write_splits(splits, path("src/splits"))
    assert artifacts.model_size(spark, path("src/model")).first()[0] > 0
    assert artifacts.model_size(spark, path("nowhere")).first()[0] == 0.0
    artifacts.promote(spark, path("src"), path("dst"))
    loaded = artifacts.load_model(path("dst/model"))
    before = {r.row_id: r.prediction for r in model.transform(splits).collect()}
    assert before == {r.row_id: r.prediction for r in loaded.transform(splits).collect()}
    assert artifacts.read_splits(spark, path("dst/splits")).count() == 60
    with pytest.raises(FileNotFoundError):
        artifacts.promote(spark, path("nowhere"), path("dst"))


def test_promoting_an_empty_folder_fails(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        artifacts.promote(spark, str(tmp_path / "empty"), str(tmp_path / "dst"))


def test_csv_columns_go_by_name(spark, tmp_path):
    flags = ",".join(corpus.TOXICITY_FLAGS)
    swapped = ",".join(reversed(corpus.TOXICITY_FLAGS))
    write(tmp_path, "a.csv", f"id,comment_text,{flags}\n17,first,0,0,0,0,0,1\n18,second,0,0,0,0,0,0\n")
    write(tmp_path, "b.csv", f'{swapped},"comment_text",extra\n1,0,0,0,0,0,third,0\n0,0,0,0,0,0,fourth,1\n')
    rows = corpus.read_multilabel_csv(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [(r.row_id, r.text, r.y) for r in rows] == [(0, "first", 1), (1, "second", 0), (2, "third", 1), (3, "fourth", 0)]


def test_binary_csv_in_any_order_of_columns(spark, tmp_path):
    path = write(tmp_path, "b.csv", "toxic,comment\n1.0,bad\n0,good\n")
    rows = corpus.read_binary_csv(spark, path, "comment", "toxic", "b").orderBy("row_id").collect()
    assert [(r.text, r.y) for r in rows] == [("bad", 1), ("good", 0)]


def test_missing_csv_column_is_an_error(spark, tmp_path):
    path = write(tmp_path, "b.csv", "text,toxic\nx,1\n")
    with pytest.raises(ValueError, match="comment"):
        corpus.read_binary_csv(spark, path, "comment", "toxic", "b")


def test_written_csv_is_read_by_name(spark, tmp_path):
    write(tmp_path, "c.csv", f'y,text,note,row_id,source\n1,"a ""q""",n,{2**60 + 1},s\n')
    assert corpus.read_corpus(spark, str(tmp_path), "csv").collect() == [(2**60 + 1, "s", 'a "q"', 1)]


@pytest.mark.parametrize("split_size", ["40", "200", "1000000"])
def test_ids_follow_files_and_lines(spark, tmp_path, split_size):
    write(tmp_path, "a.txt", "__label__NORMAL only\n")
    write(tmp_path, "b.txt", "".join(f"__label__A line {i}\n" for i in range(50)))
    write(tmp_path, "c.txt", "__label__NORMAL last\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_size)
    try:
        rows = corpus.read_fasttext(spark, str(tmp_path)).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.row_id for r in rows] == list(range(52))
    assert [r.text for r in rows] == ["only", *(f"line {i}" for i in range(50)), "last"]
