"""Each query on odd tables: nulls in every column, empty and long texts, ties, repeated rows, no rows."""

import pytest

from civiltext.llm.queries import QUERIES
from corpus_pipeline import STAGES, run

LONG = " ".join(f"word{i % 977} the" for i in range(30_000))
ROWS = [
    (1, "", "en", "a"), (2, None, "en", None), (None, "a text without an id", None, "b"), (4, LONG, "fr", "a"),
    (5, "the same row twice", "en", "b"), (5, "the same row twice", "en", "b"), (5, "another text of that id", None, "b"),
    (6, "   \n\t ", "de", "c"), (7, "1234 !!! 5678", "de", "c"), (None, None, None, None), (8, "x" * 100_000, "en", "c"),
    (-9, "token: abcdefgh12345 and a@b.cd", "en", "a"),
]
BENCHMARK = ([(1, "five words in this item here"), (2, ""), (3, None), (None, "a null id of an item now")], "item_id bigint, text string")
LABELS = ([(1, 1, 1), (4, 0, 0), (5, 1, 1), (5, 1, 0), (6, None, None), (None, 1, 1), (77, 1, 1)], "doc_id bigint, quality int, toxic int")
OTHER_TABLES = ("op11_", "op13_")
PER_ROW = [n for n in QUERIES if not n.startswith(("op3_", *OTHER_TABLES))]


def query(n):
    return QUERIES[next(name for name in QUERIES if name.startswith(f"op{n}_"))]


@pytest.fixture
def odd(tables):
    return tables(ROWS, benchmark=BENCHMARK, labels=LABELS)


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)


def test_tiling_finds_nothing_in_odd_rows(spark, odd):
    assert query(3)(spark, odd).count() == 0


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(OTHER_TABLES)])
def test_no_rows(spark, tables, name):
    folder = tables([], benchmark=([], BENCHMARK[1]), labels=([], LABELS[1]))
    assert QUERIES[name](spark, folder).count() == 0


def test_pipeline_on_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, odd)
        assert docs.columns == columns, name
    out = run(spark, odd).collect()
    starts = sorted((r.start, r.n_tokens) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_pipeline_without_rows(spark, tables):
    assert run(spark, tables([], benchmark=([], BENCHMARK[1]), labels=([], LABELS[1]))).count() == 0
