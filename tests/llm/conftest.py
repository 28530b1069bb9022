import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes small tables, with further columns whose names clash with those the operators make, and gives their folder."""

    def write(docs, **others):
        rows = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in docs]
        frame = spark.createDataFrame(rows, COLUMNS)
        clashing = ("id", "key", "size", "h", "blob", "fp", "score", "language", "found", "words", "kept", "spans", "target", "copies", "item", "m")
        frame = frame.selectExpr("*", *[f"'x' AS {c}" for c in clashing])
        frame.write.parquet(str(tmp_path / "documents.parquet"))
        for name, (rows, schema) in others.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
