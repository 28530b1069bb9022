"""Reading differently labelled corpora into one schema, and writing them back.

Unified schema: `row_id BIGINT, source STRING, text STRING, y INT` with y 1 for toxic.
Ids follow the order of files and lines, however the files are split and whatever becomes of the cluster meanwhile.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiltext.functions.once import evaluated_once
from civiltext.functions.text import SPACE_CHARS
from civiltext.operators.cleaning import drop_na_literals
from civiltext.sources.records import csv_records, header_names, numbered_lines, text_lines

# Label columns and markers of the input formats.
TOXICITY_FLAGS = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")
LABEL_MARK = "__label__"
SAFE_LABEL = "NORMAL"

CSV_OPTIONS = {"multiLine": "true", "quote": '"', "escape": '"'}
CSV_WRITE_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
SOURCE_STRIDE = 1 << 56

CORPUS_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("y", T.IntegerType()),
])


def any_of(*flags: str) -> Column:
    """1 when any flag is positive; a missing flag counts as 0."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f), F.lit(0)) for f in flags])
    return (total > 0).cast("int")


def label_map(label: Column, safe: str = SAFE_LABEL) -> Column:
    """0 for the safe label, 1 for every other one."""
    return F.when(label == safe, 0).otherwise(1)


def to_unified(df: DataFrame, source: str, text: Column, y: Column, row_id: Column) -> DataFrame:
    return df.select(
        row_id.cast("bigint").alias("row_id"),
        F.lit(source).alias("source"),
        text.alias("text"),
        y.cast("int").alias("y"),
    )


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def _cell(name: str, kind: str) -> Column:
    """A cell as its type; integers may be written as 1.0."""
    cell = F.col(name)
    if kind == "int":
        cell = F.coalesce(cell.try_cast("int"), cell.try_cast("double").try_cast("int"))
    return cell if kind == "string" else cell.try_cast(kind)


def read_csv(spark: SparkSession, path: str, columns: dict[str, str], number: bool = True) -> DataFrame:
    """The named columns of CSV files with a header each, and the place of each row as `row_id`; `columns` maps names to types.

    Columns are taken by name from each file's own header, wherever they stand and whatever else a file holds. Cells that
    do not fit the type become null; cells may hold line breaks. Files are read in blocks, by as many tasks as there are,
    once: the lines are stored, and rows and numbers come from what was stored (`records`).
    """
    rows, headers = csv_records(spark, path)
    cells = None
    for layout, (header, file) in enumerate(headers):
        there = header_names(header)
        if missing := [c for c in columns if c not in there]:
            raise ValueError(f"no column {', '.join(missing)} in {file}, which has {', '.join(there)}")
        wanted = {there.index(c): f"c{i}" for i, c in enumerate(columns)}
        schema = ", ".join(f"{wanted.get(i, f'other_{i}')} string" for i in range(len(there)))
        parsed = F.from_csv("record", schema, CSV_OPTIONS)
        own = let(parsed, lambda p: F.struct(*[p[f"c{i}"].alias(f"c{i}") for i in range(len(columns))]))
        cells = F.when(F.col("layout") == layout, own) if cells is None else cells.when(F.col("layout") == layout, own)
    if cells is None:
        names = {**columns, "row_id": "bigint"} if number else columns
        return spark.createDataFrame([], ", ".join(f"`{c}` {kind}" for c, kind in names.items()))
    read = rows.select("row_id", evaluated_once(cells).alias("cells"))
    place = [F.col("row_id")] if number else []
    return read.select(*[_cell(f"cells.c{i}", kind).alias(c) for i, (c, kind) in enumerate(columns.items())], *place)


def read_multilabel_csv(
    spark: SparkSession,
    path: str,
    text_col: str = "comment_text",
    label_cols: tuple[str, ...] = TOXICITY_FLAGS,
    source: str = "multilabel",
) -> DataFrame:
    rows = read_csv(spark, path, {text_col: "string", **dict.fromkeys(label_cols, "int")})
    return to_unified(rows, source, F.col(text_col), any_of(*label_cols), F.col("row_id"))


def read_binary_csv(
    spark: SparkSession, path: str, text_col: str, label_col: str, source: str
) -> DataFrame:
    """Text and one 0/1 label, written as an integer or a float."""
    rows = read_csv(spark, path, {text_col: "string", label_col: "double"})
    return to_unified(rows, source, F.col(text_col), F.col(label_col), F.col("row_id"))


def parse_label_lines(lines: DataFrame, source: str, row_id: Column, safe: str = SAFE_LABEL) -> DataFrame:
    """`__label__NAME text` in column `value`; lines without the mark or without a space are no data.

    Only the first token is the label. Further labels of a line stay in the text.
    """
    edge = f"[{SPACE_CHARS}]+"
    line = F.regexp_replace(F.col("value"), rf"^{edge}|{edge}\z", "")
    trimmed = lines.select(row_id.alias("row_id"), evaluated_once(line).alias("line"))
    first = F.substring_index("line", " ", 1)
    data = trimmed.filter(F.col("line").startswith(LABEL_MARK) & F.col("line").contains(" "))
    return to_unified(
        data,
        source,
        F.expr("substring(line, instr(line, ' ') + 1)"),
        label_map(F.replace(first, F.lit(LABEL_MARK), F.lit("")), safe),
        F.col("row_id"),
    )


def read_fasttext(spark: SparkSession, path: str, source: str = "fasttext", safe_label: str = SAFE_LABEL) -> DataFrame:
    return parse_label_lines(numbered_lines(text_lines(spark, path)), source, F.col("row_id"), safe_label)


def union_corpora(*corpora: DataFrame) -> DataFrame:
    """Concatenate in the given order; duplicates stay.

    The position of a corpus goes into the high bits of `row_id`, which keeps "first
    corpus, first row" order without numbering rows globally.
    """
    numbered = [
        df.withColumn("row_id", F.lit(position * SOURCE_STRIDE) + F.col("row_id"))
        for position, df in enumerate(corpora)
    ]
    return reduce(lambda a, b: a.unionByName(b), numbered)


def write_corpus(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.options(**CSV_WRITE_OPTIONS).csv(path)
    else:
        writer.format(fmt).save(path)


def read_corpus(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType = CORPUS_SCHEMA,
    na_literals: str = "keep",
) -> DataFrame:
    """Read a written corpus; `na_literals="drop"` also drops texts such as `NA` or `null`."""
    if fmt == "csv":
        fields = T._parse_datatype_string(schema).fields if isinstance(schema, str) else schema.fields
        df = read_csv(spark, path, {f.name: f.dataType.simpleString() for f in fields}, number=False)
    else:
        df = spark.read.schema(schema).format(fmt).load(path)
    return drop_na_literals(df) if na_literals == "drop" else df
