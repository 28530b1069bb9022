"""Lines and CSV records of large files, in parallel, numbered in the order of files and lines.

A scan tags every line with its file and block and is stored; all further steps read the stored lines, so numbers and
texts come from one reading, whatever the cluster looks like at the next. Texts are not shuffled for numbering: a line has
its place in its block, and what lies before the block comes from one row per block.

A CSV cell may hold line breaks, so whether a line begins a record depends on all quotes before it in its file. A block is
read for both cases, as if it began between records and as if it began inside a quoted cell; each case has its own end.
The ends of the blocks, chained per file, then tell which case holds for each block. Records of one line, nearly all, stay
where they are; only lines of records with line breaks are shuffled, to be put together.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civiltext.session import cut_lineage

MOST_BLOCKS = 200_000  # rows of a broadcast; the lines of more blocks are joined by a shuffle

# A quoted cell ends at a quote that is not doubled; what follows it up to the next comma still belongs to the cell.
_INSIDE = r'(?:[^"]|"")*+'
_CELLS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|),)*+'
OPENED = re.compile(rf'{_CELLS}"{_INSIDE}', re.DOTALL)  # a line that begins a record and ends in a quoted cell
STILL_OPEN = re.compile(rf'{_INSIDE}(?:"[^,]*+,{_CELLS}"{_INSIDE})?', re.DOTALL)  # one that begins and ends in one
SCANNED = (
    "file string, block bigint, place bigint, value string, before_0 boolean, before_1 boolean, after_0 boolean, after_1 boolean, "
    "n_0 bigint, n_1 bigint"
)


def text_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """`(value, file, block)` as files hold them; a block is told by its first byte."""
    lines = spark.read.options(**options).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def with_blocks(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Stored `lines` with the columns of stored `blocks`, one row each; a broadcast up to `MOST_BLOCKS` of them."""
    few = blocks.count() <= MOST_BLOCKS
    return lines.join(F.broadcast(blocks) if few else blocks, ["file", "block"], "left")


def numbered_lines(lines: DataFrame) -> DataFrame:
    """`(row_id, value)` for `text_lines`: the place of each line in the order of files, by path, and lines."""
    tagged = cut_lineage(lines.withColumn("at", F.monotonically_increasing_id()))
    blocks = tagged.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # the blocks of a file, then one row per file
    inner = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    files = blocks.groupBy("file").agg(F.sum("n").alias("n"))
    outer = F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    zero = F.lit(0)
    files = files.select("file", F.coalesce(outer, zero).alias("of_file"))
    placed = blocks.select("file", "block", "first", F.coalesce(inner, zero).alias("in_file")).join(files, "file")
    shift = placed.select("file", "block", (F.col("of_file") + F.col("in_file") - F.col("first")).alias("shift"))
    return with_blocks(tagged, cut_lineage(shift)).select((F.col("shift") + F.col("at")).alias("row_id"), "value")


def _ends(value: str) -> tuple[bool, bool]:
    """Whether a line ends inside a quoted cell, if it begins outside and if it begins inside."""
    return OPENED.fullmatch(value) is not None, STILL_OPEN.fullmatch(value) is not None


def scan_records(lines: DataFrame) -> DataFrame:
    """Stored lines with their place in the block, and for both cases of its beginning (0: outside, 1: inside a cell) whether
    the line begins and ends inside a cell, and how many records have begun. Blank lines outside cells begin none."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun, place = None, [False, True], [0, 0], 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values, files, blocks = (batch.column(c) for c in ("value", "file", "block"))
            coded = files.dictionary_encode().indices.to_numpy()
            start = blocks.to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(coded) != 0) | (np.diff(start) != 0)) + 1).tolist(), n]
            blank = pc.is_in(values, value_set=pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
            quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
            places = np.empty(n, dtype=np.int64)
            before, after, counts = np.empty((2, n), bool), np.empty((2, n), bool), np.empty((2, n), dtype=np.int64)
            for low, high in zip(cuts, cuts[1:]):
                if (now := (files[low].as_py(), int(start[low]))) != key:
                    key, state, begun, place = now, [False, True], [0, 0], 0
                done = low
                for i in quoted[np.searchsorted(quoted, low) : np.searchsorted(quoted, high)].tolist():
                    ends = _ends(values[i].as_py())
                    for case in (0, 1):
                        before[case, done : i + 1] = after[case, done:i] = state[case]
                        state[case] = after[case, i] = ends[state[case]]
                    done = i + 1
                for case in (0, 1):
                    before[case, done:high] = after[case, done:high] = state[case]
                    counts[case, low:high] = begun[case] + np.cumsum(~before[case, low:high] & ~blank[low:high])
                    begun[case] = int(counts[case, high - 1])
                places[low:high] = place + np.arange(high - low)
                place += high - low
            yield pa.RecordBatch.from_arrays(
                [files, blocks, pa.array(places), values, *map(pa.array, (*before, *after, *counts))],
                names=[c.split()[0] for c in SCANNED.split(", ")],
            )

    return cut_lineage(lines.mapInArrow(scan, SCANNED))


def block_states(scanned: DataFrame) -> DataFrame:
    """Stored `(file, block, inside, earlier, of_files)`: whether a block begins inside a cell, records of its file begun before it,
    and data records, without the headers, in the files before."""
    last = F.max_by(F.struct("after_0", "after_1"), "place")
    blocks = scanned.groupBy("file", "block").agg(last.alias("end"), F.max("n_0").alias("n_0"), F.max("n_1").alias("n_1"))
    in_file = W.partitionBy("file").orderBy("block")
    # a block ends either in a state of its own, whatever it began with, or keeps or flips the one it began with
    fixed = (F.col("end.after_0") == F.col("end.after_1")).cast("int")
    blocks = blocks.withColumn("run", F.sum(fixed).over(in_file))
    flips = F.sum(F.col("end.after_0").cast("int")).over(W.partitionBy("file", "run").orderBy("block"))
    blocks = blocks.withColumn("ends", flips % 2 == 1)
    blocks = blocks.withColumn("inside", F.coalesce(F.lag("ends").over(in_file), F.lit(False)))
    blocks = blocks.withColumn("n", F.when(F.col("inside"), F.col("n_1")).otherwise(F.col("n_0")))
    zero = F.lit(0)
    earlier = F.coalesce(F.sum("n").over(in_file.rowsBetween(W.unboundedPreceding, -1)), zero)
    files = blocks.groupBy("file").agg(F.greatest(F.sum("n") - 1, zero).alias("n"))
    of_files = F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))  # one row per file
    files = files.select("file", F.coalesce(of_files, zero).alias("of_files"))
    return cut_lineage(blocks.select("file", "block", "inside", earlier.alias("earlier")).join(files, "file"))


def csv_records(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Records `(row_id, layout, record)` of CSV files, and the different headers `(header, a file with it)`.

    `row_id` is the place of a record in the order of files and lines, headers and blank lines not counted; `layout` says
    which header its file has.
    """
    scanned = scan_records(text_lines(spark, path, lineSep="\n", recursiveFileLookup="true"))
    states = block_states(scanned)

    def chosen(name: str):
        return F.when(F.col("inside"), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))

    def with_numbers(blocks: DataFrame) -> DataFrame:
        rows = with_blocks(scanned, blocks).withColumns({"before": chosen("before"), "after": chosen("after"), "number": F.col("earlier") + chosen("n")})
        return rows.filter(~(~F.col("before") & F.col("value").isin("", "\r")))

    def put_together(rows: DataFrame, *key: str) -> DataFrame:
        lines = F.array_sort(F.collect_list(F.struct("block", "place", "value")))
        return rows.groupBy(*key).agg(F.array_join(F.transform(lines, lambda x: x["value"]), "\n").alias("record"))

    first = with_numbers(states).filter("number = 1")
    headers = cut_lineage(put_together(first, "file").select("file", F.regexp_replace("record", r"\r\z", "").alias("header")))
    # one row per different header
    kinds = headers.groupBy("header").agg(F.min("file").alias("file")).orderBy("header").collect()
    if len(kinds) > 1:
        layouts = spark.createDataFrame([(r.header, i) for i, r in enumerate(kinds)], "header string, layout int")
        states = cut_lineage(states.join(headers.join(layouts, "header").select("file", "layout"), "file"))
    else:
        states = states.withColumn("layout", F.lit(0))
    rows = with_numbers(states).filter("number > 1").withColumn("row_id", F.col("of_files") + F.col("number") - 2)
    single = rows.filter("NOT before AND NOT after").select("row_id", "layout", F.col("value").alias("record"))
    several = put_together(rows.filter("before OR after"), "row_id", "layout")
    records = single.unionByName(several).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return records, [(r.header, r.file) for r in kinds]


def header_names(header: str) -> list[str]:
    return next(csv.reader(io.StringIO(header.removeprefix("﻿"), newline="")), [])
