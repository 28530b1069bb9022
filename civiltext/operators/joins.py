"""Joins of large tables: keys with very many rows, rows without a partner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiltext.session import cut_lineage

ROWS_PER_TASK = 1_000_000  # a key with more rows is hot
MOST_HOT = 20_000  # keys whose rows are joined by a broadcast, the largest ones
MARKS = 1 << 24  # bits that say which hashed keys occur, 2 MB whatever the table


def spread_join(facts: DataFrame, lookup: DataFrame, key: str, rows_per_task: int | None = None) -> DataFrame:
    """Equi-join of `facts` with a `lookup` unique on `key`, safe when few keys hold most facts.

    `lookup.n_rows` says how many facts its key has. The lookup rows of hot keys, those with more facts than a task
    should take, are broadcast, so that these facts are joined where they are; only the others are shuffled. The
    broadcast has at most `MOST_HOT` rows; any hot keys beyond are the smaller ones, and AQE splits those.
    """
    hot = lookup.filter(F.col("n_rows") > (rows_per_task or ROWS_PER_TASK)).orderBy(F.desc("n_rows")).limit(MOST_HOT)
    hot = cut_lineage(hot.drop("n_rows"))
    near = facts.join(F.broadcast(hot), key)
    far = facts.join(F.broadcast(hot.select(key)), key, "left_anti").join(lookup.drop("n_rows"), key)
    return near.unionByName(far)


def sifted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """`rows` without most of those whose key is not among `keys`, and without none of the others.

    The hashed keys are marked in bitmaps of a fixed size, which are stored once and broadcast, so that an equi-join
    afterwards shuffles few rows that have no partner.
    """
    at = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(MARKS)) + 1
    part, bit = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
    marks = cut_lineage(keys.groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(bit).alias("_marks")))
    byte = F.conv(F.hex(F.substring("_marks", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_part", part).join(F.broadcast(marks), "_part")
    return found.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select(rows.columns)
