"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiltext.session import bound_batches, scratch_path  # noqa: F401

CHUNK = 2 << 20
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
OTHER, LETTER, NUMBER, BLANK = range(4)  # classes of characters


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written below the shared folder and read again: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores after it as it takes to be no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def id_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the given values only."""
    return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[pa.Array]:
    """Slices of at most `limit` bytes, or of one longer text: what Python holds of a batch is bounded by bytes, not by rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield texts.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def text_windows(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Parts of the bytes of one long text, cut between a visible ASCII character and a blank or line break; longer than
    `limit` only where there is no such place."""
    begin = 0
    while len(data) - begin > limit:
        end, reach = None, begin
        while end is None:
            part = data[reach : reach + limit]
            fit = np.flatnonzero(((part[1:] == 0x20) | (part[1:] == 0x0A)) & (part[:-1] > 0x20) & (part[:-1] < 0x7F))
            if len(fit):
                end = reach + int(fit[-1]) + 1
            elif reach + limit >= len(data):
                end = len(data)
            else:
                reach += limit - 1
        yield data[begin:end]
        begin = end
    if begin < len(data):
        yield data[begin:]


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point."""
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    everything, at = "".join(map(chr, points)), np.array(points)
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, everything):
            classes[at[run.start() : run.end()]] = kind
    return classes


def edges(counts: np.ndarray) -> np.ndarray:
    """Where stretches of these lengths begin, and where the last one ends."""
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of `flat` one after another."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large string or binary array without nulls, and the bounds of its values in them."""
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, dtype=np.uint8), bounds - bounds[0]
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]
