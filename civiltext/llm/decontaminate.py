"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words (letters and digits, lower case). Every
run of five words has a Karp-Rabin hash, its seed. Documents keep the seeds that pass a
filter of fixed size, made from the seeds of the benchmark, and are joined with the items on
equal seeds. For each pair the longest common run of words that are not marked yet is marked
in both, again and again, down to five words; a common run is a chain of equal seeds, so the
tiling needs the seeds only and texts are never shuffled. The share of an item's words that
are marked is its coverage; passages in another order cover as much as in the first one.

The filter is a bitmap of 2^24 bits whatever the benchmark holds: a larger benchmark lets
more seeds through to the join, which decides. A popular passage costs its occurrences:
seeds meet items, never documents.

A null text has no words; texts and items of fewer than five words match nothing. Rows with
the same id are compared each by itself and the largest coverage counts; a null id is an
id like others. An empty table on either side gives no rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiltext.llm.common import bound_batches, chunks, documents, stored

RUN = 5
AT_ONCE = 1 << 20  # stretches of diagonals
COVERAGE = 0.6
FILTER_BITS = 24
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)  # any odd number


def _seeds(texts: list[str | None], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of all texts one after another, and where each text's begin (one more entry at the end)."""
    words = [_WORD.findall((t or "").lower()) for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    coded = pa.array([w for own in words for w in own], pa.large_string()).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    tokens = hashes[coded.indices.to_numpy()] if len(hashes) else np.zeros(0, dtype=np.uint64)
    if len(tokens) < run:
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    rolled = np.zeros(len(tokens) - run + 1, dtype=np.uint64)
    for k in range(run):
        rolled = rolled * _BASE + tokens[k : len(tokens) - run + 1 + k]
    rolled ^= rolled >> np.uint64(29)
    rolled *= _BASE
    # runs that cross the end of a text go
    text_of = np.repeat(np.arange(len(texts)), counts)
    whole = text_of[: len(rolled)] == text_of[run - 1 :]
    bounds = np.concatenate(([0], np.cumsum(np.maximum(counts - run + 1, 0))))
    return rolled[whole].view(np.int64), bounds


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    start = 0
    for part in chunks(batch.column("text")):
        yield batch.slice(start, len(part))
        start += len(part)


def _slot(seeds: np.ndarray) -> np.ndarray:
    return (seeds.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def seed_lists(rows: DataFrame, keep: np.ndarray | None = None, run: int = RUN) -> DataFrame:
    """`rows (id, key, text)` as `(id, key, n_words, places, seeds)`; with a bitmap, only seeds that pass it and rows that have some."""
    bound_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(keep) if keep is not None else None

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            seeds, bounds = _seeds(batch.column("text").to_pylist(), run)
            at = np.arange(len(seeds))
            if shared is not None:
                slots = _slot(seeds)
                at = np.flatnonzero((shared.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1)
            cuts, counts = np.searchsorted(at, bounds), np.diff(bounds)
            rows = np.flatnonzero(np.diff(cuts) > 0) if shared is not None else np.arange(len(counts))
            # rows without seeds have empty slices, so the offsets of the rest stay as they are
            offsets = pa.array(np.append(cuts[rows], len(at)), pa.int32())
            places = pa.array(at - np.repeat(bounds[:-1], np.diff(cuts)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(rows)), batch.column("key").take(pa.array(rows)),
                    pa.array(np.where(counts[rows] > 0, counts[rows] + run - 1, 0), pa.int64()),
                    pa.ListArray.from_arrays(offsets, places), pa.ListArray.from_arrays(offsets, pa.array(seeds[at], pa.int64())),
                ],
                names=["id", "key", "n_words", "places", "seeds"],
            )

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "key", "text").mapInArrow(
        listed, f"id {id_type}, key bigint, n_words bigint, places array<bigint>, seeds array<bigint>"
    )


def seed_bitmap(seeds: DataFrame) -> np.ndarray:
    """2^24 bits, set for the seeds of `seeds (seed)`; summed up in Spark, of a fixed size on the driver."""
    slot = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    words = seeds.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63))")).alias("bits")
    )
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for row in words.collect():
        out[row.word] = row.bits
    return out.view(np.uint8)


def _stretches(places: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of one seed at consecutive places begin, how long they are, and the seed."""
    first = np.flatnonzero(np.concatenate(([True], (np.diff(seeds) != 0) | (np.diff(places) != 1))))
    return places[first], np.diff(np.append(first, len(seeds))), seeds[first]


def _joined(i: np.ndarray, j: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of diagonals, those that follow each other on one as one."""
    order = np.lexsort((i, i - j))
    i, j, long = i[order], j[order], long[order]
    if not len(i):
        return i, j, long
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(i - j) != 0) | (i[1:] != i[:-1] + long[:-1]))))
    return i[begins], j[begins], np.add.reduceat(long, begins)


def common_runs(places: np.ndarray, seeds: np.ndarray, item: np.ndarray, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of equal seeds at consecutive places of both: places in the document and in the item, and lengths.

    A run of one seed against another of it gives a stretch of every diagonal that crosses both, as many as both are long
    together; stretches that meet on a diagonal are one run. So a repeated word costs its number, not its square. Stretches
    of alternating seeds are as many as their pairs; about `at_once` are held at a time.
    """
    if not len(seeds) or not len(item):
        return (np.zeros(0, dtype=np.int64),) * 3
    at, size, seed = _stretches(places, seeds)
    to, length, other = _stretches(np.arange(len(item)), item)
    order = np.argsort(other, kind="stable")
    low = np.searchsorted(other[order], seed, side="left")
    times = np.searchsorted(other[order], seed, side="right") - low
    part = np.cumsum(times * (size + length.max())) // at_once
    found = []
    for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
        many = times[own]
        its = order[np.repeat(low[own] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        own = np.repeat(own, many)
        count = size[own] + length[its] - 1
        pair = np.repeat(np.arange(len(own)), count)
        t = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        n, m = size[own][pair], length[its][pair]
        i = at[own][pair] + np.maximum(0, t - m + 1)
        j = to[its][pair] + np.maximum(0, m - 1 - t)
        found.append(_joined(i, j, np.minimum(np.minimum(t + 1, n + m - 1 - t), np.minimum(n, m))))
    return _joined(*(np.concatenate(x) for x in zip(*found)))


def tiles(places: np.ndarray, seeds: np.ndarray, item: np.ndarray, run: int = RUN) -> list[tuple[int, int, int]]:
    """Greedy tiles `(document place, item place, words)` of a document's seeds at `places` and an item's seeds."""
    i, j, long = common_runs(places, seeds, item)
    heap = list(zip((-(long + run - 1)).tolist(), i.tolist(), j.tolist()))
    unmarked = len(item) + run - 1  # words of the item
    heapq.heapify(heap)
    in_doc, in_item, found = set(), set(), []
    while heap and unmarked >= run:
        length, i, j = heapq.heappop(heap)
        free = [k for k in range(-length) if i + k not in in_doc and j + k not in in_item]
        if len(free) == -length:
            found.append((i, j, -length))
            unmarked += length
            in_doc.update(range(i, i - length))
            in_item.update(range(j, j - length))
            continue
        # what is left between marked words goes back, to wait for its turn by length
        start = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - start >= run:
                    heapq.heappush(heap, (-(k - start), i + free[start], j + free[start]))
                start = k
    return found


def coverage(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """`(doc_id, item_id, coverage, n_tiles)` for pairs with a tile, from `docs (doc_id, text)` and `items (item_id, text)`."""
    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(name).alias("id"), F.xxhash64(F.col(name), "text").alias("key"), "text")

    tests = stored(seed_lists(rows(items, "item_id").distinct(), run=run), "items")
    test_seeds = tests.select(F.col("key").alias("item_key"), F.explode("seeds").alias("seed")).distinct()
    test_seeds = stored(test_seeds, "item-seeds")
    hits = stored(seed_lists(rows(docs, "doc_id"), seed_bitmap(test_seeds), run), "hits")
    found = hits.select("id", "key", F.explode(F.arrays_zip("places", "seeds")).alias("x")).select(
        "id", "key", F.col("x.places").alias("place"), F.col("x.seeds").alias("seed")
    )
    # rows that are equal in id and text are one document
    pairs = found.join(test_seeds, "seed").groupBy("id", "key", "item_key").agg(
        F.sort_array(F.collect_set(F.struct("place", "seed"))).alias("hits")
    )
    pairs = pairs.join(
        tests.select(F.col("id").alias("item_id"), F.col("key").alias("item_key"), "n_words", F.col("seeds").alias("item_seeds")), "item_key"
    ).select("id", "item_id", "n_words", F.col("hits.place").alias("places"), F.col("hits.seed").alias("seeds"), "item_seeds")
    id_type, item_type = (pairs.schema[c].dataType.simpleString() for c in ("id", "item_id"))

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("places", "seeds", "item_seeds")]
            marked = [tiles(*(column[i].values.to_numpy() for column in lists), run) for i in range(batch.num_rows)]
            words = np.array([sum(t[2] for t in m) for m in marked], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("item_id"), pa.array(words / batch.column("n_words").to_numpy()), pa.array([len(m) for m in marked], pa.int64())],
                names=["doc_id", "item_id", "coverage", "n_tiles"],
            )

    scored = pairs.mapInArrow(tiled, f"doc_id {id_type}, item_id {item_type}, coverage double, n_tiles bigint")
    return scored.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max_by("n_tiles", "coverage").alias("n_tiles"))


def contaminated(docs: DataFrame, items: DataFrame, least: float = COVERAGE, run: int = RUN) -> DataFrame:
    """The pairs of `coverage` that reach `least`: the document holds the item, in this or another order."""
    return coverage(docs, items, run).filter(F.col("coverage") >= least)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
SQL: dict[str, str] = {}
