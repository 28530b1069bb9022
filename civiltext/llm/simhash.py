"""Near-duplicates by SimHash, found through an index of byte positions.

A fingerprint has 64 bits, one per majority over the hashes of all shingles of a text. Two
fingerprints that differ in at most two bits differ in at most two of their eight bytes, so
they share at least six (position, byte) entries: six is the count every linked pair is
guaranteed to reach. Posting lists of single bytes would hold 1/256 of all rows each and
their pairs would grow with the square of the table, so the lists of six positions are
intersected beforehand: a fingerprint is listed under each of its 28 choices of six bytes.
The members of a list differ in two bytes only; each finds its at most 136 partners within
two bits of these in the list. How many lists a pair meets in tells its shared bytes: one
list is six of them, seven lists are seven. Lists are tallied per pair, pairs that reach
the count are kept, and their whole fingerprints are compared.

Equal fingerprints are one entry, however many rows they have.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiltext.llm.common import bound_batches, chunks, documents, stored
from civiltext.operators.components import connected_parts
from civiltext.operators.joins import spread_join

SHINGLE = 3
BITS = 2
HASH_SEED = 42
_FLIPS = [1 << i for i in range(16)]
_NEIGHBOURS = np.array(_FLIPS + [a ^ b for a, b in combinations(_FLIPS, 2)], dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles as an unsigned number; 0 for no words.

    ASCII letters count in lower case, words end at ASCII white space, fewer words than a shingle are one.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, HASH_SEED) for g in grams), dtype=">u8", count=len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 100_000):
        part = hashes[start : start + 100_000].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str, shingle: int = SHINGLE) -> DataFrame:
    """`(id, fp)`: fingerprints as signed 64-bit numbers. A null text has no words."""

    bound_batches(docs.sparkSession)
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = [fingerprint(t, shingle) for part in chunks(texts) for t in part.to_pylist()]
            yield pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_column).alias("id"), F.arrow_udf(signed, "bigint")("text").alias("fp"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _rest(fp: Column, low: int, high: int) -> Column:
    """The bytes at positions `low` and `high` (0 is the last byte) as one number of 16 bits."""
    def byte(k: int) -> Column:
        return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255))
    return byte(high) * 256 + byte(low)


def near_pairs(rests: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct sorted 16-bit numbers, the places of all pairs with one to `bits` differing bits, the smaller first."""
    if len(rests) <= 128:
        near = np.bitwise_count(rests[:, None] ^ rests[None, :]) <= bits
        return np.nonzero(np.triu(near, 1))
    place = np.full(1 << 16, -1, dtype=np.int64)
    place[rests] = np.arange(len(rests))
    first, second = [], []
    for step in _NEIGHBOURS[: 16 if bits == 1 else None]:
        there = place[rests ^ step]
        hit = there > np.arange(len(rests))  # also leaves out those that are not in the list
        first.append(np.flatnonzero(hit))
        second.append(there[hit])
    return np.concatenate(first), np.concatenate(second)


def links(unique: DataFrame) -> DataFrame:
    """Pairs `(a, b)` of different fingerprints `unique (fp)` that differ in at most two bits, each once."""
    lists = [
        F.struct(
            F.lit(n).alias("list"),
            F.col("fp").bitwiseAND(F.lit(_signed((1 << 64) - 1 - (255 << 8 * low) - (255 << 8 * high)))).alias("shared"),
            _rest(F.col("fp"), low, high).cast("int").alias("rest"),
        )
        for n, (low, high) in enumerate(combinations(range(8), 2))
    ]
    entries = unique.select(F.explode(F.array(*lists)).alias("e")).select("e.*")
    postings = entries.groupBy("list", "shared").agg(F.collect_list("rest").alias("rests")).filter(F.size("rests") > 1)
    places = np.array(list(combinations(range(8), 2)), dtype=np.int64)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shared, which = batch["shared"].to_numpy(), batch["list"].to_numpy()
            for i, members in enumerate(batch["rests"].tolist()):
                members = np.unique(np.asarray(members, dtype=np.int64))
                first, second = near_pairs(members)
                if len(first):
                    low, high = 8 * places[which[i]]
                    whole = shared[i] | ((members & 255) << low) | ((members >> 8) << high)
                    a, b = whole[first], whole[second]
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    tallied = postings.mapInPandas(meet, "a bigint, b bigint").groupBy("a", "b").agg(F.count("*").alias("lists"))
    shared_bytes = F.when(F.col("lists") >= 7, 7).when(F.col("lists") >= 1, 6).otherwise(0)
    reached = tallied.filter(shared_bytes >= 8 - BITS)
    return reached.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")


def near_duplicates(prints: DataFrame) -> DataFrame:
    """`(id, fp, component)` for stored rows `prints (id, fp)`: the smallest id that links reach from the row.

    A null id is reached by nothing and stands for a component only if it has no other id.
    """
    unique = stored(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n_rows")), "unique")
    # few bytes stand for much work: by number, which AQE leaves alone
    spread = unique.select("fp").repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    parts, _ = connected_parts(links(spread))
    roots = stored(parts.toDF("node", "root"), "roots")
    of_root = unique.join(roots, unique.fp == roots.node).groupBy("root").agg(F.min("least").alias("component"))
    linked = stored(roots.join(of_root, "root").select(F.col("node").alias("fp"), "component"), "linked")
    classes = unique.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"), "n_rows")
    return spread_join(prints, classes, "fp").select("id", "fp", "component")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have fingerprint 0. Repeated rows stay; an empty table gives no rows."""
    prints = stored(fingerprints(documents(spark, sf_dir), "doc_id"), "fingerprints")
    return near_duplicates(prints).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


QUERIES = {"op5_simhash": op5_simhash}
SQL: dict[str, str] = {}
