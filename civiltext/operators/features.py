"""TF-IDF over words and word pairs.

Counting a vocabulary is two Arrow stages: sums of hashed terms, whose size is fixed, tell which terms
can be frequent enough, and only those are counted as strings and shuffled. Turning rows into vectors
is a per-row pipeline of JVM stages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from civiltext.functions.text import WORD, with_bigrams, word_tokens
from civiltext.operators.linear import slices, term_weights, vocabulary_of
from civiltext.session import bound_batches, cut_lineage

# Vectorizer settings of the studied model.
MAX_FEATURES, MIN_DF, MAX_DF = 10_000, 5, 0.8
COUNTS = ["term", "df", "tf"]

BUCKETS, PARTS = 1 << 20, 1 << 10  # sums of hashed terms, and the parts in which tasks hand them on
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)  # odd, for the hash of a pair
SHARES = (3, 30)  # fullest buckets per term of a vocabulary, whose terms are counted first, and next


def tfidf_tokens(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `words`, those of two or more characters, and `terms`: the words, then adjacent pairs of them."""
    return df.withColumn("words", word_tokens(F.col(text_col))).withColumn("terms", with_bigrams(F.col("words")))


def _counted(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different codes, the rows each occurs in, and its occurrences; `row` ascends."""
    order = np.argsort(codes, kind="stable")  # rows of a code stay in order
    codes, row = codes[order], row[order]
    new_code = np.concatenate(([True], codes[1:] != codes[:-1]))
    new_row = new_code | np.concatenate(([True], row[1:] != row[:-1]))
    first = np.flatnonzero(new_code)
    return codes[first], np.add.reduceat(new_row.astype(np.int64), first), np.diff(np.append(first, len(codes)))


def _row_of(lists: pa.ListArray) -> np.ndarray:
    """The row of each value."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda word: F.xxhash64(word))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By the leading bits; `buckets` is a power of two."""
    return (hashes >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first * MIX[0] + second) * MIX[1]


def bucket_sums(terms: DataFrame) -> np.ndarray:
    """Occurrences of the terms that share a hash, `BUCKETS` sums: none of a bucket's terms occurs more often.

    Each task adds up its rows in one array; its parts, of a fixed size like their sum, meet in a shuffle.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for lists in slices(batch.column(0)):
                hashes, row = lists.flatten().to_numpy().view(np.uint64), _row_of(lists)
                near = row[1:] == row[:-1]
                pairs = _pair_hashes(hashes[:-1][near], hashes[1:][near])
                sums += np.bincount(_bucket(np.concatenate([hashes, pairs]), BUCKETS), minlength=BUCKETS)
            pa.default_memory_pool().release_unused()
        parts = sums.reshape(-1, BUCKETS // PARTS)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["part", "sums"])

    def add(parts: pa.Table) -> pa.Table:
        sums = np.zeros(BUCKETS // PARTS, np.int64)
        for part in parts.column("sums"):
            sums += np.frombuffer(part.as_py(), np.int64)
        return pa.table({"part": parts.column("part")[:1], "sums": pa.array([sums.tobytes()], pa.binary())})

    bound_batches(terms.sparkSession)
    filled = terms.select(_hashed(F.col("words")).alias("hashes")).mapInArrow(fill, "part bigint, sums binary")
    total = np.zeros((PARTS, BUCKETS // PARTS), np.int64)
    for row in filled.groupBy("part").applyInArrow(add, "part bigint, sums binary").collect():  # 8 MB at most
        total[row["part"]] = np.frombuffer(row["sums"], np.int64)
    return total.ravel()


def term_counts(terms: DataFrame, chosen: np.ndarray | None = None) -> DataFrame:
    """`(term, df, tf)`: rows that contain the term and its occurrences, from the `words` of `tfidf_tokens`.

    With `chosen`, a flag per bucket, only the terms of the chosen buckets are counted; a pair is if its words are too.

    Only words and their hashes leave the JVM. A bounded number of rows is counted in arrays, pairs as numbers of their
    words, and each different term becomes a string once; sums meet in a single shuffle with map-side combination. Rows
    without words, or with null, count nowhere.
    """
    packed = np.packbits(np.ones(BUCKETS, bool) if chosen is None else chosen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed).view(bool)
        for batch in batches:
            for lists, hashed in zip(slices(batch.column(0)), slices(batch.column(1))):
                hashes, row = hashed.flatten().to_numpy().view(np.uint64), _row_of(lists)
                word = wanted[_bucket(hashes, len(wanted))]
                if not word.any():
                    continue
                coded = lists.flatten().filter(pa.array(word)).dictionary_encode()
                words, size = coded.dictionary, len(coded.dictionary)
                codes = np.zeros(len(word), np.int64)
                codes[word] = coded.indices.to_numpy()
                number, in_rows, times = _counted(codes[word], row[word])
                yield pa.RecordBatch.from_arrays([words.take(pa.array(number)), pa.array(in_rows), pa.array(times)], names=COUNTS)
                near = np.flatnonzero((row[1:] == row[:-1]) & word[1:] & word[:-1])
                near = near[wanted[_bucket(_pair_hashes(hashes[near], hashes[near + 1]), len(wanted))]]
                if len(near):
                    pair, in_rows, times = _counted(codes[near] * size + codes[near + 1], row[near])
                    first, second = (words.take(pa.array(part)) for part in np.divmod(pair, size))
                    joined = pc.binary_join_element_wise(first, second, " ")
                    yield pa.RecordBatch.from_arrays([joined, pa.array(in_rows), pa.array(times)], names=COUNTS)
            pa.default_memory_pool().release_unused()

    bound_batches(terms.sparkSession)
    sent = terms.select("words", _hashed(F.col("words")).alias("hashes"))
    counted = sent.mapInArrow(count, "term string, df bigint, tf bigint")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def idf(df_col: Column, n: Column | int) -> Column:
    """ln((1 + n) / (1 + df)) + 1."""
    return F.log((1 + n) / (1 + df_col)) + 1


def _nth_largest(sums: np.ndarray, n: int) -> int:
    """0 if there are fewer than n."""
    return int(np.partition(sums, -n)[-n]) if 0 < n <= len(sums) else 0


def vocabulary(
    terms: DataFrame, max_features: int = MAX_FEATURES, min_df: int = MIN_DF, max_df: float = MAX_DF
) -> DataFrame:
    """`(position, term, df, tf, idf)`: the most frequent terms within the document-frequency limits.

    Equal counts go by term. The result has at most `max_features` rows.

    Only terms of buckets with `least` occurrences are counted. If `max_features` of them occur that often, no other term
    does, and the result is whole; else `least` is lowered, at last to `min_df`, below which no term is kept.
    """
    n, sums = terms.count(), bucket_sums(terms)
    for share in (*SHARES, None):
        least = min_df if share is None else max(min_df, _nth_largest(sums, share * max_features))
        kept = cut_lineage(
            term_counts(terms, sums >= least).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
            .orderBy(F.desc("tf"), "term").limit(max_features)
        )
        if least <= min_df or kept.filter(F.col("tf") >= least).count() >= max_features:
            break
    position = F.row_number().over(W.orderBy(F.desc("tf"), "term")) - 1
    return kept.select(position.alias("position"), "term", "df", "tf", idf(F.col("df"), n).alias("idf"))


def term_stages(text_col: str = "text") -> list:
    return [
        RegexTokenizer(inputCol=text_col, outputCol="words", gaps=False, pattern=rf"{WORD}{{2,}}"),
        NGram(inputCol="words", outputCol="pairs", n=2),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
    ]


def tidy_stage(*columns: str) -> SQLTransformer:
    """Leaves out helper columns of a pipeline."""
    return SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(columns)}) FROM __THIS__")


def fit_tfidf(
    df: DataFrame, text_col: str = "text",
    max_features: int = MAX_FEATURES, min_df: int = MIN_DF, max_df: float = MAX_DF,
) -> PipelineModel:
    """Pipeline that adds `features`: raw counts times idf, scaled to length one.

    The vocabulary, at most `max_features` terms, becomes part of the model.
    """
    rows = vocabulary(tfidf_tokens(df, text_col), max_features, min_df, max_df).orderBy("position").collect()
    if not rows:
        raise ValueError("no term is left within the document-frequency limits")
    counts = CountVectorizerModel.from_vocabulary([r["term"] for r in rows], inputCol="terms", outputCol="counts")
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="counts", outputCol="weighted"
    )
    norm = Normalizer(inputCol="weighted", outputCol="features", p=2.0)
    return PipelineModel([*term_stages(text_col), counts, weigh, norm,
                          tidy_stage("words", "pairs", "terms", "counts", "weighted")])


def tfidf_rows(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Long form `(row_id, term, weight)` of the vectors, made in arrays."""
    terms = next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary
    bound_batches(df.sparkSession)
    long = df.select("row_id", F.explode(term_weights(vocabulary_of(model), F.col("text"))).alias("e"))
    names = df.sparkSession.createDataFrame(list(enumerate(terms)), "position INT, term STRING")
    return long.select("row_id", "e.position", "e.weight").join(
        F.broadcast(names), "position"  # at most max_features rows
    ).select("row_id", "term", "weight")
