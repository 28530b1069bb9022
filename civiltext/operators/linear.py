"""Scoring texts with a TF-IDF and logistic regression model in one pass of arrays.

The fitted pipeline passes every text through seven row-wise stages. Its score needs less: words
come from a native expression, and numpy looks them and their pairs up, counts them per row and
sums weights, for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.sql import Column
from pyspark.sql import functions as F

from civiltext.functions.text import word_tokens


WORDS_AT_ONCE = 1 << 18  # words of which a task holds arrays of numbers at a time


def slices(lists: pa.ListArray, most: int | None = None) -> Iterator[pa.ListArray]:
    """Rows after rows of at most `most` values, or one row of more: what numpy holds is bounded, whatever a batch brings."""
    ends, start = lists.offsets.to_numpy().astype(np.int64)[1:], 0
    before = int(lists.offsets[0].as_py()) if len(lists) else 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(ends, before + (most or WORDS_AT_ONCE), side="right")))
        yield lists.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


@dataclass(frozen=True)
class Vocabulary:
    """Terms as words and as pairs of numbered words, with the idf of each."""

    words: pa.Array  # all words that occur in a term
    single: np.ndarray  # word number -> term number, -1 if the word is no term
    pairs: np.ndarray  # sorted keys of pairs
    pair_terms: np.ndarray  # their term numbers
    idf: np.ndarray

    @staticmethod
    def of(terms: list[str], idf: np.ndarray) -> Vocabulary:
        split = [t.split(" ") for t in terms]
        names = sorted({w for parts in split for w in parts})
        number = {w: i for i, w in enumerate(names)}
        single = np.full(len(names) + 1, -1, dtype=np.int64)  # the last one stands for unknown words
        keys, own = [], []
        for i, parts in enumerate(split):
            if len(parts) == 1:
                single[number[parts[0]]] = i
            else:
                keys.append(number[parts[0]] * len(names) + number[parts[1]])
                own.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        return Vocabulary(
            pa.array(names, pa.string()), single, np.array(keys, dtype=np.int64)[order], np.array(own, dtype=np.int64)[order],
            np.asarray(idf, dtype=np.float64),
        )

    def entries(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and count times idf of the terms in rows of words, by row and term, and the length of each row's vector."""
        edges = words.offsets.to_numpy().astype(np.int64)
        edges = edges - edges[0]
        n = len(words)
        found = pc.fill_null(pc.index_in(words.flatten().cast(pa.string()), value_set=self.words), len(self.words)).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(edges))
        terms = self.single[found]
        hit = terms >= 0
        keys = [row[hit] * len(self.idf) + terms[hit]]
        if len(found) > 1 and len(self.pairs):
            known = (found[:-1] < len(self.words)) & (found[1:] < len(self.words)) & (row[:-1] == row[1:])
            pair = found[:-1][known] * len(self.words) + found[1:][known]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            same = self.pairs[at] == pair
            keys.append(row[:-1][known][same] * len(self.idf) + self.pair_terms[at[same]])
        key = np.sort(np.concatenate(keys))
        if not len(key):
            return key, key, np.zeros(0), np.zeros(n)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        counts = np.diff(np.append(first, len(key)))
        row, term = np.divmod(key[first], len(self.idf))
        value = counts * self.idf[term]
        return row, term, value, np.sqrt(np.bincount(row, value * value, minlength=n))


@dataclass(frozen=True)
class LinearModel:
    """A vocabulary with a weight per term."""

    vocabulary: Vocabulary
    weights: np.ndarray
    intercept: float

    def margins(self, words: pa.ListArray) -> np.ndarray:
        """The linear score of each row of words."""
        scores = [np.zeros(0)]
        for part in slices(words):
            row, term, value, norm = self.vocabulary.entries(part)
            total = np.bincount(row, value * self.weights[term], minlength=len(part))
            scores.append(total / np.where(norm > 0, norm, 1.0) + self.intercept)
        return np.concatenate(scores)


def vocabulary_of(model: PipelineModel) -> Vocabulary | None:
    """The terms of a pipeline with TF-IDF stages; None for any other."""
    kinds = {type(s): s for s in model.stages}
    if not {CountVectorizerModel, ElementwiseProduct} <= set(kinds):
        return None
    return Vocabulary.of(kinds[CountVectorizerModel].vocabulary, kinds[ElementwiseProduct].getScalingVec().toArray())


def linear_model(model: PipelineModel) -> LinearModel | None:
    """The arrays of a pipeline of TF-IDF and binary logistic regression; None for any other."""
    kinds = {type(s): s for s in model.stages}
    terms = vocabulary_of(model)
    if terms is None or LogisticRegressionModel not in kinds:
        return None
    fitted = kinds[LogisticRegressionModel]
    return LinearModel(terms, fitted.coefficients.toArray(), float(fitted.intercept))


def toxic_probability(model: LinearModel, text: Column) -> Column:
    """p of class 1; null for a missing text."""

    def scored(words: pa.Array) -> pa.Array:
        p = 1 / (1 + np.exp(-model.margins(words)))
        scores = pa.array(p, mask=words.is_null().to_numpy(zero_copy_only=False))
        pa.default_memory_pool().release_unused()
        return scores

    return F.arrow_udf(scored, "double")(word_tokens(text))


def term_weights(terms: Vocabulary, text: Column) -> Column:
    """`array<struct<position, weight>>`: the terms of a text by their numbers, with count times idf scaled to length one."""

    def weighed(words: pa.Array) -> pa.Array:
        counts, positions, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for part in slices(words):
            row, term, value, norm = terms.entries(part)
            counts.append(np.bincount(row, minlength=len(part)))
            positions.append(term)
            weights.append(value / norm[row])
        pairs = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(positions).astype(np.int32)), pa.array(np.concatenate(weights))], names=["position", "weight"])
        bounds = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pairs)

    return F.arrow_udf(weighed, "array<struct<position:int,weight:double>>")(word_tokens(text))
