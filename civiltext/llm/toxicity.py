"""Toxicity by compression distance.

Two zstandard dictionaries stand for the two classes. Both hold the commonest words of all
training texts; the toxic one adds the pieces of words that are over-represented in toxic
texts, the ordinary one as many bytes of further ordinary words. A text is cut into windows
of whole words, each window is compressed with either dictionary, and the bytes that the
toxic one saves tell how near the window is to toxic text. Windows start with an excerpt of
what both dictionaries hold, so that even a short one compresses. Shares and counts of
windows that save at least so many bytes, calibrated by a logistic regression, give the
score.

Matches of so short an input reach back about a kilobyte, so the dictionaries stay below that,
with the pieces at their end.

The model is trained from at most `TOXIC_ROWS` and `ORDINARY_ROWS` labelled rows with a text of
at most `LONGEST_TEXT` characters, those with the smallest hash of the id, weighed to the
numbers of all labelled rows; so the driver gets a bounded number of bytes. Its dictionaries
have the same few bytes whatever the corpus holds. All windows of all texts are scored.

A null text counts as empty and has one empty window. Of several labels of an id the largest
counts, null labels and labels without a document are left out. Without rows of both classes
every score is the share of toxic rows, 0 if there are none. Repeated rows stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiltext.llm.common import bound_batches, chunks, documents, id_remainder, stored

TOXIC_ROWS = 1500
ORDINARY_ROWS = 4500
LONGEST_TEXT = 20_000  # characters of a training text
WINDOW = 24  # bytes at which a window is full
LONGEST = 48  # longer words are cut
LEVEL, WINDOW_LOG = 1, 12
COMMON_WORDS = 100
PIECES = 60
GRAMS = (5, 7)
LEAST = 5  # occurrences of a piece, up to three per text
RATIO = 8.0  # by which it must be over-represented
ANCHOR = 64
SAVED = (2, 3, 4, 5, 6)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    anchor: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    _compressors: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_compressors": []}

    def savings(self, windows: list[bytes]) -> np.ndarray:
        """Bytes per window by which the toxic dictionary compresses better."""
        if not self._compressors:
            self._compressors = [_compressor(d) for d in (self.ordinary, self.toxic)]
        ordinary, toxic = (c.compress for c in self._compressors)
        lengths = (len(ordinary(w)) - len(toxic(w)) for w in (self.anchor + x for x in windows))
        return np.fromiter(lengths, dtype=np.int32, count=len(windows))


@dataclass(frozen=True)
class Constant:
    share: float


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, window_log=WINDOW_LOG, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def words_of(text: str | None) -> list[bytes]:
    words = (text or "").lower().encode().split()
    if any(len(w) > LONGEST for w in words):
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def windows_of(words: list[bytes]) -> list[bytes]:
    """Runs of whole words, each as short as it can be with `WINDOW` bytes, with blanks around."""
    out, run, size = [], [], 0
    for w in words:
        run.append(w)
        size += len(w) + 1
        if size >= WINDOW:
            out.append(b" %b " % b" ".join(run))
            run, size = [], 0
    if run or not out:
        out.append(b" %b " % b" ".join(run))
    return out


def _grams(word: bytes) -> Iterable[bytes]:
    for n in GRAMS:
        for i in range(len(word) - n + 1):
            yield word[i : i + n]


def _counted(texts: list[list[bytes]], among: set[bytes] | None = None) -> tuple[Counter, int]:
    """Occurrences of byte n-grams of words with blanks around, up to three per text, and of all n-grams."""
    counts, total = Counter(), 0
    for words in texts:
        own = Counter(g for w in words for g in _grams(b" %b " % w))
        total += sum(min(v, 3) for v in own.values())
        counts.update({g: min(v, 3) for g, v in own.items() if among is None or g in among})
    return counts, total


def distinctive_pieces(toxic: list[list[bytes]], ordinary: list[list[bytes]], most: int = PIECES) -> list[bytes]:
    """Parts of words that consist of n-grams over-represented in `toxic`, most frequent first."""
    ones, n_ones = _counted(toxic)
    ones = {g: v for g, v in ones.items() if v >= LEAST}
    others, n_others = _counted(ordinary, set(ones))
    chosen = {g for g, v in ones.items() if v * n_others >= RATIO * (others[g] + 1) * n_ones}
    pieces = Counter()
    for words in toxic:
        own = Counter()
        for w in set(words):
            w = b" %b " % w
            places = [(i, i + n) for n in GRAMS for i in range(len(w) - n + 1) if w[i : i + n] in chosen]
            if places:
                own[w[min(a for a, _ in places) : max(b for _, b in places)]] += 1
        pieces.update({p: min(v, 2) for p, v in own.items()})
    return [p for p, _ in sorted(pieces.items(), key=lambda x: (-x[1], x[0]))[:most]]


def measures(saved: np.ndarray) -> list[float]:
    top = np.sort(saved)[::-1]
    counts = [(saved >= s).sum() for s in SAVED]
    return [top[0], top[:3].mean(), saved.mean(), np.log(len(saved)), *(c / len(saved) for c in counts), *np.log1p(counts)]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps with a ridge; the last column of `x` is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[str | None], ordinary: list[str | None], n_toxic: int | None = None, n_ordinary: int | None = None) -> Model | Constant:
    """A model from texts of either class that stand for `n_toxic` and `n_ordinary` ones."""
    n_toxic, n_ordinary = n_toxic or len(toxic), n_ordinary or len(ordinary)
    if not toxic or not ordinary:
        return Constant(n_toxic / (n_toxic + n_ordinary) if toxic else 0.0)
    ones, others = [words_of(t) for t in toxic], [words_of(t) for t in ordinary]

    def unique(texts: list[list[bytes]]) -> list[list[bytes]]:
        return list({b" ".join(t): t for t in texts}.values())

    pieces = distinctive_pieces(unique(ones), unique(others))
    counts = Counter(w for t in [*ones, *others] for w in t)
    words = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    shared = b" ".join(words[:COMMON_WORDS][::-1])
    special = b"".join(pieces[::-1])
    further = b" ".join(words[COMMON_WORDS : COMMON_WORDS + 5 * PIECES])[: len(special)]
    anchor = shared[-ANCHOR:]
    # a dictionary of under eight bytes is none
    model = Model(*(shared + c + b" " * 8 for c in (special, further)), anchor, *(np.zeros(0),) * 3)
    x = np.array([measures(model.savings(windows_of(t))) for t in [*ones, *others]])
    y = np.repeat([1.0, 0.0], [len(ones), len(others)])
    weight = np.repeat([n_toxic / len(ones), n_ordinary / len(others)], [len(ones), len(others)])
    weight *= len(y) / weight.sum()
    model.center, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = _logistic(np.c_[(x - model.center) / model.scale, np.ones(len(x))], y, weight)
    return model


def score(model: Model | Constant, text: str | None) -> float:
    if isinstance(model, Constant):
        return model.share
    x = (np.array(measures(model.savings(windows_of(words_of(text))))) - model.center) / model.scale
    return float(1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30))))


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model | Constant:
    """A model from `docs (doc_id, text)` and `labels (doc_id, toxic)`; at most the two numbers of texts, of bounded length, reach the driver."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stored(known.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))), "labels")
    n = {r.toxic == 1: r["count"] for r in known.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).count().collect()}
    fitting = docs.filter(F.length(F.coalesce("text", F.lit(""))) <= LONGEST_TEXT)
    there = known.join(fitting.select("doc_id"), "doc_id", "left_semi")
    chosen = there.filter("toxic = 1").orderBy("h", "doc_id").limit(toxic_rows).unionByName(
        there.filter("toxic <> 1").orderBy("h", "doc_id").limit(ordinary_rows)
    )
    # bounded by the two numbers of rows; of rows with the same id the smallest text counts
    texts = fitting.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text")).collect()
    texts.sort(key=lambda r: (r.h, r.doc_id))
    return fit([r.text for r in texts if r.toxic == 1], [r.text for r in texts if r.toxic != 1], n.get(True), n.get(False))


def with_scores(docs: DataFrame, model: Model | Constant, text: str = "text", into: str = "score") -> DataFrame:
    """`docs` with a column `into`, which takes the place of one of that name."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([score(shared.value, t) for part in chunks(texts) for t in part.to_pylist()], pa.float64())

    return docs.withColumn(into, F.arrow_udf(scored, "double")(text))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(id_remainder("doc_id", 5) != 0)
    scores = with_scores(docs, train(docs, labels)).select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score")
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
