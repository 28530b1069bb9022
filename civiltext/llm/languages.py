"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent letter n-grams (one to three letters, words padded by
blanks) of a language in order of frequency. A document is ranked the same way over its
whole text, and its distance to a language is the sum of how far each of its most frequent
n-grams stands out of place in that profile, where a missing n-gram counts as the most
possible. The nearest language wins, ties by name.

An n-gram is its code points side by side in one number, 21 bits each, so every alphabet keeps
its letters, and a document is counted by sorting numbers. Profiles are learned from at most
`PER_LANGUAGE` texts of each labelled language of at most `LONGEST` characters, those with the
smallest hash of the id, one language in a task; what reaches the driver is `PROFILE` numbers of
each. More than `MOST_LANGUAGES` labels are taken for a mistake in the column and refused.

A null text or one without a letter is `und` with score 0. A language without a training
text is never predicted; without any, all is `und`. The score is the lead of the nearest
language over the second, 0 to 1, times the share of the distance that is not the most
possible. Repeated rows and ties in the id stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civiltext.llm.common import bound_batches, chunks, documents, free_name, id_remainder, stored

UNKNOWN = "und"
PROFILE = 400
PER_LANGUAGE = 500
LONGEST = 30_000  # characters of a training text
MOST_LANGUAGES = 5_000
MOST_BROADCAST = 200_000  # rows of the sample's list, an id hash each; a longer one is joined by a shuffle
FAR = 0.9
_BLANK, _BITS = 0, 21
_NONE = (1 << _BITS) - 1  # no code point; in place of the first ones of a shorter n-gram


@dataclass(frozen=True)
class Profiles:
    names: list[str]
    grams: np.ndarray  # the n-grams of all profiles, in order, as often as there are profiles with it
    owners: np.ndarray  # whose profile it is
    ranks: np.ndarray  # its place there


def _letters(text: str) -> np.ndarray:
    """Code points in lower case; everything but letters becomes one blank between words."""
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "replace"), dtype=np.uint32)
    kept = _is_letter(points)
    keep = kept | np.concatenate(([False], kept[:-1]))  # a letter, or the first character after one
    return np.where(kept, points, 0)[keep]


_KNOWN: dict[int, bool] = {}
_TABLE = np.array([chr(i).isalpha() for i in range(0x3000)])


def _is_letter(points: np.ndarray) -> np.ndarray:
    low = points < len(_TABLE)
    out = _TABLE[np.where(low, points, 0)]
    if not low.all():
        for p in np.unique(points[~low]).tolist():
            if p not in _KNOWN:
                _KNOWN[p] = chr(p).isalpha()
        out[~low] = [_KNOWN[p] for p in points[~low].tolist()]
    return out


def _codes(points: np.ndarray) -> np.ndarray:
    """All n-grams of a text; one, two and three letters are different numbers."""
    s = np.concatenate(([_BLANK], points, [_BLANK])).astype(np.int64)
    two = (s[:-1] << _BITS) | s[1:]
    three = (two[:-1] << _BITS) | s[2:]
    one = s[s != _BLANK]
    two = two[(s[:-1] != _BLANK) | (s[1:] != _BLANK)]
    three = three[s[1:-1] != _BLANK]  # a blank in the middle would join words
    return np.concatenate((one | (_NONE << 2 * _BITS) | (_NONE << _BITS), two | (_NONE << 2 * _BITS), three))


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[starts], np.diff(np.append(starts, len(codes)))


def _top(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, ties by number."""
    return grams[np.argsort(-counts, kind="stable")[:PROFILE]]


def profile(texts: list[str | None]) -> np.ndarray:
    """The n-grams of a language in order of frequency; none if the texts have no letter."""
    points = [p for p in (_letters(t or "") for t in texts) if p.any()]
    if not points:
        return np.zeros(0, dtype=np.int64)
    found = [_counted(_codes(p)) for p in points]
    grams, which = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return _top(grams, np.bincount(which, weights=np.concatenate([n for _, n in found])).astype(np.int64))


def gathered(profiles: dict[str, np.ndarray]) -> Profiles:
    """Languages with a profile, by name."""
    names = sorted(name for name, own in profiles.items() if len(own))
    own = [np.asarray(profiles[name], dtype=np.int64) for name in names] or [np.zeros(0, dtype=np.int64)]
    grams = np.concatenate(own)
    owners = np.repeat(np.arange(len(own)), [len(p) for p in own])
    ranks = np.concatenate([np.arange(len(p)) for p in own])
    order = np.argsort(grams, kind="stable")
    return Profiles(names, grams[order], owners[order], ranks[order])


def fit(texts: list[str | None], languages: list[str]) -> Profiles:
    """Profiles of the given languages, which get names in order."""
    return gathered({name: profile([t for t, lang in zip(texts, languages) if lang == name]) for name in set(languages)})


def predict(model: Profiles, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """Language, score and distance (0 to 1, the most possible) of each text."""
    out = []
    for text in texts:
        points = _letters(text or "")
        if not points.any() or not model.names:
            out.append((UNKNOWN, 0.0, 1.0))
            continue
        top = _top(*_counted(_codes(points)))
        first = np.searchsorted(model.grams, top, side="left")
        times = np.searchsorted(model.grams, top, side="right") - first
        place = np.repeat(np.arange(len(top)), times)
        at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(len(place))
        # a missing n-gram counts PROFILE, each other one less
        nearer = np.bincount(model.owners[at], weights=PROFILE - np.abs(model.ranks[at] - place), minlength=len(model.names))
        moved = (PROFILE * len(top) - nearer) / (PROFILE * len(top))
        order = np.argsort(moved, kind="stable")
        best = moved[order[0]]
        second = moved[order[1]] if len(order) > 1 else 1.0
        lead = (second - best) / second if second > 0 else 0.0
        out.append((model.names[order[0]], float(lead * (1 - best)), float(best)))
    return out


def training_sample(docs: DataFrame, id_column: str, language: str, per_language: int = PER_LANGUAGE) -> DataFrame:
    """`(lang, text)`: at most `per_language` texts of `LONGEST` characters per language, those with the smallest hash of the id.

    The number of rows of each language tells below which hash four times as many are to be expected, so only
    about that many are ranked. Of rows with the same id the smallest text counts.
    """
    rows = docs.filter(F.col(language).isNotNull() & (F.length("text") <= LONGEST)).select(
        F.col(language).alias("lang"), "text", F.xxhash64(F.col(id_column).cast("string")).alias("h")
    )
    sizes = stored(rows.groupBy("lang").count(), "languages")
    if (n := sizes.count()) > MOST_LANGUAGES:
        raise ValueError(f"{n} different values of {language}; at most {MOST_LANGUAGES} languages are learned")
    share = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("count"))
    cuts = sizes.select("lang", ((share - 0.5) * float(2**64)).cast("bigint").alias("cut"))  # at most `MOST_LANGUAGES` rows
    near = rows.select("lang", "h").join(F.broadcast(cuts), "lang").filter("h <= cut").select("lang", "h").distinct()
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    chosen = stored(ranked.filter(F.col("rank") <= per_language).select("lang", "h"), "training-rows")
    few = chosen.count() <= MOST_BROADCAST
    return rows.join(F.broadcast(chosen) if few else chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))


def train(docs: DataFrame, id_column: str, language: str, per_language: int = PER_LANGUAGE) -> Profiles:
    """Profiles from a bounded sample of `docs`, each made in a task: what reaches the driver is `PROFILE` numbers per language."""
    def profiled(rows: pa.Table) -> pa.Table:
        own = profile(rows.column("text").to_pylist())
        return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()], pa.string()), "grams": pa.array([own.tolist()], pa.list_(pa.int64()))})

    sample = training_sample(docs, id_column, language, per_language).select(F.col("lang").cast("string").alias("lang"), "text")
    return gathered({r.lang: r.grams for r in sample.groupBy("lang").applyInArrow(profiled, "lang string, grams array<bigint>").collect()})


def identify(docs: DataFrame, model: Profiles, text: str = "text", into: str = "language") -> DataFrame:
    """`docs` with a column `into (lang_pred, score, distance)`, which takes the place of one of that name."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [row for part in chunks(texts) for row in predict(shared.value, part.to_pylist())]
            names, scores, distances = zip(*found) if found else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(distances, pa.float64())],
                names=["lang_pred", "score", "distance"],
            )

    return docs.withColumn(into, F.arrow_udf(scored, "lang_pred string, score double, distance double")(text))


def split_model(spark: SparkSession, docs: DataFrame) -> Profiles:
    """Profiles from the documents whose id leaves another remainder than 2 by 4."""
    return train(docs.filter(id_remainder("doc_id", 4) != 2), "doc_id", "lang")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = split_model(spark, docs)
    return identify(docs.drop("lang"), model).select(
        "doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "language.lang_pred", "language.score"
    )


def speaks_a_known_language(docs: DataFrame, model: Profiles, far: float = FAR) -> DataFrame:
    """The rows of `docs` that are in one of the languages: not `und`, and not as far from all profiles as foreign text."""
    name = free_name(docs, "language")
    judged = identify(docs, model, into=name)
    return judged.filter((judged[name]["lang_pred"] != UNKNOWN) & (judged[name]["distance"] < far)).drop(name)


QUERIES = {"op10_language": op10_language}
SQL: dict[str, str] = {}
