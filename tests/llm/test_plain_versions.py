"""Language and toxicity scores against plain versions of their definitions."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
import zstandard

from civiltext.llm import languages, toxicity

LETTERS = {"a": "aeiou tn", "b": "bdgkaö x", "c": "абвгд еи", "d": "한국어 말"}


def speech(rng, kind, n):
    return "".join(rng.choice(LETTERS[kind]) for _ in range(n)) + rng.choice(["", "!", " 12, ", "\n--"])


def plain_grams(text):
    """Counts of one to three letters of the words with a blank around, as tuples led by a number above all letters."""
    none, words, word = languages._NONE, [], []
    for c in text.lower() + " ":
        if c.isalpha():
            word.append(ord(c))
        elif word:
            words.append(word)
            word = []
    # words stand side by side with one blank between
    line = [0, *(x for w in words for x in (*w, 0))] if words else []
    grams = Counter((none, none, x) for x in line if x)
    grams.update((none, x, y) for x, y in zip(line, line[1:]) if x or y)
    grams.update((x, y, z) for x, y, z in zip(line, line[1:], line[2:]) if y)
    return grams


def top(grams):
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[: languages.PROFILE]]


def plain_languages(training, text):
    own = top(plain_grams(text))
    if not own:
        return ("und", 0.0, 1.0)
    distances = {}
    for name in sorted(training):
        profile = {g: i for i, g in enumerate(top(sum((plain_grams(t) for t in training[name]), Counter())))}
        out_of_place = [abs(profile[g] - i) if g in profile else languages.PROFILE for i, g in enumerate(own)]
        distances[name] = sum(out_of_place) / (languages.PROFILE * len(own))
    (best, name), (second, _) = sorted((d, n) for n, d in distances.items())[:2]
    lead = (second - best) / second if second else 0.0
    return name, lead * (1 - best), best


def test_languages_equal_the_plain_version():
    rng = random.Random(1)
    training = {k: [speech(rng, k, rng.randrange(5, 400)) for _ in range(6)] for k in LETTERS}
    rows = [(t, k) for k, texts in training.items() for t in texts]
    model = languages.fit([t for t, _ in rows], [k for _, k in rows])
    texts = ["", "123 ?!", *(speech(rng, rng.choice("abcd"), rng.randrange(1, 900)) for _ in range(60))]
    for text, got in zip(texts, languages.predict(model, texts)):
        expected = plain_languages(training, text)
        assert got[0] == expected[0] and got[1:] == pytest.approx(expected[1:], abs=1e-12)


def plain_toxicity(model, text):
    words = [w[i : i + toxicity.LONGEST] for w in text.lower().encode().split() for i in range(0, len(w), toxicity.LONGEST)]
    windows, run = [], b""
    for w in words:
        run += b" " * bool(run) + w
        if len(run) + 1 >= toxicity.WINDOW:
            windows.append(run)
            run = b""
    if run or not windows:
        windows.append(run)

    def size(content, window):
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(
            toxicity.LEVEL, window_log=toxicity.WINDOW_LOG, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=raw, compression_params=settings).compress(model.anchor + b" " + window + b" "))

    saved = sorted((size(model.ordinary, w) - size(model.toxic, w) for w in windows), reverse=True)
    counts = [sum(s >= k for s in saved) for k in toxicity.SAVED]
    x = [saved[0], sum(saved[:3]) / len(saved[:3]), sum(saved) / len(saved), math.log(len(saved)), *(c / len(saved) for c in counts), *map(math.log1p, counts)]
    z = sum((a - m) / s * w for a, m, s, w in zip(x, model.center, model.scale, model.weights)) + model.weights[-1]
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_toxicity_equals_the_plain_version():
    rng = random.Random(2)
    calm, harsh = ["river", "garden", "sunny", "evening", "walking", "letters"], ["idiotic", "worthless", "disgusting", "loathsome"]
    toxic = [" ".join(rng.choice(calm + harsh) for _ in range(rng.randrange(3, 40))) for _ in range(60)]
    ordinary = [" ".join(rng.choice(calm) for _ in range(rng.randrange(3, 40))) for _ in range(90)]
    model = toxicity.fit(toxic, ordinary, 600, 9000)
    texts = ["", "x" * 500, *toxic[:20], *ordinary[:20], *(t.upper() for t in toxic[:5])]
    for text in texts:
        assert toxicity.score(model, text) == pytest.approx(plain_toxicity(model, text), abs=1e-9)


def test_gradient_of_the_logistic_fit_vanishes():
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=(200, 4)), np.ones(200)]
    y, weight = (rng.random(200) < 0.3).astype(float), rng.random(200) + 0.5
    w = toxicity._logistic(x, y, weight)
    p = 1 / (1 + np.exp(-(x @ w)))
    assert np.abs(x.T @ (weight * (p - y)) + 0.1 * w).max() < 1e-6


def test_arrow_scores_are_those_of_the_model(spark):
    model = toxicity.fit(["awful awful nonsense", "such awful nonsense here"] * 4, ["a calm river", "the garden at noon"] * 4)
    texts = ["awful nonsense", "", None, "a calm river"]
    rows = toxicity.with_scores(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), model).collect()
    assert {r.id: r.score for r in rows} == {i: toxicity.score(model, t) for i, t in enumerate(texts)}
    assert pa.array([r.score for r in rows]).null_count == 0
