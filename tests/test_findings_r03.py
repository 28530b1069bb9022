"""What the findings of the third round asked for."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civiltext.functions import text as rules
from civiltext.operators import profile


def texts_of(spark, alphabet, n=3000, longest=14, seed=0):
    draw = random.Random(seed)
    rows = [(i, "".join(draw.choice(alphabet) for _ in range(draw.randint(0, longest)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None)], "row_id BIGINT, text STRING")


@pytest.mark.parametrize("name,alphabet", [
    ("email", ["a", "@", ".", " ", " "]), ("ip_addresses", ["1", "12", ".", "a", " ", "1.2.3.4"]),
    ("wiki_timestamps", ["12:34, May 5, 2006 (UTC)", "1", "(UTC)", " "]), ("double_quotes", ['"', "a"]),
    ("unicode_replacement", ["�", "a"]), ("repeated_punct", ["!", "?", "a"]),
])
def test_f6_quick_probes_hit_the_texts_of_the_plain_ones(spark, name, alphabet):
    pattern, text = profile.PROBES[name], F.col("text")
    rows = texts_of(spark, alphabet)
    assert rows.filter(~profile.occurs(text, pattern).eqNullSafe(text.rlike(pattern))).count() == 0
    assert rows.filter(text.rlike(pattern)).count() > 0


def test_f6_each_probe_runs_once_per_row(spark):
    rows = spark.createDataFrame([(1, "a")], "row_id BIGINT, text STRING").withColumn("text", F.concat("text", F.lit("!!!")))
    plan = profile.probe_patterns(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[!?]{3,}") == 1


def test_f13_f15_language_of_runs_counted_letter_by_letter(spark):
    rows = texts_of(spark, ["a", "Z", "я", "Ї", "1", " ", "é", "İ", "𝓲"])
    text = F.col("text")
    cyrillic, latin = (F.length(F.regexp_replace(text, f"[^{c}]", "")) for c in (rules.CYRILLIC, rules.LATIN))
    plain = F.when(text.isNull(), "unknown").when(cyrillic > latin, "Russian").when(latin > 0, "English").otherwise("Other")
    assert rows.filter(~rules.detect_language(text).eqNullSafe(plain)).count() == 0
    plan = rows.select(rules.detect_language(text))._jdf.queryExecution().optimizedPlan().toString()
    assert f"[^{rules.LATIN}]," not in plan  # a match per letter


def test_f11_f18_disguises_are_folded_once(spark):
    rows = spark.createDataFrame([(1, "i d i o t ｉｄｉｏｔ соrе aaan")], "row_id BIGINT, text STRING")
    undone = rows.select(rules.deobfuscate(F.concat("text", F.lit(" x"))).alias("text"))
    assert undone.first()["text"] == "idiot idiot core an x"
    assert undone._jdf.queryExecution().optimizedPlan().toString().count(rules.FORMS) == 1


def lists(rows):
    return pa.array(rows, pa.list_(pa.string()))


def test_f1_f2_f3_f12_a_batch_is_scored_in_bounded_parts(spark, monkeypatch):
    from civiltext.operators import linear

    words = lists([["a", "b"], [], None, ["b"] * 7, ["a", "c", "b", "a", "b"]])
    model = linear.LinearModel(linear.Vocabulary.of(["a", "b", "a b"], np.array([1.0, 2.0, 3.0])), np.array([0.5, -1.0, 2.0]), 0.25)
    whole = model.margins(words)
    monkeypatch.setattr(linear, "WORDS_AT_ONCE", 3)
    assert [len(p.flatten()) for p in linear.slices(words)] == [2, 7, 5]
    assert np.allclose(model.margins(words), whole) and np.allclose(model.margins(words.slice(3)), whole[3:])


def test_f7_f8_f9_f16_f17_batches_to_python_are_bounded(spark):
    from civiltext.operators import features

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 64 << 20)
    try:
        rows = spark.createDataFrame([(1, "a bb cc bb cc"), (2, "bb bb"), (3, None), (4, "cc")], "row_id BIGINT, text STRING")
        got = {r.term: (r.df, r.tf) for r in features.term_counts(features.tfidf_tokens(rows)).collect()}
        assert int(spark.conf.get(key)) <= 8 << 20
    finally:
        spark.conf.set(key, before)
    assert got == {"bb": (2, 4), "cc": (2, 3), "bb cc": (1, 2), "cc bb": (1, 1), "bb bb": (1, 1)}


def test_f10_weights_do_not_pass_the_stages(spark):
    from civiltext.operators import features

    rows = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (2, "bb cc"), (3, None), (4, "zz")], "row_id BIGINT, text STRING")
    fitted = features.fit_tfidf(rows, min_df=2, max_df=1.0)
    long = features.tfidf_rows(rows, fitted)
    assert "UDF(" not in long._jdf.queryExecution().optimizedPlan().toString()  # the stages are Scala UDFs
    got = Counter((r.row_id, r.term, round(r.weight, 6)) for r in long.collect())
    assert sum(got.values()) == 7 and got[(1, "bb", 1.0)] == 1 and all(n == 2 for (i, _, _), n in got.items() if i == 2)


def test_f5_saved_model_scores_trains_and_compares(spark):
    from civiltext.plans import models

    rows = models.saved_model_scores(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.same for r in rows) and {"row_id", "y", "split", "p_toxic", "pred"} < set(rows[0].asDict())


def test_f19_f20_tokens_are_hashed_as_spark_does(spark):
    from civiltext.functions.hashing import token_hash, token_hashes

    tokens = ["a", "b", "привет", "a", "😀", "é"]
    rows = spark.createDataFrame([(t,) for t in tokens], "token STRING").select("token", token_hash(F.col("token")).alias("h")).collect()
    assert dict(zip(tokens, token_hashes(pa.array(tokens)).tolist())) == {r.token: r.h for r in rows}


def test_op6_encodes_in_one_thread():
    import os

    from civiltext.llm import tokens

    os.environ.pop("TOKENIZERS_PARALLELISM", None)
    tokens._encoder.cache_clear()
    tokens._encoder(tokens.tokenizer_path())
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_f14_a_vocabulary_counts_only_terms_that_can_be_in_it(spark):
    from civiltext.operators import features

    draw = random.Random(5)
    often = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join([*draw.choices(often, k=40), *(f"x{i}y{j}" for j in range(30))])) for i in range(400)]
    terms = features.tfidf_tokens(spark.createDataFrame([*rows, *rows[:9], (401, None), (402, "")], "row_id BIGINT, text STRING")).cache()
    most = features.SHARES[0] * 50
    every = features.term_counts(terms).cache()
    sums = features.bucket_sums(terms)
    assert sums.sum() == every.agg(F.sum("tf")).first()[0]
    least = features._nth_largest(sums, most)
    few = {r.term: (r.df, r.tf) for r in features.term_counts(terms, sums >= least).collect()}
    assert len(few) < every.count() / 20 and few.items() <= {r.term: (r.df, r.tf) for r in every.collect()}.items()
    want = every.filter(f"df >= 2 AND df <= 0.8 * {terms.count()}").orderBy(F.desc("tf"), "term").limit(50).collect()
    got = features.vocabulary(terms, max_features=50, min_df=2).orderBy("position").collect()
    assert [(r.term, r.df, r.tf) for r in got] == [(r.term, r.df, r.tf) for r in want] and [r.position for r in got] == list(range(50))


@pytest.mark.parametrize("buckets,shares", [(1 << 4, (3, 30)), (1 << 10, ()), (1 << 20, (1,))])
def test_f14_a_vocabulary_is_whole_whatever_the_buckets(spark, monkeypatch, buckets, shares):
    from civiltext.operators import features

    monkeypatch.setattr(features, "BUCKETS", buckets)
    monkeypatch.setattr(features, "PARTS", 1 << 2)
    monkeypatch.setattr(features, "SHARES", shares)
    draw = random.Random(6)
    # the most frequent terms are in too many or too few rows, so the fullest buckets hold no term of the vocabulary
    rows = [(i, " ".join(["in every row"] * 9 + draw.choices([f"w{k}" for k in range(60)], k=20))) for i in range(100)]
    rows.append((100, "only here " * 3000))
    terms = features.tfidf_tokens(spark.createDataFrame(rows, "row_id BIGINT, text STRING")).cache()
    every = Counter({(r.term, r.df, r.tf): 1 for r in features.term_counts(terms).collect() if 5 <= r.df <= 0.8 * 101})
    for n in (4, 100, 10_000):
        got = [(r.term, r.df, r.tf) for r in features.vocabulary(terms, max_features=n).orderBy("position").collect()]
        assert got == sorted(every, key=lambda t: (-t[2], t[0]))[:n]


def test_f14_rows_without_a_partner_go_before_the_join(spark):
    from civiltext.operators.joins import sifted

    ids = [*range(0, 40_000), *range(-5, 0), *range(5), 2**62, None]
    rows = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "row_id BIGINT, text STRING")
    keys = spark.createDataFrame([(i,) for i in [*range(0, 40_000, 7), -3, 2**62, 7, 99_999, None]], "row_id BIGINT")
    few = sifted(rows, keys, "row_id")
    assert few.columns == rows.columns
    whole = rows.join(keys, "row_id")
    assert Counter(few.join(keys, "row_id").collect()) == Counter(whole.collect()) and few.count() < 1.1 * whole.count()
    assert sifted(rows, keys.limit(0), "row_id").count() == 0


def test_f14_chosen_rows_get_their_texts_back(spark, tmp_path):
    from civiltext.operators import sampling
    from civiltext.plans import inputs, models

    docs = [(i, f"s{i % 3}", f"text {i} {k}") for i in range(300) for k in range(1 + (i % 50 == 0))] + [(None, "s", "none")]
    marks = [(i, int(i % 9 == 0)) for i in range(200)] + [(i, 1) for i in (7, 50, 50, 9_999)]
    spark.createDataFrame(docs, "doc_id BIGINT, source STRING, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id BIGINT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    splits = sampling.balance_train_only(inputs.splits(spark, str(tmp_path)))
    names = ["row_id", "source", "text", "y", "split"]
    got = models._with_texts(spark, str(tmp_path), splits).select(names)
    assert Counter(got.collect()) == Counter(splits.select(names).collect()) and got.count() > 50
