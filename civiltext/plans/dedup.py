"""Signatures, buckets, similarity and near-duplicate removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiltext.operators import dedup, profile
from civiltext.plans import inputs
from civiltext.plans.inputs import with_ctes


def signatures(spark, sf_dir):
    sig = dedup.minhash_signature(inputs.documents(spark, sf_dir))
    return sig.select("row_id", F.array_join("signature", ",").alias("signature"))


def sampled_signatures(spark, sf_dir):
    sig = dedup.sample_signatures(inputs.documents(spark, sf_dir), 500)
    return sig.select("row_id", F.array_join("signature", ",").alias("signature"))


def lsh_buckets(spark, sf_dir):
    return dedup.lsh_buckets(dedup.minhash_signature(inputs.documents(spark, sf_dir)))


def collision_leaders(spark, sf_dir):
    sig = dedup.cut_lineage(dedup.minhash_signature(inputs.documents(spark, sf_dir)))
    return dedup.collision_leaders(dedup.lsh_buckets(sig))


def hot_bucket_leaders(spark, sf_dir):
    """Leaders of buckets of which one holds a third of the rows, more than its tasks are to take."""
    bucket = F.when(F.col("row_id") % 3 == 0, F.lit("hot")).otherwise(F.col("source"))
    rows = inputs.documents(spark, sf_dir).select("row_id", bucket.alias("bucket"))
    return dedup.collision_leaders(rows, rows_per_task=60)


def collision_similarity(spark, sf_dir):
    sig = dedup.cut_lineage(dedup.minhash_signature(inputs.documents(spark, sf_dir)))
    pairs = dedup.collision_leaders(dedup.lsh_buckets(sig))
    return dedup.jaccard_estimate(pairs, sig).select("row_id", "leader", F.round("sim", 6).alias("sim"))


def near_duplicates(spark, sf_dir):
    """Ids that the first-row-wins walk drops."""
    docs = inputs.documents(spark, sf_dir)
    return dedup.dropped_ids(docs, dedup.kept_ids(dedup.minhash_signature(docs)))


def near_duplicates_loose(spark, sf_dir):
    """The same at the lowest threshold of the sweep, where rows wait for one another over several rounds."""
    docs = inputs.documents(spark, sf_dir)
    return dedup.dropped_ids(docs, dedup.kept_ids(dedup.minhash_signature(docs), dedup.SWEEP[0]))


def deduplicated_documents(spark, sf_dir):
    return dedup.deduplicate(inputs.documents(spark, sf_dir)).select("row_id", "source", F.md5("text").alias("text_md5"))


def deduplicated_counts(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir)
    kept = dedup.deduplicate(docs)
    stage = kept.agg(F.count("*").alias("after")).select(
        F.lit("dedup").alias("stage"), docs.agg(F.count("*")).scalar().alias("before"), "after"
    )
    counts = profile.with_dropped(stage)
    return counts.select("stage", "before", "after", "dropped", F.round("percent", 6).alias("percent"))


def threshold_sweep_of_dedup(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir)
    sweep = dedup.with_example_texts(dedup.dedup_sweep(docs), docs)
    return sweep.select(
        "threshold", "dropped", "remaining", F.round("gap", 6).alias("gap"), F.round("sim", 6).alias("sim"),
        "keeper", "dropped_row", "keeper_text", "dropped_text",
    )


QUERIES = {
    "minhash_signatures": signatures,
    "minhash_sampled_signatures": sampled_signatures,
    "lsh_buckets": lsh_buckets,
    "lsh_collision_leaders": collision_leaders,
    "hot_bucket_leaders": hot_bucket_leaders,
    "lsh_collision_similarity": collision_similarity,
    "near_duplicates": near_duplicates,
    "near_duplicates_loose": near_duplicates_loose,
    "deduplicated_documents": deduplicated_documents,
    "deduplicated_counts": deduplicated_counts,
    "dedup_threshold_sweep": threshold_sweep_of_dedup,
}

_leaders = """, leaders AS (SELECT bucket, min(row_id) AS leader FROM buckets GROUP BY bucket HAVING count(*) > 1),
star AS (
  SELECT b.row_id, l.leader, count(*) AS n_buckets FROM buckets b JOIN leaders l ON b.bucket = l.bucket
  WHERE b.row_id <> l.leader GROUP BY 1, 2)"""
_joined = "array_to_string(signature, ',') AS signature"

_plans = {dedup.band_plan(t): t for t in dedup.SWEEP}
_name = {plan: f"_{plan[0]}_{plan[1]}" for plan in _plans}
_sweep_ctes = ",\n".join(
    f"""{inputs.buckets_cte(t, _name[plan])},
{inputs.walk_ctes(_name[plan])},
examples{_name[plan]} AS (
  SELECT i, j, len(list_filter(range(1, 129), lambda k: a.signature[k] = b.signature[k]))::DOUBLE / 128 AS sim
  FROM (SELECT min(i) AS i, j FROM pairs{_name[plan]} WHERE i NOT IN (SELECT row_id FROM dropped{_name[plan]})
    AND j IN (SELECT row_id FROM dropped{_name[plan]}) GROUP BY j) p
  JOIN signatures a ON a.row_id = p.i JOIN signatures b ON b.row_id = p.j)"""
    for plan, t in _plans.items()
)
_sweep_rows = "\nUNION ALL\n".join(
    f"""SELECT {t}::DOUBLE AS threshold, (SELECT count(*) FROM dropped{n}) AS dropped,
  (SELECT count(*) FROM docs) - (SELECT count(*) FROM dropped{n}) AS remaining,
  round(e.gap, 6) AS gap, round(e.sim, 6) AS sim, e.i AS keeper, e.j AS dropped_row,
  (SELECT text FROM docs WHERE row_id = e.i) AS keeper_text, (SELECT text FROM docs WHERE row_id = e.j) AS dropped_text
FROM (SELECT 1) LEFT JOIN (
  SELECT *, abs(sim - {t}::DOUBLE) AS gap FROM examples{n} ORDER BY gap, i, j LIMIT 1) e ON true"""
    for t, n in ((t, _name[dedup.band_plan(t)]) for t in dedup.SWEEP)
)

SQL = {
    "hot_bucket_leaders": with_ctes(("docs",), """, b AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'hot' ELSE source END AS bucket FROM docs),
l AS (SELECT row_id, min(row_id) OVER (PARTITION BY bucket) AS leader FROM b)
SELECT row_id, leader, 1::BIGINT AS n_buckets FROM l WHERE row_id <> leader"""),
    "dedup_threshold_sweep": with_ctes(("signatures",), f",\n{_sweep_ctes}\n{_sweep_rows}", recursive=True),
    "near_duplicates_loose": with_ctes(
        ("signatures",),
        f""",
{inputs.buckets_cte(dedup.SWEEP[0])},
{inputs.walk_ctes()}
SELECT row_id FROM dropped""",
        recursive=True,
    ),
    "minhash_signatures": with_ctes(("signatures",), f"SELECT row_id, {_joined} FROM signatures"),
    "minhash_sampled_signatures": with_ctes(("signatures",), f"""SELECT row_id, {_joined} FROM signatures
ORDER BY md5('signatures:42:' || row_id), row_id LIMIT 500"""),
    "lsh_buckets": with_ctes(("buckets",), "SELECT row_id, band, bucket FROM buckets"),
    "lsh_collision_leaders": with_ctes(("buckets",), f"{_leaders} SELECT row_id, leader, n_buckets FROM star"),
    "lsh_collision_similarity": with_ctes(("buckets",), f"""{_leaders}
SELECT s.row_id, s.leader,
  round(len(list_filter(range(1, 129), lambda i: a.signature[i] = b.signature[i]))::DOUBLE / 128, 6) AS sim
FROM star s JOIN signatures a ON a.row_id = s.row_id JOIN signatures b ON b.row_id = s.leader"""),
    "near_duplicates": with_ctes(("dropped",), "SELECT row_id FROM dropped"),
    "deduplicated_documents": with_ctes(("dropped",), """SELECT row_id, source, md5(text) AS text_md5 FROM docs
WHERE row_id NOT IN (SELECT row_id FROM dropped)"""),
    "deduplicated_counts": with_ctes(("dropped",), """, c AS (
  SELECT (SELECT count(*) FROM docs) AS before, (SELECT count(*) FROM dropped) AS dropped)
SELECT 'dedup' AS stage, before, before - dropped AS after, dropped, round(dropped * 100.0::DOUBLE / before, 6) AS percent FROM c"""),
}
