"""Hard negatives for contrastive training, found through summaries of vector segments.

A vector is cut into segments, at several levels of ever shorter ones, and of each segment the mean and the deviation are
stored. Over a segment of n components the inner product of two vectors lies within n times (the product of the means plus
or minus the product of the deviations). The sums of these bounds over the segments rule out most rows for an anchor; what
is left is bounded again by the next level, and what is left of that is scored exactly.

Rows are packed into blocks of a few MB with their summaries and stored; anchors likewise. Every block of anchors meets
every block of rows: first for the nearest rows of the anchor's own label, its positives, then for the rows of other labels
whose score lies between two shares of a positive's score. A pair of blocks yields the best few rows of each anchor, so
nothing grows with the square of the table, and Spark's ranking merges them, keeping as many per task before it shuffles.

Vectors have integer components. Shorter ones count as filled up with zeros. Rows without label, vector, or with a null or
non-finite component take no part. A null id is no anchor and comes last among equal scores; rows of equal id are different
rows, and each is an anchor of its own. Scores are exact, and beyond the range of a long they count as the largest long, with their sign. An anchor
without rows of its label, or with a negative positive score, has no negatives. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civiltext.llm.common import bound_batches, stored

BLOCK_ROWS, BLOCK_BYTES = 4096, 2 << 20
ANCHORS_AT_ONCE = 256
BRANCH = 4  # a segment is cut into so many at the next level
SHORTEST = 4  # components of a segment
DENSE = 0.1  # share of open pairs from which a whole product is cheaper than single ones
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = (30, 100), (90, 100)  # shares of the positive's score
EXACT = float(1 << 53)
LARGEST = (1 << 63) - 1
BLOCK = ("uid", "id", "has_id", "label", "vector", "mean", "dev", "p_score", "p_id", "p_has")
KINDS = dict(zip(BLOCK, ("<i8", "<i8", "u1", "<i8", "<f8", "<f8", "<f8", "<i8", "<i8", "i1")))
CANDIDATE = "anchor bigint, anchor_id bigint, place int, positive_id bigint, positive_score bigint, id bigint, score bigint"


def segment_edges(width: int) -> list[np.ndarray]:
    """Per level the begins of its segments: one of the whole width, then four times as many, down to four components."""
    levels, n = [], 1
    while width:
        levels.append(np.unique(np.arange(n) * width // n))
        if width // (n * BRANCH) < SHORTEST:
            break
        n *= BRANCH
    return levels


def summaries(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments, level after level; both times the root of the segment's length."""
    means, devs = [np.zeros((len(vectors), 0))], [np.zeros((len(vectors), 0))]
    for edges in segment_edges(vectors.shape[1]):
        sizes = np.diff(np.append(edges, vectors.shape[1]))
        mean = np.add.reduceat(vectors, edges, axis=1) / sizes
        spread = np.add.reduceat((vectors - np.repeat(mean, sizes, axis=1)) ** 2, edges, axis=1)
        means.append(mean * np.sqrt(sizes))
        devs.append(np.sqrt(spread))
    return np.concatenate(means, axis=1), np.concatenate(devs, axis=1)


def _pack(rows: DataFrame, width: int, positives: int) -> DataFrame:
    """Blocks of `rows (uid, id, label, vector, p_score, p_id)`, one row each."""
    at_most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))

    def numbers(column: pa.Array, missing: int = 0) -> np.ndarray:
        return column.fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64)

    def padded(column: pa.Array, size: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of lists filled up with zeros, whether there is one, and whether it is not null."""
        out, there, known = np.zeros((len(column), size), kind), np.zeros((len(column), size), bool), np.zeros((len(column), size), bool)
        counts = np.diff(column.offsets.to_numpy())
        row = np.repeat(np.arange(len(column)), counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        values = column.flatten()
        there[row, place] = True
        known[row, place] = values.is_valid().to_numpy(zero_copy_only=False)
        out[row, place] = values.fill_null(0).to_numpy(zero_copy_only=False)
        return out, there, known

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_most):
                part = batch.slice(start, at_most)
                ids = part.column("id")
                vector, _, _ = padded(part.column("vector"), width, "<f8")
                p_score, p_there, _ = padded(part.column("p_score"), positives, "<i8")
                p_id, _, p_known = padded(part.column("p_id"), positives, "<i8")
                mean, dev = summaries(vector)
                columns = {
                    "uid": numbers(part.column("uid")), "id": numbers(ids), "has_id": ids.is_valid().to_numpy(zero_copy_only=False),
                    "label": numbers(part.column("label")), "vector": vector, "mean": mean, "dev": dev,
                    "p_score": p_score, "p_id": p_id, "p_has": p_there.astype("i1") + p_known,  # 0: none, 1: with a null id, 2
                }
                yield pa.RecordBatch.from_pydict({k: [columns[k].astype(KINDS[k]).tobytes()] for k in BLOCK}, schema=pa.schema([(k, pa.binary()) for k in BLOCK]))

    return rows.select("uid", "id", "label", "vector", "p_score", "p_id").mapInArrow(pack, ", ".join(f"{k} binary" for k in BLOCK))


class _Block:
    """A block as arrays."""

    def __init__(self, row: dict[str, bytes], width: int):
        n = len(row["uid"]) // 8
        for name in BLOCK:
            setattr(self, name, np.frombuffer(row[name], dtype=KINDS[name]))
        self.vector = self.vector.reshape(n, width)
        shape = (n, -1) if len(self.mean) else (n, 0)
        self.mean, self.dev = self.mean.reshape(shape), self.dev.reshape(shape)
        self.p_score, self.p_id, self.p_has = (x.reshape(n, -1) if len(x) else x.reshape(n, 0) for x in (self.p_score, self.p_id, self.p_has))
        self.norm = np.sqrt((self.vector**2).sum(axis=1))
        self.largest = float(np.abs(self.vector).max(initial=0))


def _products(left: np.ndarray, right: np.ndarray, open_pairs: np.ndarray) -> np.ndarray:
    """Inner products of the open pairs; what stands at others is of no use."""
    if open_pairs.mean() > DENSE:
        return left @ right.T
    out, (i, j) = np.zeros(open_pairs.shape), np.nonzero(open_pairs)
    for k in range(0, len(i), 1 << 16):
        a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        out[a, b] = np.einsum("ps,ps->p", left[a], right[b])
    return out


def _exact(left: np.ndarray, right: np.ndarray, largest: float, open_pairs: np.ndarray) -> np.ndarray:
    """Scores of the open pairs as whole numbers; `largest` is the largest product of two components."""
    if left.shape[1] * largest < EXACT:
        return _products(left, right, open_pairs).astype(np.int64)
    out = np.zeros(open_pairs.shape, dtype=np.int64)
    for i, j in zip(*(x.tolist() for x in np.nonzero(open_pairs))):
        score = sum(int(x) * int(y) for x, y in zip(left[i].tolist(), right[j].tolist()))
        out[i, j] = min(max(score, -LARGEST), LARGEST)
    return out


def _best(scores: np.ndarray, wanted: np.ndarray, rows: _Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of the k best wanted rows per anchor: by score, then by id, null ids last."""
    i, j = np.nonzero(wanted)
    order = np.lexsort((rows.id[j], 1 - rows.has_id[j], -scores[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first]


def _kth(scores: np.ndarray, wanted: np.ndarray, k: int, least) -> np.ndarray:
    """Per anchor its k-th largest wanted score, `least` where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), least, dtype=scores.dtype)
    return np.partition(np.where(wanted, scores, least), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _refined(anchors: _Block, at: slice, rows: _Block, width: int, open_pairs: np.ndarray, rule_out) -> np.ndarray:
    """The pairs that no level rules out; `rule_out(lower, upper, open_pairs)` gives those that stay."""
    column = 0
    slack = 1e-9 * np.outer(anchors.norm[at], rows.norm) + 1e-6  # for rounding
    for edges in segment_edges(width):
        if not open_pairs.any():
            break
        level = slice(column, column + len(edges))
        column += len(edges)
        middle = _products(anchors.mean[at, level], rows.mean[:, level], open_pairs)
        spread = _products(anchors.dev[at, level], rows.dev[:, level], open_pairs) + slack
        open_pairs = rule_out(middle - spread, middle + spread, open_pairs)
    return open_pairs


def _met(rows: DataFrame, anchors: DataFrame, width: int, search) -> DataFrame:
    """`search(anchors, slice, rows, memory)` over every pair of blocks; `memory` lasts for a task, per block of anchors."""
    left = rows.select(*[F.col(c).alias(f"r_{c}") for c in BLOCK[:7]])
    # a set of queries against all rows, block by block: each pair stands for millions of scores
    pairs = left.crossJoin(anchors)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, dict] = {}
        for batch in batches:
            for pair in batch.to_pylist():
                block = _Block({c: pair.get(f"r_{c}", b"") for c in BLOCK}, width)
                own = _Block({c: pair[c] for c in BLOCK}, width)
                seen = memory.setdefault(pair["uid"][:8], {})
                for start in range(0, len(own.uid), ANCHORS_AT_ONCE):
                    yield from search(own, slice(start, start + ANCHORS_AT_ONCE), block, seen)

    return pairs.mapInArrow(meet, CANDIDATE)


def _candidates(anchors: _Block, at: slice, i: np.ndarray, j: np.ndarray, scores: np.ndarray, rows: _Block, place=None) -> pa.RecordBatch:
    own = i + at.start
    nothing = pa.nulls(len(i), pa.int64())
    positive = (nothing, nothing) if place is None else (
        pa.array(anchors.p_id[own, place], mask=anchors.p_has[own, place] < 2), pa.array(anchors.p_score[own, place]))
    columns = [
        pa.array(anchors.uid[own]), pa.array(anchors.id[own], mask=anchors.has_id[own] == 0), pa.array(np.full(len(i), place or 0, dtype=np.int32)),
        *positive, pa.array(rows.id[j], mask=rows.has_id[j] == 0), pa.array(scores[i, j]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CANDIDATE.split(", ")])


def _search_positives(width: int, k: int):
    def search(anchors: _Block, at: slice, rows: _Block, seen: dict) -> Iterator[pa.RecordBatch]:
        wanted = (anchors.label[at, None] == rows.label) & (anchors.uid[at, None] != rows.uid)
        known = seen.setdefault(at.start, np.full(len(wanted), -np.inf))  # the k-th best so far

        def rule_out(lower, upper, open_pairs):
            least = np.maximum(known, _kth(lower, open_pairs, k, -np.inf))
            return open_pairs & (upper >= least[:, None])

        wanted = _refined(anchors, at, rows, width, wanted, rule_out)
        scores = _exact(anchors.vector[at], rows.vector, anchors.largest * rows.largest, wanted)
        i, j = _best(scores, wanted, rows, k)
        if len(i):
            full = np.bincount(i, minlength=len(known)) == k
            last = np.searchsorted(i, np.arange(len(known)), side="right") - 1
            known[full] = np.maximum(known[full], scores[i, j][last[full]].astype(float))
            yield _candidates(anchors, at, i, j, scores, rows)

    return search


def _search_negatives(width: int, k: int, low: tuple[int, int], high: tuple[int, int]):
    def bound(scores: np.ndarray, share: tuple[int, int], up: bool) -> np.ndarray:
        """The least whole number at or above a share of the scores, or the largest at or below it."""
        whole = [-(-share[0] * s // share[1]) if up else share[0] * s // share[1] for s in scores.ravel().tolist()]
        return np.array(whole, dtype=np.int64).reshape(scores.shape)

    def search(anchors: _Block, at: slice, rows: _Block, seen: dict) -> Iterator[pa.RecordBatch]:
        wanted = anchors.label[at, None] != rows.label
        least, most = bound(anchors.p_score[at], low, True), bound(anchors.p_score[at], high, False)
        there = anchors.p_has[at] > 0
        known = seen.setdefault(at.start, np.where(there, least, 0))  # the k-th best so far, or the lower limit

        def rule_out(lower, upper, open_pairs):
            inside = np.zeros_like(open_pairs)
            for p in range(known.shape[1]):
                inside |= there[:, p, None] & (upper >= known[:, p, None]) & (lower <= most[:, p, None])
            return open_pairs & inside

        wanted = _refined(anchors, at, rows, width, wanted, rule_out)
        scores = _exact(anchors.vector[at], rows.vector, anchors.largest * rows.largest, wanted)
        for p in range(known.shape[1]):
            inside = wanted & there[:, p, None] & (scores >= known[:, p, None]) & (scores <= most[:, p, None])
            # of many equal rows only those at or above the k-th best are put in order
            inside &= scores >= _kth(scores, inside, k, -LARGEST)[:, None]
            i, j = _best(scores, inside, rows, k)
            if len(i):
                full = np.bincount(i, minlength=len(known)) == k
                last = np.searchsorted(i, np.arange(len(known)), side="right") - 1
                known[full, p] = np.maximum(known[full, p], scores[i, j][last[full]])
                yield _candidates(anchors, at, i, j, scores, rows, p)

    return search


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: tuple[int, int] = LOW, high: tuple[int, int] = HIGH,
) -> DataFrame:
    """`(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)` for `rows (id, label, vector)`.

    `vector` holds whole numbers as doubles. Positives are the `positives` other rows of the anchor's label with the
    highest scores; negatives the first `negatives` rows of other labels with scores between the two shares of the positive's.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    nobody = F.array().cast("array<bigint>")
    taking = rows.filter(F.col("label").isNotNull() & usable(F.col("vector"))).select(
        F.monotonically_increasing_id().alias("uid"), F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"),
        "vector", F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    taking = stored(taking, "vectors")
    width = taking.agg(F.max(F.size("vector"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = taking.select("*", nobody.alias("p_score"), nobody.alias("p_id"))
    blocks = stored(_pack(plain, width, positives), "vector-blocks")
    blocks = blocks.repartition(parts)
    anchors = taking.filter("is_anchor").coalesce(max(1, parts // 8))
    packed = stored(_pack(anchors.select("*", nobody.alias("p_score"), nobody.alias("p_id")), width, positives), "anchor-blocks")
    near = _ranked(_met(blocks, packed, width, _search_positives(width, positives)), ["anchor"], positives)
    # at most `positives` rows per anchor meet here
    found = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    chosen = anchors.join(found, anchors["uid"] == found["anchor"]).select("uid", "id", "label", "vector", F.col("p.score").alias("p_score"), F.col("p.id").alias("p_id"))
    packed = stored(_pack(chosen, width, positives), "positive-blocks")
    hits = _ranked(_met(blocks, packed, width, _search_negatives(width, negatives, low, high)), ["anchor", "place"], negatives)
    return hits.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: x.cast("double") * 256.0)
    # floor() of a double is a bigint, which large components exceed
    whole = F.transform("vector", lambda x: F.when(F.abs(x) < F.lit(EXACT), F.floor(x).cast("double")).otherwise(x))
    rows = table.select(F.col("vec_id").alias("id"), moved.alias("label"), scaled.alias("vector")).withColumn("vector", whole)
    return hard_negatives(rows, F.col("id") % 100 == 0)


SQL_TEXT = """WITH rows_ AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, r.id AS id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM rows_ a JOIN rows_ r ON a.id % 100 = 0 AND a.id <> r.id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id))::INTEGER AS rank,
  n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
SQL = {"op11_hard_negatives": SQL_TEXT}
