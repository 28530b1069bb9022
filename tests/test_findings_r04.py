"""What the findings of the fourth round asked for."""

import random

import numpy as np
import pyarrow as pa
import pytest

from civiltext.operators import collisions, dedup, joins
from tests.test_dedup import keys_of, walk


def similar_texts(n=260, seed=5):
    """Ids in no order; texts that share many words or few, copies, texts without words and missing ones."""
    draw, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    bases = [draw.sample(words, 40) for _ in range(12)]
    ids = draw.sample(range(10_000), n)
    for i in range(n):
        text = list(draw.choice(bases))
        for _ in range(draw.choice([0, 1, 2, 4, 8, 16, 40])):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((ids[i], " ".join(text)))
    rows += [(20_000 + i, draw.choice(rows)[1]) for i in range(20)]
    return rows + [(30_000, ""), (30_001, " "), (30_002, None), (30_003, None)]


def swept(rows, signatures, threshold):
    """`(dropped, gap, sim, keeper, dropped_row)` of the plain walk."""
    kept, keeper = walk(keys_of(signatures, threshold))
    first = {}  # a copy's example is the next one of the first row, others have none
    for i in sorted(signatures):
        first.setdefault(tuple(signatures[i]), []).append(i)
    others = {j for own in first.values() for j in own[1:]}
    pairs = [(i, j) for j, i in keeper.items() if j not in others]
    pairs += [(own[0], own[1]) for own in first.values() if len(own) > 1 and own[0] in kept]
    found = []
    for i, j in pairs:
        sim = float(np.mean(np.array(signatures[i]) == np.array(signatures[j])))
        found.append((abs(sim - threshold), i, j, sim))
    gap, i, j, sim = min(found)
    return len(keeper), gap, sim, i, j


# rows of the prefix, rows at once, members compared in a task, memberships walked in a task
SIZES = [(1 << 14, 512, 500_000, 2_000_000), (60, 512, 500_000, 2_000_000), (1, 50, 300, 2_000_000), (40, 64, 2000, 200)]


@pytest.fixture(scope="module")
def similar(spark):
    rows = similar_texts()
    df = dedup.cut_lineage(spark.createDataFrame(rows, "row_id BIGINT, text STRING"))
    return rows, df, {r.row_id: r.signature for r in dedup.minhash_signature(df).collect()}


@pytest.mark.parametrize("prefix, at_once, met, walked", SIZES)
def test_f1_sweep_equals_the_walk_whatever_its_parts(spark, similar, monkeypatch, prefix, at_once, met, walked):
    rows, df, signatures = similar
    for name, n in (("PREFIX_ROWS", prefix), ("PREFIX_SHARE", 1), ("MET_AT_ONCE", met), ("WALKED_AT_ONCE", walked)):
        monkeypatch.setattr(dedup, name, n)
    monkeypatch.setattr(collisions, "ROWS_AT_ONCE", at_once)
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 30)
    thresholds = (0.4, 0.8) if walked < 1000 else (0.2, 0.25, 0.35, 0.4, 0.5, 0.65, 0.8, 0.95)
    for row in dedup.dedup_sweep(df, thresholds).collect():
        assert (row.dropped, row.gap, row.sim, row.keeper, row.dropped_row) == pytest.approx(swept(rows, signatures, row.threshold))
        assert row.remaining == len(rows) - row.dropped


def test_f1_tables_stored_do_not_grow_with_the_thresholds(spark, similar, monkeypatch):
    """A plan at a time took some twenty tables each, hundreds of jobs that outgrew the driver."""
    stored = []
    for module in (dedup, joins):
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=module.cut_lineage: stored.append(1) or cut(df))
    assert dedup.dedup_sweep(similar[1]).count() == len(dedup.SWEEP)
    assert len(stored) <= 12


@pytest.mark.parametrize("share", [1, 16])
def test_f1_repeated_and_missing_ids(spark, monkeypatch, share):
    monkeypatch.setattr(dedup, "PREFIX_SHARE", share)
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "x y z"), (None, "x y z"), (None, "k l m"), (4, None)]
    for row in dedup.dedup_sweep(spark.createDataFrame(rows, "row_id BIGINT, text STRING"), (0.5, 0.9)).collect():
        assert (row.dropped, row.remaining, row.keeper, row.dropped_row, row.sim) == (4, 3, 1, 2, 1.0)


def test_f1_no_texts(spark):
    for rows in ([], [(1, None)], [(1, "a b")]):
        row = dedup.dedup_sweep(spark.createDataFrame(rows, "row_id BIGINT, text STRING"), (0.5,)).first()
        assert tuple(row) == (0.5, 0, len(rows), None, None, None, None)


def test_f1_a_band_of_very_many_rows_meets_as_few():
    """Rows of a batch that share a band are known to; one of them meets those of other batches."""
    values = np.random.default_rng(1).integers(0, 1 << 31, (3000, 128)).astype(np.int32)
    values[:, :2] = 7  # one band of two rows in common
    prefix = collisions.Prefix(np.array([0]), np.random.default_rng(2).integers(0, 1 << 31, (1, 128)).astype(np.int32), np.array([collisions.NO_ROW]), [(28, 2)])
    batch = pa.RecordBatch.from_arrays([
        pa.array(np.arange(1, 3001)), collisions.binary(values, np.arange(3001) * 512), pa.nulls(3000, pa.int64()),
    ], ["row_id", "signature", "copy"])
    out = list(collisions.against_prefix(iter([batch]), prefix, [(0, 0.2)], 4))
    meeting = sum(len(m) // 24 for b in out for m, k in zip(b.column("members").to_pylist(), b.column("kind").to_pylist()) if k == collisions.MEET)
    slices = -(-3000 // collisions.ROWS_AT_ONCE)
    assert meeting == 3000 * 27 + slices  # the common band once for each
    found = pa.Table.from_batches(collisions.met(iter(out))).to_pylist()
    shared = [r["row_id"] for r in found if r["kind"] == collisions.KNOWN]
    assert set(shared) == set(range(1, 3001)) and len(shared) <= 3000 + slices
    assert [r["n"] for r in found if r["kind"] == collisions.DROPPED] == [0]
