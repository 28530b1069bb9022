"""Collisions of signatures as arrays, for all band plans at once.

A band is a pair of 64-bit hashes whose last 8 bits are the number of its plan. The rows of the smallest ids, the prefix,
are walked first, in one place. What they close is looked up in every batch of the other rows, which settles most rows of
the plans that drop most. The bands of the rows left meet by parts of their hashes, each part sorted in a task, and only
those of two rows or more go on. A band that several rows of a batch have is known to be shared: one row of the batch
stands for them, so a band of very many rows does not fill a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_AT_ONCE = 512  # of which a task holds the bands of all plans
KNOWN_AT_ONCE = 4096  # members in a row of those known to be shared
NO_ROW = np.iinfo(np.int64).max
PLAN_BITS = np.uint64(8)
PLAN_MASK = np.uint64(255)
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
MEMBER = np.dtype([("high", "<u8"), ("low", "<u8"), ("row_id", "<i8")])

MEET, KNOWN, EXAMPLE, DROPPED, COPY = range(5)  # kinds of rows
MEETING = "part int, kind int, plan int, row_id bigint, leader bigint, sim double, n bigint, members binary"
MET = "kind int, plan int, row_id bigint, leader bigint, sim double, n bigint, key binary"
PAIRS = "plan int, row_id bigint, leader bigint"


def binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary values between `edges`, byte positions in `data`."""
    buffers = [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, buffers)


def equally_long(values: pa.Array, kind: str) -> np.ndarray:
    """Binary values of one length as the rows of a table of numbers."""
    if not len(values):
        return np.zeros((0, 0), kind)
    edges = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[edges[0]:edges[-1]].view(kind).reshape(len(values), -1)


@F.arrow_udf(T.BinaryType())
def packed(signatures: pa.Array) -> pa.Array:
    """Signatures of 31-bit values as bytes, four for each."""
    values = signatures.flatten().to_numpy().astype("<i4")
    width = 4 * len(values) // max(1, len(signatures))
    return binary(values, np.arange(len(signatures) + 1) * width)


@F.arrow_udf(T.DoubleType())
def agreement(own: pa.Array, other: pa.Array) -> pa.Array:
    """Share of equal values of two packed signatures."""
    a, b = equally_long(own, "<i4"), equally_long(other, "<i4")
    return pa.array((a == b).sum(1) / max(1, a.shape[1]), pa.float64())


def band_hashes(values: np.ndarray, number: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row and band of plan `number` the two hashes of the band's values and number."""
    values = values[:, :bands * rows].astype(np.uint64)
    both = []
    for k, by in enumerate(MULTIPLIERS):
        hashes = np.empty((len(values), bands), np.uint64)
        hashes[:] = (np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(number << 32)) * MULTIPLIERS[1 - k]
        for i in range(rows):  # every step is one to one, whatever the value
            hashes ^= values[:, i::rows]
            hashes *= by
            hashes ^= hashes >> np.uint64(29)
        both.append(hashes)
    high, low = both
    return high, low & ~PLAN_MASK | np.uint64(number)


def hashed(values: np.ndarray, plans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """`band_hashes` of all plans side by side."""
    found = [band_hashes(values, k, *plan) for k, plan in enumerate(plans)]
    return tuple(np.concatenate(x, axis=1) for x in zip(*found))


def sorted_pairs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs together, and where in it a pair differs from the one before."""
    order = np.argsort(high, kind="stable")
    for again in (False, True):
        h, low_sorted = high[order], low[order]
        new_high, new_low = h[1:] != h[:-1], low_sorted[1:] != low_sorted[:-1]
        if again or not (new_low & ~new_high).any():
            break
        order = np.lexsort((low, high))
    return order, np.concatenate([np.ones(min(1, len(h)), bool), new_high | new_low])


def first_wins(high: np.ndarray, low: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The walk over rows in their order, row i having the bands from `edges[i]` to `edges[i + 1]`.

    Per row the position of the first kept row that it shares a band with, or -1 if it is kept.
    """
    order, new = sorted_pairs(high, low)
    codes = np.empty(len(order), np.int64)
    codes[order] = np.cumsum(new) - 1
    owner, leaders, codes, edges = [-1] * int(new.sum()), [], codes.tolist(), edges.tolist()
    for i, (start, end) in enumerate(zip(edges, edges[1:])):
        own = codes[start:end]
        hits = [o for c in own if (o := owner[c]) >= 0]
        leaders.append(min(hits) if hits else -1)
        if not hits:
            for c in own:
                owner[c] = i
    return np.array(leaders, np.int64)


def nearest(threshold: float, leaders: np.ndarray, row_ids: np.ndarray, sims: np.ndarray) -> tuple | None:
    """`(gap, leader, row_id, sim)` of the pair nearest to the threshold, of equals the one with the smallest ids."""
    real = leaders != row_ids
    if not real.any():
        return None
    leaders, row_ids, sims = leaders[real], row_ids[real], sims[real]
    gaps = np.abs(sims - threshold)
    least = gaps.min()
    return (float(least), *min(zip(*(x[gaps == least].tolist() for x in (leaders, row_ids, sims)))))


@dataclass
class Prefix:
    """The rows of the smallest ids, in the order of the walk, and what the walk of each plan makes of them."""

    row_ids: np.ndarray
    values: np.ndarray
    copies: np.ndarray  # the id of the next row with the same signature, or NO_ROW
    plans: list[tuple[int, int]]

    @cached_property
    def leaders(self) -> list[np.ndarray]:
        """Per plan and row the position of its leader, -1 if the row is kept."""
        found = []
        for k, plan in enumerate(self.plans):
            high, low = band_hashes(self.values, k, *plan)
            found.append(first_wins(high.ravel(), low.ravel(), np.arange(len(high) + 1) * plan[0]))
        return found

    @cached_property
    def first_copies(self) -> list[tuple | None]:
        """Per plan `(leader, row_id)` with the first kept row that has a copy."""
        found = []
        for leaders in self.leaders:
            own = np.flatnonzero((leaders < 0) & (self.copies != NO_ROW))
            found.append((int(self.row_ids[own[0]]), int(self.copies[own[0]])) if len(own) else None)
        return found

    @cached_property
    def closed(self) -> Closed:
        """Made once by each worker, and gone with the rows."""
        return Closed(self)

    def nearest(self, plan: int, threshold: float) -> tuple | None:
        own = np.flatnonzero(self.leaders[plan] >= 0)
        leaders = self.leaders[plan][own]
        parts = np.array_split(np.arange(len(own)), len(own) // ROWS_AT_ONCE + 1)
        sims = [(self.values[own[p]] == self.values[leaders[p]]).sum(1) / self.values.shape[1] for p in parts]
        return nearest(threshold, self.row_ids[leaders], self.row_ids[own], np.concatenate(sims))


class Closed:
    """The bands of the kept rows of a prefix, sorted, each with the position of its row."""

    def __init__(self, prefix: Prefix) -> None:
        parts = []
        for k, plan in enumerate(prefix.plans):
            kept = np.flatnonzero(prefix.leaders[k] < 0)
            high, low = band_hashes(prefix.values[kept], k, *plan)
            parts.append((high.ravel(), low.ravel(), np.repeat(kept.astype(np.int32), plan[0])))
        high, low, owner = (np.concatenate(x) for x in zip(*parts))
        del parts
        order, _ = sorted_pairs(high, low)
        self.high, self.low, self.owner = high[order], low[order], owner[order]
        # how far apart pairs of the same first hash can be
        edges = np.flatnonzero(np.concatenate([self.high[1:] != self.high[:-1], [True]]))
        self.longest = int(np.diff(edges, prepend=-1).max(initial=0))

    def owners(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The position of the row that closes each band, -1 if it is open; quick if `high` is sorted."""
        found = np.full(len(high), -1, np.int64)
        at = np.searchsorted(self.high, high)
        for step in range(self.longest):
            here = np.minimum(at + step, len(self.high) - 1)
            found = np.where((self.high[here] == high) & (self.low[here] == low), self.owner[here], found)
        return found


def _rows(schema: list[tuple[str, pa.DataType]], length: int, /, **columns: object) -> pa.RecordBatch:
    """A batch with the given columns, numbers standing for a whole column; the others are null."""
    def column(name: str, kind: pa.DataType) -> pa.Array:
        value = columns.get(name)
        if isinstance(value, pa.Array):
            return value
        return pa.nulls(length, kind) if value is None else pa.array(np.broadcast_to(value, length), kind)

    return pa.RecordBatch.from_arrays([column(*c) for c in schema], [name for name, _ in schema])


_NUMBERS = [("kind", pa.int32()), ("plan", pa.int32()), ("row_id", pa.int64()), ("leader", pa.int64()), ("sim", pa.float64()), ("n", pa.int64())]
_MEETING = [("part", pa.int32()), *_NUMBERS, ("members", pa.binary())]
_MET = [*_NUMBERS, ("key", pa.binary())]


def _members(high: np.ndarray, low: np.ndarray, row_ids: np.ndarray) -> np.ndarray:
    members = np.empty(len(high), MEMBER)
    members["high"], members["low"], members["row_id"] = high, low, row_ids
    return members


def against_prefix(batches: Iterator[pa.RecordBatch], prefix: Prefix, thresholds: list[tuple[int, float]], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of `MEETING` for rows `(row_id, signature, copy)` after the prefix.

    The bands of rows that no row of the prefix drops, those that are to meet by `part` and those known to be shared; per
    plan how many rows were dropped, and per threshold (its plan's number and itself) the pair nearest to it; and kept
    rows with a copy, for plans whose prefix has none.
    """
    closed, n_plans = prefix.closed, len(prefix.plans)
    plan_of = np.repeat(np.arange(n_plans), [bands for bands, _ in prefix.plans])
    without_copy = [k for k, found in enumerate(prefix.first_copies) if found is None]
    n_dropped, best = np.zeros(n_plans, np.int64), {}
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            rows = batch.slice(start, ROWS_AT_ONCE)
            row_ids, values = rows.column("row_id").to_numpy(), equally_long(rows.column("signature"), "<i4")
            high, low = (x.ravel() for x in hashed(values, prefix.plans))
            order = np.argsort(high)
            high, low = high[order], low[order]
            row, band = np.divmod(order, len(plan_of))
            cell, owner = row * n_plans + plan_of[band], closed.owners(high, low)
            leader = np.full(len(row_ids) * n_plans, NO_ROW)
            hit = owner >= 0
            np.minimum.at(leader, cell[hit], owner[hit])
            gone = leader != NO_ROW
            own, plan = np.divmod(np.flatnonzero(gone), n_plans)
            leader = leader[gone]
            n_dropped += np.bincount(plan, minlength=n_plans)
            sims = np.concatenate([(values[own[p]] == prefix.values[leader[p]]).sum(1) for p in np.array_split(np.arange(len(own)), n_plans)])
            for t, (k, threshold) in enumerate(thresholds):
                of = plan == k
                found = nearest(threshold, prefix.row_ids[leader[of]], row_ids[own[of]], sims[of] / values.shape[1])
                if found and found < best.get(t, (np.inf,)):
                    best[t] = found
            if without_copy:
                copies = rows.column("copy")
                for i in np.flatnonzero(copies.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    for k in without_copy:
                        if not gone[i * n_plans + k]:
                            yield _rows(_MEETING, 1, part=i % parts, kind=COPY, plan=k, leader=row_ids[i], row_id=copies[i].as_py(), sim=1.0)
            free = ~gone[cell]
            members = _members(high[free], low[free], row_ids[row[free]])
            if not len(members):
                continue
            again = np.concatenate([[False], members["high"][1:] == members["high"][:-1]])
            known = members[again | np.append(again[1:], False)]
            if len(known):
                edges = np.minimum(np.arange(-(-len(known) // KNOWN_AT_ONCE) + 1) * KNOWN_AT_ONCE, len(known))
                part = (int(row_ids[0]) + np.arange(len(edges) - 1)) % parts
                yield _rows(_MEETING, len(part), part=part, kind=KNOWN, members=binary(known, edges * MEMBER.itemsize))
            members = members[~again]
            part = (members["high"] >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)
            edges = np.concatenate([np.flatnonzero(np.diff(part, prepend=np.uint64(parts))), [len(part)]])
            yield _rows(_MEETING, len(edges) - 1, part=part[edges[:-1]], kind=MEET, members=binary(members, edges * MEMBER.itemsize))
    pa.default_memory_pool().release_unused()
    for k, n in enumerate(n_dropped.tolist()):
        yield _rows(_MEETING, 1, part=k % parts, kind=DROPPED, plan=k, n=n)
    for t, (_, leader, row_id, sim) in best.items():
        yield _rows(_MEETING, 1, part=t % parts, kind=EXAMPLE, plan=thresholds[t][0], n=t, leader=leader, row_id=row_id, sim=sim)


def _keyed(members: np.ndarray) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(members), 1 << 16):
        some = members[start:start + (1 << 16)]
        keys = np.stack([some["high"], some["low"]], axis=1)
        yield _rows(_MET, len(some), kind=KNOWN, plan=(some["low"] & PLAN_MASK).astype(np.int32), row_id=some["row_id"],
                    key=binary(keys, np.arange(len(some) + 1) * 16))


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `MET`: the members of shared bands, among the `MEETING` rows of some parts, and what came with them."""
    meeting = []
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for i in np.flatnonzero(kinds <= KNOWN).tolist():
            members = np.frombuffer(batch.column("members")[i].as_py(), MEMBER)
            if kinds[i] == MEET:
                meeting.append(members)
            else:
                yield from _keyed(members)
        others = batch.filter(pa.array(kinds > KNOWN))
        if others.num_rows:
            yield _rows(_MET, others.num_rows, **{name: others.column(name) for name, _ in _NUMBERS})
    if meeting:
        members = np.concatenate(meeting)
        meeting.clear()
        members = members[np.argsort(members["high"])]
        again = np.concatenate([[False], members["high"][1:] == members["high"][:-1]])
        yield from _keyed(members[again | np.append(again[1:], False)])


def walked_plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `PAIRS`, each dropped row with its leader, for rows `(plan, row_id, key)` in order; holds one plan at a time."""

    def walk(plan: int, held: list[tuple]) -> pa.RecordBatch:
        row_ids, keys = (np.concatenate(x) for x in zip(*held))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(row_ids)) + 1, [len(row_ids)]])
        leaders = first_wins(np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]), edges)
        row_ids, gone = row_ids[edges[:-1]], leaders >= 0
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(gone.sum(), plan), pa.int32()), pa.array(row_ids[gone]), pa.array(row_ids[leaders[gone]])], ["plan", "row_id", "leader"])

    now, held = None, []
    for batch in batches:
        plans, row_ids = batch.column("plan").to_numpy(), batch.column("row_id").to_numpy()
        keys = equally_long(batch.column("key"), "<u8")
        edges = np.concatenate([[0], np.flatnonzero(np.diff(plans)) + 1, [len(plans)]])
        for start, end in zip(edges[:-1], edges[1:]):
            if start == end:
                continue
            if held and plans[start] != now:
                yield walk(now, held)
                held = []
            now = int(plans[start])
            held.append((row_ids[start:end].copy(), keys[start:end].copy()))
    if held:
        yield walk(now, held)
