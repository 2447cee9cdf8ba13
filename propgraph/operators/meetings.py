"""Pairs of numbers that lists have in common, noted once per task however many lists hold them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pairs that are made at a time, and distinct pairs that a task holds before it gives away those of numbers that are past.
AT_ONCE, HELD = 2 << 20, 4 << 20


def _once(codes: np.ndarray, kind: str | None = None) -> np.ndarray:
    """The distinct codes in order; codes is sorted in place."""
    codes.sort(kind=kind)
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes


def _grouped(codes: np.ndarray) -> pa.RecordBatch:
    """(x, ys): a row per first number of the codes, which are in order."""
    x, y = (codes >> 32).astype("i4"), (codes & 0xFFFFFFFF).astype("i4")
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    ys = pa.ListArray.from_arrays(pa.array(np.append(first, len(x)).astype("i4")), pa.array(y))
    return pa.RecordBatch.from_arrays([pa.array(x[first]), ys], names=["x", "ys"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few numbers in all, as lists may be long."""
    for batch in batches:
        offsets, at = batch.column(0).offsets.to_numpy(), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE // 4, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ids, cut) in order of their first id to (x, ys), x < y.

    cut = 0: each of ids meets those after it; else each before the place cut meets each from there on.
    ids grow up to the cut, and those after it are greater.  So pairs whose x is below a row's first id do
    not come again: when too many are held they are given away, and all are if those are few, so that a pair may come twice.
    """
    held = np.empty(0, "i8")
    for batch in _parts(batches):
        lists, cut = batch.column(0), batch.column(1).to_numpy()
        ids = lists.flatten().to_numpy().astype("i8")
        sizes = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(sizes)
        starts = ends - sizes
        place = np.arange(len(ids))
        other, apart = np.repeat(starts + cut, sizes), np.repeat(cut > 0, sizes)
        begin = np.maximum(place + 1, other)
        count = np.where(apart & (place >= other), 0, np.repeat(ends, sizes) - begin)
        least = np.repeat(ids[starts], sizes)
        total = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(total, total[at] + AT_ONCE, "right")) - 1)
            n, before = count[at:to], total[at:to] - total[at]
            right = np.arange(total[to] - total[at]) + np.repeat(begin[at:to] - before, n)
            found = _once(np.repeat(ids[at:to] << 32, n) | ids[right])
            held = _once(np.concatenate([held, found]), "stable")
            if len(held) > HELD:
                past = int(np.searchsorted(held, least[to - 1] << 32))
                past = past if past > HELD // 2 else len(held)
                yield _grouped(held[:past])
                held = held[past:].copy()
            at = to
    if len(held):
        yield _grouped(held)
