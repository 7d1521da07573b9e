"""Pairs of a bucket met block against block inside tasks, so that no pair is ever a row.

A bucket of m documents is dealt by a hash into ceil(size / limit) slots; each pair of slots is one
unit, which a task reads as a run of consecutive rows. What two documents share is counted for a whole unit at
once, as a product of 0/1 matrices over the values that stand in two rows or more. Units of all
buckets are spread over all tasks, so a large bucket is the work of many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from benefactor.llm.hashing import mix

#: Cells of a matrix that is built at a time.
CELLS = 1 << 22


def slot_of(doc: np.ndarray, slots: np.ndarray | int) -> np.ndarray:
    """The slot of each document, by a hash of its number."""
    return (mix(doc.astype(np.uint64) + np.uint64(0x51ED)) % np.asarray(slots, np.uint64)).astype(np.int32)


def shared(values: list[np.ndarray], weights: list[np.ndarray] | None = None) -> np.ndarray:
    """How much each two of the sets have in common, as a square matrix: a count, or the sum of weights (of the value, equal in all)."""
    m = len(values)
    owner = np.repeat(np.arange(m), [len(v) for v in values])
    every = np.concatenate(values) if m else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    number = np.cumsum(new) - 1
    several = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
    owner, number = owner[several], number[several]
    weight = None if weights is None else np.concatenate(weights)[order][several].astype(np.float32)
    if len(number):  # columns are numbered anew, without those of a single row
        number = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]]))
    out = np.zeros((m, m))
    columns, step = int(number[-1]) + 1 if len(number) else 0, max(1, CELLS // max(1, m))
    for at in range(0, columns, step):
        a, b = np.searchsorted(number, (at, at + step))
        width = min(step, columns - at)
        dense = np.zeros((m, width), np.float32)
        dense[owner[a:b], number[a:b] - at] = 1
        if weight is None:
            out += dense @ dense.T  # exact: sums below 2**24
        else:
            by_column = np.zeros(width, np.float32)
            by_column[number[a:b] - at] = weight[a:b]
            out += dense @ (dense * by_column).T
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a graph given as a symmetric 0/1 matrix."""
    left = linked.any(axis=1)
    edges = []
    while left.any():
        front = np.array([int(left.argmax())])
        left[front] = False
        while len(front):
            reach = linked[front] & left
            found = np.flatnonzero(reach.any(axis=0))
            edges += zip(front[reach[:, found].argmax(axis=0)].tolist(), found.tolist(), strict=True)
            left[found] = False
            front = found
    return edges


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows with equal values in the first `keys` columns (sorted longs and ints), run by run, also across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield _joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield _joined(held)


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where the first column (sorted longs) changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held and held[-1].column(0)[0].as_py() != key[0]:
            yield _joined(held)
            held = []
        last = int(np.searchsorted(key, key[-1]))  # where the last run, which may go on, begins
        if last:
            yield _joined([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def longs(column: pa.Array) -> list[np.ndarray]:
    """Each row of a binary column as 64-bit numbers, without a copy."""
    return [np.frombuffer(v.as_buffer(), np.uint64) for v in column]
