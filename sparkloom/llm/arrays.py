"""numpy helpers for Arrow batches: columns, sorted groups and union-find."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that what Python makes of one stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def utf8_rows(column: pa.Array) -> Iterator[bytes]:
    """Each string of ``column`` as UTF-8 bytes; null gives empty bytes."""
    for k in range(0, len(column), 256):
        for value in column.slice(k, 256).cast(pa.large_binary()):
            yield value.as_py() or b""


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Slices of batches sorted by ``keys`` (int64) that hold whole groups only, with the groups' offsets.

    The last group of a batch waits for the next batch, so a group is never cut. The caller bounds group sizes.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting:
            last = waiting[-1]
            here = [last.column(k)[last.num_rows - 1].as_py() for k in keys]
            same = np.ones(batch.num_rows, bool)
            for k, v in zip(keys, here):
                same &= batch.column(k).to_numpy() == v
            if same.all():
                waiting.append(batch)
                continue
        table = pa.Table.from_batches([*waiting, batch]).combine_chunks()
        starts = group_starts([table.column(k).to_numpy() for k in keys])
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut), np.append(starts[:-1], cut)
        waiting = table.slice(cut).combine_chunks().to_batches()
    if waiting:
        table = pa.Table.from_batches(waiting).combine_chunks()
        starts = group_starts([table.column(k).to_numpy() for k in keys])
        yield table, np.append(starts, table.num_rows)


def group_starts(keys: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i[x] and j[x] for each x; ``parent`` holds each element's root, always the smallest."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
