"""Groups of rows from sorted partitions, for joins that compare rows within a group.

``grouped`` deals rows to partitions by a key, sorts them there and hands
each task whole groups as numpy arrays, many small groups at a time. The
callers compare in blocks and return links that span what they found (never
all pairs), so a group costs memory in its rows only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from offerlab.llm.common import give_back


def grouped(df: DataFrame, key: str, run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, partitions: int) -> DataFrame:
    """``run`` gets tables of whole groups, sorted by ``key``."""
    at = df.columns.index(key)

    def groups(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at)
            end = keys[-1].as_py()
            if last is not None and end == last:  # one group fills the batch so far
                held.append(batch)
                continue
            start = int(np.searchsorted(keys.to_numpy(zero_copy_only=False), end))  # keys are sorted
            if held or start:
                yield from run(pa.Table.from_batches([*held, batch.slice(0, start)]))
            held, last = [batch.slice(start)], end
        if held:
            yield from run(pa.Table.from_batches(held))

    def task(batches):
        yield from groups(batches)
        give_back()

    return df.repartition(partitions, key).sortWithinPartitions(key).mapInArrow(task, schema)


def bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return starts, np.diff(np.r_[starts, len(keys)])


def small_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs i < j within groups; for groups of a bounded size."""
    left, right = [], []
    for n in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(n, 1)
        s = starts[sizes == n][:, None]
        left.append((s + i).ravel())
        right.append((s + j).ravel())
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def spanning_links(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that span the groups among n rows; ``near(i, rest)`` tells which of the rows ``rest`` link with row i.

    Rows found leave ``rest``, so dense groups cost their rows, not their pairs.
    """
    rest = np.arange(n)
    a, b = [], []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            hit = near(i, rest)
            found = rest[hit].tolist()
            a += [i] * len(found)
            b += found
            front += found
            rest = rest[~hit]
    return a, b
