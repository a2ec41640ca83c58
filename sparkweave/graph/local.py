"""Graph loops in numpy for graphs that fit in one process; the results equal those of the distributed loops.

Iteration in Spark costs a job a round. Below :data:`MOST_EDGES` edges, a size that is counted
first, the edges are fetched as Arrow and worked on here instead.
"""

from __future__ import annotations

import contextlib
import contextvars

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Edges (two longs each) that are fetched at most.
MOST_EDGES = 1_000_000
_MOST: contextvars.ContextVar[int] = contextvars.ContextVar("most_edges", default=MOST_EDGES)


@contextlib.contextmanager
def distributed():
    """While inside, every loop is a distributed one, however small the graph."""
    token = _MOST.set(0)
    try:
        yield
    finally:
        _MOST.reset(token)


def bounded(most: int) -> int:
    return min(most, _MOST.get())


def arrays(df: DataFrame) -> list[np.ndarray]:
    """The columns of a small table of longs."""
    table = df.toArrow()
    return [table.column(k).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for k in range(table.num_columns)]


def frame(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()}))


class Csr:
    """Out-neighbours of each vertex."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray) -> None:
        order = np.argsort(u, kind="stable")
        self.to = v[order]
        self.start = np.searchsorted(u[order], np.arange(n + 1))

    def neighbours(self, of: np.ndarray) -> np.ndarray:
        size = self.start[of + 1] - self.start[of]
        at = np.repeat(self.start[of] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.to[at]


def reach(seeds: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Vertices that the seeds reach, with the seeds."""
    ids = np.unique(np.concatenate([seeds, u, v]))
    a, b, now = (np.searchsorted(ids, x) for x in (u, v, np.unique(seeds)))
    graph, seen = Csr(len(ids), a, b), np.zeros(len(ids), bool)
    seen[now] = True
    while len(now):
        nxt = np.unique(graph.neighbours(now))
        now = nxt[~seen[nxt]]
        seen[now] = True
    return ids[seen]


def components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges and the least vertex of their component."""
    ids = np.unique(np.concatenate([u, v]))
    a, b = np.searchsorted(ids, u), np.searchsorted(ids, v)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            return ids, ids[label]
        label = new


def strong(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices on a cycle and the least vertex of their strongly connected component (Tarjan's algorithm without recursion)."""
    ids = np.unique(np.concatenate([u, v]))
    n = len(ids)
    graph = Csr(n, np.searchsorted(ids, u), np.searchsorted(ids, v))
    to, start = graph.to.tolist(), graph.start.tolist()
    order, low, on = [-1] * n, [0] * n, [False] * n
    stack: list[int] = []
    out_v, out_c, clock = [], [], 0
    for root in range(n):
        if order[root] >= 0:
            continue
        path = [(root, start[root])]
        order[root] = low[root] = clock
        clock += 1
        stack.append(root)
        on[root] = True
        while path:
            x, k = path[-1]
            if k < start[x + 1]:
                path[-1] = (x, k + 1)
                y = to[k]
                if order[y] < 0:
                    order[y] = low[y] = clock
                    clock += 1
                    stack.append(y)
                    on[y] = True
                    path.append((y, start[y]))
                elif on[y]:
                    low[x] = min(low[x], order[y])
                continue
            path.pop()
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[x])
            if low[x] == order[x]:
                part = []
                while True:
                    y = stack.pop()
                    on[y] = False
                    part.append(y)
                    if y == x:
                        break
                if len(part) > 1:
                    least = min(part)
                    out_v += part
                    out_c += [least] * len(part)
    return ids[np.array(out_v, int)], ids[np.array(out_c, int)]
