"""Bounded tables worked through in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def in_one_task(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on all rows at once, of which the caller has checked that they are few; no rows
    give none."""

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if parts:
            yield work(pd.concat(parts, ignore_index=True))

    return rows.coalesce(1).mapInPandas(gather, schema)


def undirected_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least reachable number of every node 0..n-1 over undirected edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, label[a], low)
        np.minimum.at(fresh, label[b], low)
        while True:
            up = fresh[fresh]
            if (up == fresh).all():
                break
            fresh = up
        if (fresh == label).all():
            return label
        label = fresh


def strong_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Largest number of every node's strongly connected component over edges a -> b."""
    order = np.argsort(a, kind="stable")
    starts, heads = np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()
    index, low, on_stack = [-1] * n, [0] * n, [False] * n
    label, stack, clock = np.arange(n), [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        path = [(root, starts[root])]
        index[root] = low[root] = clock
        clock += 1
        stack.append(root)
        on_stack[root] = True
        while path:
            v, k = path.pop()
            if k < starts[v + 1]:
                path.append((v, k + 1))
                w = heads[k]
                if index[w] < 0:
                    index[w] = low[w] = clock
                    clock += 1
                    stack.append(w)
                    on_stack[w] = True
                    path.append((w, starts[w]))
                elif on_stack[w]:
                    low[v] = min(low[v], index[w])
                continue
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[v])
            if low[v] == index[v]:
                members = []
                while True:
                    w = stack.pop()
                    on_stack[w] = False
                    members.append(w)
                    if w == v:
                        break
                label[members] = max(members)
    return label
