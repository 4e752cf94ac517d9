"""Exact attributions of a forest by path products shared along each tree.

A leaf's output is a product over the features on its path: 1 or 0 for "the row is inside the feature's interval",
or the cover share c where the feature is unknown. The Shapley value of factor f in such a product is

    (in_f - c_f) * integral over t in [0, 1] of the product over g != f of (c_g + (in_g - c_g) t),

a polynomial in t, so Gauss-Legendre nodes give it exactly. At one node all leaves below an edge share the product along
the path, and what an edge adds to its feature is linear in the sum of the leaf products below it. So products go down a
tree level by level, class-weighted sums come up again, and each edge is visited once for all rows of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 6_000_000  # numbers in the largest array of a batch


@dataclass
class TreeTable:
    """A tree as arrays, nodes level by level, the root first."""

    parent: np.ndarray
    last: np.ndarray  # nearest edge above on the same feature, 0 if there is none
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cover: np.ndarray  # share of the training rows that pass all splits on this feature down to here
    levels: list[slice]
    leaves: np.ndarray
    shares: np.ndarray  # class shares of the leaves
    depth: int  # most distinct features on a path


def tree_tables(nodes: pd.DataFrame) -> list[TreeTable]:
    """One table per tree from rows (tree, node, left, right, feature, cut, stats)."""
    return [_table(tree) for _, tree in nodes.groupby("tree")]


def _table(tree: pd.DataFrame) -> TreeTable:
    by_id = {r.node: r for r in tree.itertuples(index=False)}
    rows, levels, leaves, shares, deepest = [], [], [], [], 0
    # per node to visit: its id, row of its parent, and per feature on the path (row of the edge, low, high, cover)
    level = [(0, 0, -1, {})]
    while level:
        start, below = len(rows), []
        for node, parent, feature, path in level:
            r, here = by_id[node], len(rows)
            last, low, high, cover = path.get(feature, (0, -np.inf, np.inf, 1.0)) if feature >= 0 else (0, -np.inf, np.inf, 1.0)
            rows.append((parent, last, max(feature, 0), low, high, cover))
            if feature >= 0:
                path = {**path, feature: (here, low, high, cover)}
            total = float(np.sum(r.stats))
            if r.left < 0:
                leaves.append(here)
                shares.append(np.asarray(r.stats, dtype=float) / total)
                deepest = max(deepest, len(path))
                continue
            for child, left in ((r.left, True), (r.right, False)):
                at, low, high, cover = path.get(r.feature, (0, -np.inf, np.inf, 1.0))
                cover *= float(np.sum(by_id[child].stats)) / total
                edge = (at, low, min(high, r.cut), cover) if left else (at, max(low, r.cut), high, cover)
                below.append((child, here, r.feature, {**path, r.feature: edge}))
        levels.append(slice(start, len(rows)))
        level = below
    parent, last, feature, low, high, cover = (np.array(c) for c in zip(*rows, strict=True))
    return TreeTable(parent, last, feature, low, high, cover, levels, np.array(leaves), np.array(shares), deepest)


def base_of(trees: list[TreeTable]) -> np.ndarray:
    """Expected class shares over the training cover, mean over the trees."""
    total = 0.0
    for t in trees:
        reach = np.ones(len(t.parent))
        for level in t.levels[1:]:
            reach[level] = reach[t.parent[level]] * t.cover[level] / np.where(t.last[level] > 0, t.cover[t.last[level]], 1.0)
        total = total + reach[t.leaves] @ t.shares
    return total / len(trees)


def attribute(t: TreeTable, x: np.ndarray, d: int) -> np.ndarray:
    """Attributions (feature, class, row) of one tree for rows `x` (row, feature)."""
    k, n = t.shares.shape[1], len(x)
    phi = np.zeros((d, k, n))
    if len(t.parent) == 1:
        return phi
    nodes, weights = np.polynomial.legendre.leggauss(t.depth // 2 + 1)
    nodes, weights = (nodes + 1) / 2, weights / 2
    values = x.T[t.feature]
    inside = (values > t.low[:, None]) & (values <= t.high[:, None])  # (edge, row); all true at the root
    factor = t.cover[:, None, None] * (1 - nodes)[:, None] + nodes[:, None] * inside[:, None, :]  # (edge, node, row)
    gain = (inside - t.cover[:, None])[:, None, :] / factor * weights[:, None]
    factor[0], gain[0] = 1.0, 0.0
    product = factor / factor[t.last]
    for level in t.levels[1:]:
        product[level] *= product[t.parent[level]]
    gain = gain - gain[t.last]
    below = np.zeros((len(t.parent), k, len(nodes), n))
    below[t.leaves] = t.shares[:, :, None, None] * product[t.leaves][:, None]
    for level in reversed(t.levels[1:]):
        parents = t.parent[level]  # children stand in pairs
        below[parents[::2]] = below[level][::2] + below[level][1::2]
    edge = np.einsum("ekqn,eqn->ekn", below, gain, optimize=False)
    order = np.argsort(t.feature[1:], kind="stable") + 1
    first = np.flatnonzero(np.diff(t.feature[order], prepend=-1))
    phi[t.feature[order][first]] = np.add.reduceat(edge[order], first, axis=0)
    return phi


def forest_attributions(trees: list[TreeTable], x: np.ndarray) -> np.ndarray:
    """Attributions (row, class, feature) of the forest's class shares, rows in batches of bounded memory."""
    k, d = trees[0].shares.shape[1], x.shape[1]
    widest = max(len(t.parent) * k * (t.depth // 2 + 1) for t in trees)
    step = max(1, CELLS // widest)
    out = np.empty((len(x), k, d))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        total = np.zeros((d, k, len(part)))
        for t in trees:
            total += attribute(t, part, d)
        out[i : i + step] = total.transpose(2, 1, 0) / len(trees)
    return out


def attributions(df: DataFrame, trees: list[TreeTable], features: list[str], id_col: str, keep: list[str]) -> DataFrame:
    """(id, keep.., cluster, phi): one row per row and class, phi an array over the features."""
    shared = df.sparkSession.sparkContext.broadcast(trees)
    heads = [id_col, *keep]
    kinds = dict(df.dtypes)
    d, k = len(features), trees[0].shares.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = np.asarray(part.column("_x").flatten(), dtype=float).reshape(-1, d)
                phi = forest_attributions(shared.value, x).reshape(-1, d)
                index = pa.array(np.repeat(np.arange(len(x)), k))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(phi) + 1) * d, pa.int32()), pa.array(phi.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(index) for c in heads], pa.array(np.tile(np.arange(k), len(x)), pa.int64()), lists], [*heads, "cluster", "phi"])

    rows = df.select(*heads, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in heads], "cluster bigint", "phi array<double>"]))
