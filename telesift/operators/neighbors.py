"""Exact k-nearest-neighbour join without a cross join.

A tree of median cuts, grown from a bounded sample in a projected space, gives cells of bounded size. Every query row
is joined with its own cell first; its k-th distance there bounds how far its neighbours can lie, and only the cells
whose box lies within that distance are joined in a second pass. What is broadcast is the tree and the boxes, at most
MOST_CELLS of them; beyond that cells grow and are cut into blocks by row hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telesift.functions.linalg import dense, gram, stack
from telesift.operators.sampling import sample_n
from telesift.session import stage

MOST_CELLS, SAMPLE_PER_CELL, MOST_AXES = 4096, 16, 16
SLACK = 1e-9  # relative widening of the bounds against rounding


def distances(a: np.ndarray, b: np.ndarray, cells: int = 4_000_000) -> np.ndarray:
    """Euclidean distances by direct differences (exact zeros and ties), in bounded chunks."""
    out = np.empty((len(a), len(b)))
    step = max(1, cells // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def nearest_pairs(a: np.ndarray, b: np.ndarray, k: int, reach: np.ndarray, own: np.ndarray, cells: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest rows of b within the reach of each row of a, the first ones of equals.

    Squared distances by a matrix product name the rows that may be among them, all within its rounding error of the
    k-th; direct differences decide. `own` is the row of b that is left out, -1 for none. Values that the product cannot
    hold are compared directly.
    """
    centre = b.mean(axis=0)
    u, v = a - centre, b - centre
    with np.errstate(over="ignore", invalid="ignore"):
        uu, vv = np.einsum("ij,ij->i", u, u), np.einsum("ij,ij->i", v, v)
        # the product, the lengths and the shift each round by some units of the lengths and of the coordinates
        error = 8 * (b.shape[1] + 8) * np.finfo(float).eps * (uu + vv.max() + (np.abs(a).max(axis=1) + np.abs(b).max() + np.abs(centre).max()) ** 2)
    fast = bool(np.isfinite(error).all())
    found: list[tuple] = []
    step = max(1, cells // len(b))
    for i in range(0, len(a), step):
        rows = slice(i, i + step)
        left = np.flatnonzero(own[rows] >= 0)
        if fast:
            near = u[rows] @ (-2.0 * v.T)
            near += vv
            near[left, own[rows][left]] = np.inf
            kth = np.partition(near, k - 1, axis=1)[:, k - 1] if k < len(b) else np.full(len(near), np.inf)
            # |a|^2 is left out on both sides
            most = np.minimum(kth, reach[rows] ** 2 * (1 + 1e-12) - uu[rows]) + 2 * error[rows]
            at, of = np.nonzero((near <= most[:, None]) & (near < np.inf))
            dist = np.empty(len(at))
            some = max(1, cells // b.shape[1])
            for j in range(0, len(at), some):
                d = a[i + at[j : j + some]] - b[of[j : j + some]]
                dist[j : j + some] = np.sqrt(np.einsum("ij,ij->i", d, d))
        else:
            full = distances(a[rows], b)
            full[left, own[rows][left]] = np.inf
            at, of = np.nonzero(np.isfinite(full))
            dist = full[at, of]
        inside = dist <= reach[i + at]
        found.append((i + at[inside], of[inside], dist[inside]))
    at, of, dist = (np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    order = np.lexsort((of, dist, at))
    at, of, dist = at[order], of[order], dist[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], of[keep], dist[keep]


@dataclass
class CellTree:
    """Cuts of a projected space into cells, and the box of the reference rows of each cell.

    The projection (leading principal axes, then the length of what they leave) never lengthens a distance, so the
    distance of a projected row to a box is a lower bound for the distance to every row of the cell. A row far away
    from all others widens one box only.
    """

    centre: np.ndarray
    axes: np.ndarray  # d x m
    axis: np.ndarray  # of a node, -1 for a leaf
    cut: np.ndarray
    child: np.ndarray  # left child (the right one follows); of a leaf its cell
    low: np.ndarray | None = None  # cells x (m + 1)
    high: np.ndarray | None = None

    @property
    def scale(self) -> float:
        """Length of the farthest box corner."""
        corners = np.concatenate([self.low, self.high])
        return float(np.abs(corners[np.isfinite(corners)]).max(initial=0.0))

    def project(self, x: np.ndarray) -> np.ndarray:
        x = x - self.centre
        z = x @ self.axes
        rest = np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x) - np.einsum("ij,ij->i", z, z), 0.0))
        return np.column_stack([z, rest])

    def cell(self, z: np.ndarray) -> np.ndarray:
        node = np.zeros(len(z), int)
        while (open_ := self.axis[node] >= 0).any():
            at = node[open_]
            node[open_] = self.child[at] + (z[open_, self.axis[at]] > self.cut[at])
        return self.child[node]

    def within(self, z: np.ndarray, reach: np.ndarray, slack: np.ndarray) -> list[np.ndarray]:
        """Per row the cells whose box lies within its reach."""
        out = []
        step = max(1, 4_000_000 // self.low.size)
        for i in range(0, len(z), step):
            part = z[i : i + step, None, :]
            gap = np.maximum(np.maximum(self.low - part, part - self.high), 0.0)
            near = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap)) <= (reach[i : i + step] + slack[i : i + step])[:, None]
            out += [np.flatnonzero(row) for row in near]
        return out


def grow_cells(z: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (axis, cut, child) of a tree with about `cells` leaves: the fullest one is cut at the median of its widest axis."""
    axis, cut, child = [-1], [0.0], [0]
    heap, leaves = [(-len(z), 0, np.arange(len(z)))], 1
    while heap and leaves < cells:
        _, node, rows = heappop(heap)
        part = z[rows]
        a = int(np.argmax(np.percentile(part, 90, axis=0) - np.percentile(part, 10, axis=0)))
        if part[:, a].min() == part[:, a].max():
            a = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        at = np.median(part[:, a])
        at = at if at < part[:, a].max() else part[part[:, a] < at, a].max(initial=part[:, a].min())
        left = part[:, a] <= at
        if left.all():
            continue  # all rows of the sample are equal here
        axis[node], cut[node], child[node] = a, float(at), len(axis)
        for side in (left, ~left):
            heappush(heap, (-int(side.sum()), len(axis), rows[side]))
            axis.append(-1), cut.append(0.0), child.append(0)
        leaves += 1
    axis, child = np.array(axis), np.array(child)
    child[axis < 0] = np.arange((axis < 0).sum())
    return axis, np.array(cut), child


def _tree(refs: DataFrame, dim: int, n: int, cell: int, seed) -> CellTree:
    """Cells of about `cell` reference rows, at most MOST_CELLS of them, with their boxes."""
    cells = min(MOST_CELLS, -(-n // cell))
    drawn = np.array([r[0] for r in sample_n(refs, n=min(n, SAMPLE_PER_CELL * cells), seed=seed, id_col="r_id").select("r_v").collect()], dtype=float)
    centre = drawn.mean(axis=0)
    _, _, moments = gram(refs, "r_v", dim, centre)
    axes = np.linalg.eigh(moments)[1][:, ::-1][:, : min(dim, MOST_AXES)]
    tree = CellTree(centre, axes, *grow_cells(CellTree(centre, axes, *[np.zeros(0)] * 3).project(drawn), cells))
    m = axes.shape[1] + 1

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = {}, {}
        for batch in batches:
            z = tree.project(dense(batch.column("r_v")))
            of = tree.cell(z)
            for c in np.unique(of):
                part = z[of == c]
                low[c] = np.minimum(low.get(c, np.inf), part.min(axis=0))
                high[c] = np.maximum(high.get(c, -np.inf), part.max(axis=0))
        if low:
            yield pa.RecordBatch.from_pydict({"cell": pa.array(list(low), pa.int32()), "low": pa.array([v.tolist() for v in low.values()]), "high": pa.array([v.tolist() for v in high.values()])})

    sides = refs.select("r_v").mapInArrow(boxes, "cell int, low array<double>, high array<double>")
    found = sides.groupBy("cell").agg(*[F.min(F.col("low")[i]).alias(f"l{i}") for i in range(m)], *[F.max(F.col("high")[i]).alias(f"h{i}") for i in range(m)]).collect()
    tree.low, tree.high = np.full((int(tree.child[tree.axis < 0].max()) + 1, m), np.inf), np.full((int(tree.child[tree.axis < 0].max()) + 1, m), np.inf)
    for row in found:
        tree.low[row["cell"]], tree.high[row["cell"]] = row[1 : m + 1], row[m + 1 :]
    return tree


def _celled(df: DataFrame, vec: str, tree: CellTree) -> DataFrame:
    """The rows with the cell they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = tree.cell(tree.project(dense(batch.column(vec)))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype("int32"))], [*batch.schema.names, "cell"])

    return df.mapInArrow(run, df.withColumn("cell", F.lit(0)).schema)


def _reached(df: DataFrame, tree: CellTree, drawn: np.ndarray, need: int) -> DataFrame:
    """(q_id, q_v, cell, reach, cells): cells other than the home cell that may hold a neighbour of the row.

    A row whose home cell holds too few reference rows takes its reach from a few drawn ones, which are reference rows
    too, so the k-th of them is never nearer than the k-th of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, home = dense(batch.column("q_v")), batch.column("cell").to_numpy()
            reach = batch.column("reach").to_numpy(zero_copy_only=False).astype(float)
            open_ = np.flatnonzero(np.isnan(reach))
            if len(open_):
                reach[open_] = np.sort(distances(x[open_], drawn), axis=1)[:, need - 1] if len(drawn) >= need else np.inf
            z = tree.project(x) if len(x) else np.zeros((0, tree.axes.shape[1] + 1))
            # rounding of the projection is relative to the lengths of the rows and of the box corners
            slack = SLACK * (reach + np.abs(z).sum(axis=1) + tree.scale)
            cells = [c[c != h].astype("int32") for c, h in zip(tree.within(z, reach, np.where(np.isfinite(slack), slack, 0.0)), home, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(reach), pa.array(cells, pa.list_(pa.int32()))], ["q_id", "q_v", "cell", "reach", "cells"])

    kind = dict(df.dtypes)["q_id"]
    return df.select("q_id", "q_v", "cell", "reach").mapInArrow(run, f"q_id {kind}, q_v array<double>, cell int, reach double, cells array<int>")


def _block_join(queries: DataFrame, refs: DataFrame, k: int, exclude_self: bool, block: int) -> DataFrame:
    """(q_id, r_id, dist): for every query row (q_id, q_v, cell, reach) the k nearest rows of its cell within its reach.

    Cells are cut into blocks by row hash on both sides, so a cell with a third of all rows is many equal tasks; each
    pair of blocks yields at most k rows per query.
    """
    n_q = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_r = {r["cell"]: r["n"] for r in refs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = queries.sparkSession.createDataFrame([(c, -(-n_q[c] // block), -(-n_r[c] // block)) for c in n_q if c in n_r], "cell int, nq int, nr int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    at_most = F.broadcast(sizes)  # a row per cell
    q = queries.join(at_most, "cell").withColumn("qb", part("q_id", "nq")).withColumn("rb", span("nr"))
    s = refs.join(at_most, "cell").withColumn("rb", part("r_id", "nr")).withColumn("qb", span("nq"))

    def best_of_block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q_id": a["q_id"][:0], "r_id": b["r_id"][:0], "dist": pd.Series([], dtype=float)})
        b = b.sort_values("r_id", kind="stable")
        ids, refs_ = a["q_id"].to_numpy(), b["r_id"].to_numpy()
        x, y, reach, own = stack(a["q_v"]), stack(b["r_v"]), a["reach"].to_numpy(), np.full(len(a), -1)
        if exclude_self and b["r_id"].is_unique:
            own = pd.Index(b["r_id"]).get_indexer(a["q_id"])
            own[ids != refs_[own]] = -1  # a missing number equals none
        if exclude_self and not b["r_id"].is_unique:  # a row may be left out of several places
            at, of, dist = nearest_pairs(x, y, k + int(b["r_id"].value_counts(dropna=False).max()), reach, own)
            other = ids[at] != refs_[of]
            at, of, dist = at[other], of[other], dist[other]
            first = np.arange(len(at)) - np.searchsorted(at, at) < k
            at, of, dist = at[first], of[first], dist[first]
        else:
            at, of, dist = nearest_pairs(x, y, k, reach, own)
        return pd.DataFrame({"q_id": ids[at], "r_id": refs_[of], "dist": dist})

    keys = ["cell", "qb", "rb"]
    kind = dict(queries.dtypes)["q_id"]
    return q.select(*keys, "q_id", "q_v", "reach").groupBy(*keys).cogroup(s.select(*keys, "r_id", "r_v").groupBy(*keys)).applyInPandas(
        best_of_block, f"q_id {kind}, r_id {kind}, dist double"
    )


def knn_join(
    queries: DataFrame, refs: DataFrame, k: int, id_col: str = "row_id", vec: str = "v", exclude_self: bool = False,
    cell: int = 4096, block: int = 8192, seed=7, watch: dict | None = None,
) -> DataFrame:
    """(id, ref_id, dist, rank): the k nearest reference rows of each query; ties by reference id.

    A first pass finds the k nearest of the row's own cell, a second one looks into the cells that the k-th distance
    reaches. `watch` receives the numbers of cells and of (query, cell) pairs.
    """
    need = k + 1 if exclude_self else k
    queries = queries.select(F.col(id_col).alias("q_id"), F.col(vec).cast("array<double>").alias("q_v"))
    refs = refs.select(F.col(id_col).alias("r_id"), F.col(vec).cast("array<double>").alias("r_v"))
    # of rows with equal vectors only the first `need` can be among anyone's neighbours
    copies = Window.partitionBy("r_v").orderBy("r_id")
    refs = stage(refs.withColumn("_c", F.row_number().over(copies)).filter(F.col("_c") <= need).drop("_c"), "knn-refs")
    n, dim = refs.agg(F.count(F.lit(1)), F.max(F.size("r_v"))).first()
    order = Window.partitionBy("q_id").orderBy("dist", "r_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = [F.col("q_id").alias(id_col), F.col("r_id").alias("ref_id"), F.col("dist"), F.col("rank")]
    if n <= cell:
        one = lambda df: df.withColumn("cell", F.lit(0))
        return ranked(_block_join(one(queries).withColumn("reach", F.lit(float("inf"))), one(refs), k, exclude_self, block)).select(*named)

    tree = _tree(refs, dim, n, cell, seed)
    refs = stage(_celled(refs, "r_v", tree), "knn-cells")
    homes = stage(_celled(queries, "q_v", tree), "knn-queries")
    first = stage(ranked(_block_join(homes.withColumn("reach", F.lit(float("inf"))), refs, k, exclude_self, block)), "knn-home")
    kth = first.filter(F.col("rank") == k).select(F.col("q_id").alias("_id"), F.col("dist").alias("reach"))
    drawn = np.array([r[0] for r in sample_n(refs, n=min(n, max(need, 256)), seed=seed, id_col="r_id").select("r_v").collect()], dtype=float)
    sent = stage(_reached(homes.join(kth, F.col("q_id") == F.col("_id"), "left"), tree, drawn, need), "knn-reached")
    there = sent.select("q_id", "q_v", "reach", F.explode("cells").alias("cell"))
    if watch is not None:
        watch |= {"rows": n, "cells": len(tree.low), "pairs": sent.agg(F.sum(F.size("cells"))).first()[0]}
    found = _block_join(there, refs, k, exclude_self, block)
    return ranked(first.drop("rank").unionByName(found)).select(*named)


def knn_votes(neighbors: DataFrame, labels: DataFrame, id_col: str = "row_id", label: str = "label") -> DataFrame:
    """Majority class among the neighbours; the lowest class wins a tie. Any number of label
    columns can be voted on from the same neighbour table."""
    votes = neighbors.join(labels.select(F.col(id_col).alias("ref_id"), label), "ref_id").groupBy(id_col, label).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return votes.groupBy(id_col).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("p"))
