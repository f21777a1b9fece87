"""M-06: global SHAP ranking of a random forest (exact path-dependent TreeSHAP).

Layout on Spark: the forest's node table (read back from the saved model) is
turned into leaf boxes and broadcast, as Spark ML broadcasts the model itself
to predict; every task explains its own rows with all trees and hands on one
partial sum per feature, so any number of rows is one pass without a shuffle of
rows.

A leaf's attributions depend on a row only through which features lie inside
the leaf's box, so they are tabulated per leaf and pattern of features, and a
row is one lookup per leaf.  With more than ``TABLE_FEATURES`` features the
tables would be too wide; then the trees are walked as in Algorithm 2 of
Lundberg, Erion & Lee (2018), "Consistent individualized feature attribution
for tree ensembles", vectorised over the rows.

The importance over a whole table explains every distinct cell once and counts
its rows: all rows between the same cuts of the forest's features have the same
attributions, and a forest has at most ``maxBins - 1`` cuts per feature.  Over a
large table the cells are not explained tree by tree: what the forest expects
of a cell when only some features are known depends on these alone, so one
table per set of features, filled with all leaves' boxes, answers for all cells.

Importance per feature = mean |SHAP| over rows and classes; a forest predicts
the mean of its trees' class distributions, and so attributes.
"""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial, prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import columns as cf
from tabulon.functions.cells import with_cell
from tabulon.functions.columns import col
from tabulon.operators.sample import capped_sample
from tabulon.session import checkpoint_dir

TABLE_FEATURES = 8       # 2^8 patterns per leaf
ROWS = 1 << 16           # rows explained together, a few numbers each
LOOKUP_ROWS = 1024       # rows looked up at a time
WALK_ROWS = 4096         # rows walked together when there are more features
MAX_EXPECTED = 8_000_000   # numbers in the table of all features: the forest's cells times classes


def forest_nodes(model: PipelineModel) -> DataFrame:
    """(treeID, id, left, right, feature, threshold, stats) of every node."""
    spark = SparkSession.getActiveSession()
    path = os.path.join(checkpoint_dir(spark), f"forest-{uuid.uuid4().hex}")
    model.stages[-1].write().overwrite().save(path)
    d = spark.read.parquet(os.path.join(path, "data"))
    return d.select("treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.leftChild").alias("left"),
                    F.col("nodeData.rightChild").alias("right"), F.col("nodeData.split.featureIndex").alias("feature"),
                    F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), 0).alias("threshold"),
                    F.col("nodeData.impurityStats").alias("stats"))


# --- TreeSHAP over a batch of rows ---------------------------------------------------
# A path element is (feature, zero_fraction, one_fraction[rows], weight[rows]).

def _extend(path, z, o, d):
    n = len(path)
    out = [[p[0], p[1], p[2], p[3].copy()] for p in path]
    out.append([d, z, o, np.ones_like(o) if n == 0 else np.zeros_like(o)])
    for i in range(n - 1, -1, -1):
        out[i + 1][3] = out[i + 1][3] + o * out[i][3] * (i + 1) / (n + 1)
        out[i][3] = z * out[i][3] * (n - i) / (n + 1)
    return out


def _unwind(path, i):
    last = len(path) - 1
    z, o = path[i][1], path[i][2]
    hot = o != 0
    safe_o = np.where(hot, o, 1.0)
    w = [p[3].copy() for p in path]
    nxt = w[last].copy()
    for j in range(last - 1, -1, -1):
        wa = nxt * (last + 1) / ((j + 1) * safe_o)
        na = w[j] - wa * z * (last - j) / (last + 1)
        wb = w[j] * (last + 1) / (z * (last - j))
        w[j] = np.where(hot, wa, wb)
        nxt = np.where(hot, na, nxt)
    keep = [(p[0], p[1], p[2]) for k, p in enumerate(path) if k != i]
    return [[keep[j][0], keep[j][1], keep[j][2], w[j]] for j in range(last)]


def _unwound_sum(path, i):
    last = len(path) - 1
    z, o = path[i][1], path[i][2]
    hot = o != 0
    safe_o = np.where(hot, o, 1.0)
    nxt = path[last][3]
    tot_a = np.zeros_like(o)
    tot_b = np.zeros_like(o)
    for j in range(last - 1, -1, -1):
        tmp = nxt / ((j + 1) * safe_o)
        tot_a = tot_a + tmp
        nxt = path[j][3] - tmp * z * (last - j)
        tot_b = tot_b + path[j][3] / (z * (last - j))
    return np.where(hot, tot_a, tot_b) * (last + 1)


def tree_shap(x: np.ndarray, left, right, feature, threshold, value, cover, n_features: int) -> np.ndarray:
    """SHAP values (rows, features, outputs) of one tree for the rows ``x``."""
    rows = x.shape[0]
    phi = np.zeros((rows, n_features, value.shape[1]))

    def rec(node, path, pz, po, pi):
        path = _extend(path, pz, po, pi)
        if left[node] < 0:
            for i in range(1, len(path)):
                w = _unwound_sum(path, i)
                d, z, o = path[i][0], path[i][1], path[i][2]
                phi[:, d, :] += ((o - z) * w)[:, None] * value[node][None, :]
            return
        f = feature[node]
        goes_left = (x[:, f] <= threshold[node]).astype(float)
        iz, io = 1.0, np.ones(rows)
        k = next((k for k in range(1, len(path)) if path[k][0] == f), None)
        if k is not None:
            iz, io = path[k][1], path[k][2]
            path = _unwind(path, k)
        rec(left[node], path, cover[left[node]] / cover[node] * iz, io * goes_left, f)
        rec(right[node], path, cover[right[node]] / cover[node] * iz, io * (1.0 - goes_left), f)

    rec(0, [], 1.0, np.ones(rows), -1)
    return phi


def expected_value(left, value, cover) -> np.ndarray:
    leaves = left < 0
    return (cover[leaves][:, None] * value[leaves]).sum(axis=0) / cover[0]


def _tree_arrays(nodes: pd.DataFrame):
    nodes = nodes.sort_values("id")
    stats = np.stack(nodes["stats"].to_numpy())
    cover = stats.sum(axis=1)
    value = stats / np.where(cover[:, None] > 0, cover[:, None], 1.0)
    return (nodes["left"].to_numpy(), nodes["right"].to_numpy(), nodes["feature"].to_numpy(),
            nodes["threshold"].fillna(0.0).to_numpy(), value, cover)


def _trees(nodes: pa.Table) -> Iterator[tuple]:
    """``_tree_arrays`` of every tree, without an object for each node."""
    nodes = nodes.sort_by([("treeID", "ascending"), ("id", "ascending")]).combine_chunks()
    tree, left, right, feature, threshold = (nodes.column(c).to_numpy() for c in (
        "treeID", "left", "right", "feature", "threshold"))
    stats = nodes.column("stats").combine_chunks().flatten().to_numpy().reshape(len(tree), -1)
    starts = np.flatnonzero(np.diff(tree, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(tree)], strict=True):
        cover = stats[a:b].sum(axis=1)
        value = stats[a:b] / np.where(cover[:, None] > 0, cover[:, None], 1.0)
        yield left[a:b], right[a:b], feature[a:b], np.nan_to_num(threshold[a:b]), value, cover


@dataclass
class Leaves:
    """Leaves of one tree as boxes: cuts[f] are the thresholds of feature f; leaf k holds the values
    above cut low[k, f] (-1: unbounded) up to cut high[k, f] (number of cuts: unbounded).

    share[k, f]: part of the training rows that the path's splits on f let through; value[k]: class shares."""
    cuts: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def leaf_boxes(left, right, feature, threshold, value, cover, n_features: int) -> Leaves:
    """The boxes of a tree's leaves, by one walk over its nodes."""
    inner = left >= 0
    cuts = [np.unique(threshold[inner & (feature == f)]) for f in range(n_features)]
    rows = []
    stack = [(0, [-1] * n_features, [len(c) for c in cuts], [1.0] * n_features)]
    while stack:
        node, low, high, share = stack.pop()
        if left[node] < 0:
            rows.append((low, high, share, value[node]))
            continue
        f = feature[node]
        cut = int(np.searchsorted(cuts[f], threshold[node]))
        for child, is_left in ((left[node], True), (right[node], False)):
            lo, hi, sh = low.copy(), high.copy(), share.copy()
            if is_left:
                hi[f] = min(hi[f], cut)
            else:
                lo[f] = max(lo[f], cut)
            sh[f] *= cover[child] / cover[node]
            stack.append((int(child), lo, hi, sh))
    low, high, share, leaf_value = (np.array(c) for c in zip(*rows, strict=True))
    return Leaves(cuts, low, high, share, leaf_value)


def pattern_weights(share: np.ndarray) -> np.ndarray:
    """[feature, leaf, pattern]: the Shapley weight of a feature when the features of the pattern's
    bits lie inside the leaf's box.  A feature the path does not use has share 1 and weight 0."""
    n_leaves, n = share.shape
    inside = (np.arange(1 << n)[None, :] >> np.arange(n)[:, None]) & 1          # [feature, pattern]
    size = np.array([factorial(s) * factorial(n - s - 1) / factorial(n) for s in range(n)])
    out = np.empty((n, n_leaves, 1 << n))
    for i in range(n):
        # coefficients by coalition size of prod(share_j + inside_j * t) over the other features
        poly = np.zeros((n, n_leaves, 1 << n))
        poly[0] = 1.0
        for j in (j for j in range(n) if j != i):
            poly[1:] = poly[1:] * share[None, :, j, None] + poly[:-1] * inside[j][None, None, :]
            poly[0] *= share[:, j, None]
        out[i] = (inside[i][None, :] - share[:, i, None]) * np.tensordot(size, poly, axes=1)
    return out


def box_shap(x: np.ndarray, leaves: Leaves) -> np.ndarray:
    """SHAP values (rows, features, outputs) of one tree for the rows ``x`` by lookup."""
    n_leaves, n = leaves.share.shape
    weight = pattern_weights(leaves.share)
    tables, places = [], []
    for f in range(n):
        if len(leaves.cuts[f]):
            at = np.arange(len(leaves.cuts[f]) + 1)[:, None]
            holds = (at > leaves.low[None, :, f]) & (at <= leaves.high[None, :, f])
            tables.append(holds.astype(np.int32) << f)
            # a missing value goes right at every split, as one beyond all cuts does
            places.append(np.searchsorted(leaves.cuts[f], np.where(np.isnan(x[:, f]), np.inf, x[:, f]), side="left"))
    always = sum(1 << f for f in range(n) if not len(leaves.cuts[f]))
    base = (np.arange(n_leaves, dtype=np.int32) << n) + always
    phi = np.zeros((len(x), n, leaves.value.shape[1]))
    for a in range(0, len(x), LOOKUP_ROWS):
        rows = slice(a, a + LOOKUP_ROWS)
        at = np.repeat(base[None, :], len(x[rows]), axis=0)
        for table, place in zip(tables, places, strict=True):
            at += table[place[rows]]
        for f in range(n):
            if len(leaves.cuts[f]):
                phi[rows, f] = weight[f].ravel().take(at) @ leaves.value
    return phi


class Forest:
    """The trees of a forest, ready to explain rows in a task."""

    def __init__(self, nodes: pd.DataFrame | pa.Table, n_features: int):
        self.n_features = n_features
        trees = list(_trees(nodes)) if isinstance(nodes, pa.Table) else \
            [_tree_arrays(tree) for _, tree in nodes.groupby("treeID", sort=True)]
        self.tables = n_features <= TABLE_FEATURES
        self.trees = [leaf_boxes(*t, n_features) for t in trees] if self.tables else trees
        self.n_classes = trees[0][4].shape[1]

    def cuts(self) -> list[np.ndarray]:
        """Per feature the thresholds of all trees (leaf boxes only)."""
        return [np.unique(np.concatenate([t.cuts[f] for t in self.trees])) for f in range(self.n_features)]

    def explain(self, x: np.ndarray) -> np.ndarray:
        phi = np.zeros((len(x), self.n_features, self.n_classes))
        for tree in self.trees:
            if self.tables:
                phi += box_shap(x, tree)
            else:
                for a in range(0, len(x), WALK_ROWS):
                    phi[a:a + WALK_ROWS] += tree_shap(x[a:a + WALK_ROWS], *tree, n_features=self.n_features)
        return phi / len(self.trees)


class Expected:
    """What a forest says of a cell when only some of its features are known: table[set] over the cells of
    the set's features (bits), with the forest's path-dependent shares for the others."""

    def __init__(self, forest: Forest):
        self.n, self.cuts = forest.n_features, forest.cuts()
        self.sizes = [len(c) + 1 for c in self.cuts]
        low, high = [], []
        for tree in forest.trees:   # places in the tree's cuts -> from and up to which cell of the forest's
            at = [np.concatenate(([0], np.searchsorted(all_, own) + 1, [len(all_) + 1]))
                  for own, all_ in zip(tree.cuts, self.cuts, strict=True)]
            low.append(np.stack([a[tree.low[:, f] + 1] for f, a in enumerate(at)]))
            high.append(np.stack([a[tree.high[:, f] + 1] for f, a in enumerate(at)]))
        ends = (np.concatenate(low, axis=1), np.concatenate(high, axis=1))
        share = np.concatenate([t.share for t in forest.trees]).T
        value = np.concatenate([t.value for t in forest.trees]) / len(forest.trees)
        self.tables = []
        for known in range(1 << self.n):
            some = [f for f in range(self.n) if known >> f & 1]
            shape = [self.sizes[f] + 1 for f in some]
            weight = value * np.prod([share[f] for f in range(self.n) if f not in some], axis=0)[..., None] \
                if len(some) < self.n else value
            table = np.zeros((prod(shape), value.shape[1]))
            for corner in itertools.product((0, 1), repeat=len(some)):   # a box as the differences at its corners
                at = np.zeros(len(value), np.int64)
                for f, end, size in zip(some, corner, shape, strict=True):
                    at = at * size + ends[end][f]
                for c in range(value.shape[1]):
                    table[:, c] += (-1) ** sum(corner) * np.bincount(at, weight[:, c], len(table))
            table = table.reshape(*shape, value.shape[1])
            for axis in range(len(some)):
                np.cumsum(table, axis=axis, out=table)
            self.tables.append(np.ascontiguousarray(table[tuple(slice(-1) for _ in some)]).reshape(-1, value.shape[1]))

    def explain(self, cell: np.ndarray) -> np.ndarray:
        """SHAP values (cells, features, classes) of the cells with these numbers."""
        place = []
        for size in reversed(self.sizes):
            cell, at = np.divmod(cell, size)
            place.insert(0, at)
        says = []
        for known, table in enumerate(self.tables):
            at = np.zeros(len(cell), np.int64)
            for f in (f for f in range(self.n) if known >> f & 1):
                at = at * self.sizes[f] + place[f]
            says.append(table[at])
        phi = np.zeros((len(cell), self.n, says[0].shape[1]))
        for known in range(1 << self.n):
            s = known.bit_count()
            for f in (f for f in range(self.n) if not known >> f & 1):
                phi[:, f] += factorial(s) * factorial(self.n - s - 1) / factorial(self.n) * (says[known | 1 << f] - says[known])
        return phi


def _forest(model: PipelineModel, n_features: int) -> Forest:
    """The forest's arrays on the driver, where Spark ML holds the model too."""
    return Forest(forest_nodes(model).toArrow(), n_features)


def _chunks(batches) -> Iterator[pa.Table]:
    """Record batches joined to tables of about ``ROWS`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _matrix(chunk: pa.Table, first: int) -> np.ndarray:
    columns = [c.to_numpy().astype(np.float64) for c in chunk.columns[first:]]
    return np.stack(columns, axis=1) if columns else np.zeros((chunk.num_rows, 0))


def shap_values(model: PipelineModel, rows: DataFrame, features: Sequence[str], row_key: str) -> DataFrame:
    """Forest SHAP per (row, feature, class) -> (row_key, feature, class_index, shap)."""
    shared = rows.sparkSession.sparkContext.broadcast(_forest(model, len(features)))
    data = rows.select(col(row_key), *[col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])

    def run(batches):
        for chunk in _chunks(batches):
            phi = shared.value.explain(_matrix(chunk, 1))
            r, f, c = (i.ravel() for i in np.indices(phi.shape))
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0).combine_chunks().take(pa.array(r)), pa.array(list(features)).take(pa.array(f)),
                 pa.array(c.astype(np.int32)), pa.array(phi.ravel())], names=[row_key, "feature", "class_index", "shap"])

    schema = data.select(col(row_key)).schema.add("feature", "string").add("class_index", "integer").add("shap", "double")
    return data.mapInArrow(run, schema)


def cells(rows: DataFrame, shared, names: Sequence[str]) -> DataFrame:
    """The columns' distinct cells between the forest's cuts and the rows (``n``) in each: a cell stands as the cuts
    that end it (infinity beyond the last), which go the way of its rows at every split."""
    def run(batches):
        ends = [np.append(c, np.inf) for c in shared.value.cuts()]
        for batch in batches:
            x = _matrix(pa.Table.from_batches([batch]), 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(e[np.searchsorted(e[:-1], np.where(np.isnan(v), np.inf, v), side="left")])
                 for e, v in zip(ends, x.T, strict=True)], names=list(names))

    tasks = max(rows.sparkSession.sparkContext.defaultParallelism,
                int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.mapInArrow(run, ", ".join(f"{c} double" for c in names)).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return found.repartition(tasks)   # few bytes, but all trees are looked up for each


def shap_importance(model: PipelineModel, data: DataFrame, features: Sequence[str], keys: Sequence[str] = (),
                    max_rows: int | None = None) -> DataFrame:
    """M-06: mean |SHAP| per feature over all rows of ``data`` -> (feature, shap, position).

    With ``max_rows``, over a hash sample of so many rows by ``keys``."""
    rows = data if max_rows is None else capped_sample(data, keys, max_rows)
    forest = _forest(model, len(features))
    columns = [f"_f{i}" for i in range(len(features))]
    values = rows.select(*[col(f).cast("double").alias(c) for f, c in zip(features, columns, strict=True)])
    tables = None
    if 0 < len(features) <= TABLE_FEATURES and prod(len(c) + 1 for c in forest.cuts()) * forest.n_classes <= MAX_EXPECTED \
            and rows.count() > cf.FEW_ROWS:
        tables = Expected(forest)
        shared = rows.sparkSession.sparkContext.broadcast(tables)
        counted = with_cell(values, columns, [c.tolist() for c in tables.cuts], "_cell").groupBy("_cell") \
            .agg(F.count(F.lit(1)).alias("n")).select("n", "_cell")
    else:
        shared = rows.sparkSession.sparkContext.broadcast(forest)
        counted = cells(values, shared, columns) if 0 < len(features) <= TABLE_FEATURES else values.withColumn("n", F.lit(1))
        counted = counted.select("n", *columns)
    large = tables is not None   # the tables themselves reach the tasks by broadcast

    def run(batches):
        total, n = np.zeros(len(features)), 0
        for chunk in _chunks(batches):
            count = chunk.column(0).to_numpy()
            phi = shared.value.explain(chunk.column(1).to_numpy() if large else _matrix(chunk, 1))
            total += (np.abs(phi).mean(axis=2) * count[:, None]).sum(axis=0)
            n += int(count.sum())
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(features), dtype=np.int32)), pa.array(total), pa.array(np.full(len(features), n))],
                names=["position", "total", "n"])

    parts = counted.mapInArrow(run, "position int, total double, n long")
    names = F.array(*[F.lit(f) for f in features])
    return parts.groupBy("position").agg((F.sum("total") / F.sum("n")).alias("shap")) \
        .select(F.element_at(names, F.col("position") + 1).alias("feature"), "shap", "position")
