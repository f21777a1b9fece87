"""Model operators M-01..M-13 on Spark ML.

Training and scoring are Spark ML estimators/transformers; the surrounding
steps (rules from the tree, permutation importance, evaluation tables) are
DataFrame plans.  Trees are read back as their node table (the model's own
saved parquet), whose paths become IF-THEN rules.
"""

from __future__ import annotations

import functools
import json
import math
import operator
import os
import uuid
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions import columns as cf
from tabulon.functions.cells import cell_of as _cell
from tabulon.functions.cells import places as _places
from tabulon.functions.cells import with_cell
from tabulon.functions.columns import col, dealt_out, numeric_columns, small_table
from tabulon.functions.ordering import exact_quantiles, long_values
from tabulon.operators import celltrees
from tabulon.operators.rules import RULE_SCHEMA
from tabulon.operators.sample import hash_order
from tabulon.operators.shap import forest_nodes
from tabulon.session import checkpoint_dir

LABEL = "_label"
FEATURES = "_features"
#: A row keeps its node of every tree from level to level instead of walking down from the root each time.
NODE_IDS = {"cacheNodeIds": True, "checkpointInterval": -1}
#: What is read of a saved tree; named, it takes no job to find out.
NODE_SCHEMA = ("id int, leftChild int, rightChild int, impurityStats array<double>, rawCount long,"
               " split struct<featureIndex: int, leftCategoriesOrThreshold: array<double>>")
MAX_CELLS = 4_000_000   # whose predictions may be sent to the tasks (some 24 bytes each)
MAX_CUTS = 20_000       # of a forest, over all features
# M-02 over a large table
MAX_GROWN = 2_000_000   # cells and classes of which a task holds the rows' counts (some 100 bytes each while it grows a tree)
MAX_BAGGED = 1 << 28    # rows x trees fitted together by rows: Spark ML keeps 8 bytes of each on disk
# M-12 over a large table
MAX_SUMMED = 1 << 16    # cells between the candidate cuts, whose sums for every tree a task holds (16 bytes each)
TREE_BINS = 32          # of a feature, as Spark ML's trees have by default
CUT_PLACES = 4096       # evenly spread places of a column's order between which its candidate cuts are chosen
SIDE_BY_SIDE = 16       # fits of single trees at a time


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="keep")


def prepare(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Numeric feature columns as doubles plus the target as text."""
    return df.select(*[col(c).cast("double").alias(c) for c in features], col(target).cast("string").alias(target),
                     *[col(c) for c in df.columns if c not in features and c != target])


def train_tree(df: DataFrame, target: str, features: Sequence[str], max_depth: int = 5, min_leaf: int = 20,
               max_bins: int = 256, seed: int = 42) -> PipelineModel:
    """M-01: label index (sorted classes, T-09) -> feature vector -> decision tree."""
    stages = [StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc"),
              _assembler(features),
              DecisionTreeClassifier(featuresCol=FEATURES, labelCol=LABEL, maxDepth=max_depth,
                                     minInstancesPerNode=min_leaf, maxBins=max_bins, seed=seed)]
    return Pipeline(stages=stages).fit(prepare(df, target, features))


def train_forest(df: DataFrame, target: str, features: Sequence[str], n_trees: int = 200, max_depth: int = 12,
                 max_bins: int = 256, seed: int = 42) -> PipelineModel:
    """M-02: random forest classifier (depth capped; the reference's is unlimited).

    Spark ML keeps for every row how often each tree draws it and its node there, 1.6 KB for 200 trees.  So a
    large table is counted by the cells between candidate cuts, of which the trees are grown; when it has too
    many cells, a few trees are fitted at a time."""
    stages = [StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc"),
              _assembler(features)]
    forest = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, numTrees=n_trees, maxDepth=max_depth,
                                    maxBins=max_bins, seed=seed, featureSubsetStrategy="sqrt", **NODE_IDS)
    data = prepare(df, target, features)
    rows = df.count()
    if rows <= cf.FEW_ROWS:
        return Pipeline(stages=[*stages, forest]).fit(data)
    first = Pipeline(stages=stages).fit(data)
    counted = _class_cells(data, target, features, class_labels(first), max_bins)
    if counted is not None:
        nodes = _grown_nodes(df.sparkSession, *counted, len(class_labels(first)), n_trees, max_depth, seed)
    elif rows * n_trees > MAX_BAGGED:
        nodes = _nodes_by_batches(forest, first.transform(data), max(1, MAX_BAGGED // rows))
    else:
        return PipelineModel([*first.stages, forest.fit(first.transform(data))])
    return PipelineModel([*first.stages, _forest_of(nodes, first, forest, features)])


def _class_cells(df: DataFrame, target: str, features: Sequence[str], labels: Sequence[str],
                 max_bins: int) -> tuple[list[list[float]], pa.Table] | None:
    """Candidate cuts per feature, and (cell, label, n) of all rows between them (None: too many to hold, or there
    are values that Spark ML refuses)."""
    grid = _candidate_cuts(df, features, None, max_bins)
    if grid is None:
        return None
    for i, f in enumerate(features):
        if len(grid[i]) < max_bins - 1:   # few values: all cuts between them, also between those too rare for percentiles
            values = [r[0] for r in df.select(col(f)).distinct().limit(max_bins + 1).collect()]
            grid[i] = _spread_cuts(values, max_bins).tolist() if len(values) <= max_bins else grid[i]
    sizes = [len(c) + 1 for c in grid]
    if math.prod(sizes) * len(labels) >= 1 << 62:
        return None
    y = F.array_position(F.array(*[F.lit(x) for x in labels]), col(target)) - 1
    placed = with_cell(df, features, grid, "_cell").select(F.col("_cell").alias("cell"), y.cast("int").alias("label"))
    counts = placed.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    table = counts.toArrow() if counts.count() <= MAX_GROWN else None
    counts.unpersist()
    return None if table is None or table.column("label").null_count else (grid, table)


def _grown_nodes(spark: SparkSession, grid: list[list[float]], counted: pa.Table, n_classes: int, n_trees: int,
                 max_depth: int, seed: int) -> DataFrame:
    """The nodes of ``n_trees`` trees over counted cells, as Spark ML saves them; a task grows whole trees."""
    sizes = [len(c) + 1 for c in grid]
    counted = counted.sort_by([("cell", "ascending"), ("label", "ascending")])
    cell = counted.column("cell").to_numpy()
    places = np.empty((len(sizes), len(cell)), np.min_scalar_type(max(sizes)))
    for f in reversed(range(len(sizes))):
        cell, places[f] = np.divmod(cell, sizes[f])
    shared = spark.sparkContext.broadcast((places, counted.column("label").to_numpy().astype(np.int16),
                                           counted.column("n").to_numpy()))
    per_node = math.ceil(math.sqrt(len(sizes)))
    cuts = [np.array(c) for c in grid]

    def run(batches):
        places, label, n = shared.value
        for t in (t for batch in batches for t in batch.column(0).to_pylist()):
            rng = np.random.default_rng([seed, t])
            tree = celltrees.grow(places, label, rng.poisson(n), sizes, n_classes, max_depth, per_node, rng)
            k = len(tree.left)
            threshold = np.full(k, np.nan)
            for f, c in enumerate(cuts):
                mine = tree.feature == f
                threshold[mine] = c[tree.cut[mine]]
            stats = pa.ListArray.from_arrays(pa.array(np.arange(0, k * n_classes + 1, n_classes, dtype=np.int32)),
                                             pa.array(tree.stats.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, t, np.int32)), pa.array(np.arange(k, dtype=np.int32)),
                 pa.array(tree.stats.argmax(axis=1).astype(np.float64)), pa.array(tree.impurity), stats,
                 pa.array(tree.stats.sum(axis=1).astype(np.int64)), pa.array(tree.gain),
                 *[pa.array(a.astype(np.int32)) for a in (tree.left, tree.right, tree.feature)], pa.array(threshold)],
                names=["treeID", "id", "prediction", "impurity", "stats", "n", "gain", "left", "right", "feature", "threshold"])

    tasks = min(n_trees, 4 * spark.sparkContext.defaultParallelism)
    grown = spark.range(0, n_trees, numPartitions=tasks).mapInArrow(
        run, "treeID int, id int, prediction double, impurity double, stats array<double>, n long, gain double,"
             " left int, right int, feature int, threshold double")
    inner = F.col("left") >= 0
    return grown.select("treeID", F.struct(
        "id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("n").alias("rawCount"), "gain",
        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
        F.struct(F.col("feature").alias("featureIndex"),
                 F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>"))
                 .alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")).alias("split")).alias("nodeData"))


def _nodes_by_batches(forest: RandomForestClassifier, data: DataFrame, size: int) -> DataFrame:
    """The nodes of the forest's trees, as Spark ML saves them, fitted ``size`` trees at a time over the rows."""
    spark, found = data.sparkSession, []
    for a in range(0, forest.getNumTrees(), size):
        some = forest.copy({forest.numTrees: min(size, forest.getNumTrees() - a), forest.seed: forest.getSeed() + a})
        path = os.path.join(checkpoint_dir(spark), f"forest-{uuid.uuid4().hex}")
        some.fit(data).write().overwrite().save(path)
        found.append(spark.read.parquet(os.path.join(path, "data")).withColumn("treeID", F.col("treeID") + a))
    return functools.reduce(DataFrame.unionByName, found)


def _forest_of(nodes: DataFrame, first: PipelineModel, forest: RandomForestClassifier,
               features: Sequence[str]) -> RandomForestClassificationModel:
    """Spark ML's model with these nodes: a forest of single leaves is saved, and loaded again with them."""
    spark = nodes.sparkSession
    labels = class_labels(first)
    one_each = small_table(spark, [(*[0.0] * len(features), x) for x in labels], ", ".join(
        [f"`{f}` double" for f in features] + [f"`{first.stages[0].getInputCol()}` string"]))
    bare = forest.copy({forest.maxDepth: 0}).fit(first.transform(one_each))
    path = os.path.join(checkpoint_dir(spark), f"forest-{uuid.uuid4().hex}")
    bare.write().overwrite().save(os.path.join(path, "bare"))
    made = os.path.join(path, "made")
    said = json.loads(spark.read.text(os.path.join(path, "bare", "metadata")).first()[0])
    said["paramMap"]["maxDepth"] = forest.getMaxDepth()
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(os.path.join(made, "metadata"))
    spark.read.parquet(os.path.join(path, "bare", "treesMetadata")).write.parquet(os.path.join(made, "treesMetadata"))
    nodes.write.parquet(os.path.join(made, "data"))
    return RandomForestClassificationModel.load(made)


def class_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict(model: PipelineModel, df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Scored rows with ``label`` (index), ``prediction`` (index) and ``predicted_class``."""
    labels = class_labels(model)
    out = model.transform(prepare(df, target, features))
    return out.withColumn("predicted_class", F.element_at(F.array(*[F.lit(x) for x in labels]),
                                                          F.col("prediction").cast("int") + 1))


def accuracy(scored: DataFrame) -> DataFrame:
    """M-03: share of rows whose prediction equals the label (one row)."""
    return scored.agg(F.avg((F.col("prediction") == F.col(LABEL)).cast("double")).alias("accuracy"),
                      F.count(F.lit(1)).alias("n"))


def forest_accuracy(model: PipelineModel, df: DataFrame, target: str, features: Sequence[str]) -> float:
    """M-03 of a forest: over a large table every cell between its cuts is scored once for each class."""
    if df.count() <= cf.FEW_ROWS or (grid := _cells(model, features)) is None or _n_cells(grid) >= 1 << 62:
        return accuracy(predict(model, df, target, features)).first()["accuracy"]
    cells = with_cell(df, features, grid, "_cell").groupBy("_cell", col(target)).agg(F.count(F.lit(1)).alias("_n"))
    ends = cells.select(col(target), "_n", *[e.alias(f) for e, f in zip(_cell_ends(grid), features, strict=True)])
    hit = F.col("prediction") == F.col(LABEL)
    return predict(model, ends, target, features).agg(F.sum(F.when(hit, F.col("_n")).otherwise(0)) / F.sum("_n")).first()[0]


# --- M-07: tree -> rules ---------------------------------------------------------

def tree_nodes(model: PipelineModel) -> DataFrame:
    """Node table of the fitted tree (id, leftChild, rightChild, split,
    impurityStats, rawCount), read back from the model's saved data in the
    shared checkpoint folder."""
    tree = model.stages[-1]
    spark = SparkSession.getActiveSession()
    path = os.path.join(checkpoint_dir(spark), f"tree-{uuid.uuid4().hex}")
    tree.write().overwrite().save(path)
    return spark.read.schema(NODE_SCHEMA).parquet(os.path.join(path, "data"))


def tree_rules(model: PipelineModel, features: Sequence[str], digits: int = 4) -> DataFrame:
    """M-07: one rule per leaf in depth-first (left first) order:
    rule_id, conditions array<string> (``f <= t`` left, ``f > t`` right),
    prediction (majority class), confidence (its share, 4 dp), samples."""
    nodes = tree_nodes(model)
    labels = class_labels(model)
    names = F.array(*[F.lit(f) for f in features])
    thr = F.format_string(f"%.{digits}f", F.get(F.col("split.leftCategoriesOrThreshold"), 0))
    fname = F.get(names, F.col("split.featureIndex"))   # a leaf has none
    best = F.array_position(F.col("impurityStats"), F.array_max("impurityStats")).cast("int")
    share = F.element_at("impurityStats", best) / F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b)
    # the fitted tree lies in the driver, so its nodes, at most 2^(depth + 1), may be walked there
    node = {r["id"]: r for r in nodes.select(
        "id", "leftChild", "rightChild", fname.alias("fname"), thr.alias("thr"),
        F.element_at(F.array(*[F.lit(x) for x in labels]), best).alias("prediction"),
        F.round(share, 4).alias("confidence"), F.col("rawCount").cast("long").alias("samples")).collect()}
    rules, todo = [], [(0, [])]
    while todo:
        at, conditions = todo.pop()
        n = node[at]
        if n["leftChild"] < 0:
            rules.append((len(rules), conditions, n["prediction"], n["confidence"], n["samples"]))
        else:
            todo += [(n["rightChild"], [*conditions, f"{n['fname']} > {n['thr']}"]),
                     (n["leftChild"], [*conditions, f"{n['fname']} <= {n['thr']}"])]
    return small_table(nodes.sparkSession, rules, RULE_SCHEMA)


# --- M-04: cross-validation ------------------------------------------------------------

def cross_validate(df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str], folds: DataFrame,
                   n_trees: int = 50, max_depth: int = 12, seed: int = 42) -> DataFrame:
    """M-04: forest accuracy per fold (folds from P-07) -> (n_folds, cv_mean, cv_std)
    with the population standard deviation, as the reference reports it."""
    folds = folds.checkpoint(eager=True)   # every fit and scoring reads them; the sample is drawn once
    k = folds.agg(F.max("fold")).first()[0] + 1

    def fold_accuracy(f):
        train = folds.where(F.col("fold") != f)
        test = folds.where(F.col("fold") == f)
        m = train_forest(train, target, features, n_trees=n_trees, max_depth=max_depth, seed=seed)
        return accuracy(predict(m, test, target, features)).first()["accuracy"]

    with ThreadPool(k) as pool:  # k <= 5 fits, each distributed, side by side as Spark ML's CrossValidator fits
        accs = pool.map(inheritable_thread_target(df.sparkSession)(fold_accuracy), range(k))
    mean = sum(accs) / k
    std = math.sqrt(sum((a - mean) ** 2 for a in accs) / k)
    return small_table(df.sparkSession, [(k, mean, std)], "n_folds int, cv_mean double, cv_std double")


# --- M-05: permutation importance ------------------------------------------------------

def permutation_importance(model: PipelineModel, test: DataFrame, target: str, features: Sequence[str],
                           keys: Sequence[str], repeats: int = 10, seed: int = 42,
                           bucket_rows: int = 100_000) -> DataFrame:
    """M-05: mean and (population) std of the accuracy drop when one feature's
    values are permuted, over ``repeats`` permutations.

    A permutation is drawn per repeat without a global sort: rows fall into
    random buckets of about ``bucket_rows`` and every row takes the feature
    values of the next row of its bucket (cyclic, random order).  The copies
    with one permuted feature each are made by a projection after that single
    shuffle.  A forest predicts the same between the same cuts: when its cells
    are fewer than the copies, rows stand as their cells, each cell is scored
    once and the copies look their predictions up; otherwise all are scored.
    The rows of a large table are dealt to their buckets once, as cells, and
    permuted there ``repeats`` times.
    """
    base = test.withColumn("_rid", hash_order(keys))
    n = base.count()
    buckets = max(1, math.ceil(n / bucket_rows))
    base_acc = forest_accuracy(model, base, target, features)
    grid = _cells(model, features)
    as_cells = grid is not None and _n_cells(grid) <= min(n * repeats * len(features), MAX_CELLS)
    if as_cells and n > cf.FEW_ROWS:
        drops = _drops_by_bucket(model, base, target, features, grid, base_acc, repeats, seed, buckets)
        return small_table(base.sparkSession, [(f, float(d.mean()), float(d.std()), i) for i, (f, d) in enumerate(
            zip(features, drops.T, strict=True))],
            "feature string, importance double, importance_std double, position int")
    values = _places(base, features, grid) if as_cells else [col(f).cast("double") for f in features]
    own = F.struct(*[v.alias(f) for v, f in zip(values, features, strict=True)])
    drawn = base.select("_rid", col(target), own.alias("_own"),
                        F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("rep"))
    h = F.xxhash64("_rid", "rep", F.lit(seed))
    drawn = drawn.withColumn("_o", h).withColumn("_b", F.pmod(h, F.lit(buckets)))
    w = Window.partitionBy("rep", "_b").orderBy("_o", "_rid")
    other = F.coalesce(F.lead("_own").over(w), F.first("_own").over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    swappable = drawn.withColumn("_other", other)
    if as_cells:
        scored = _scored_by_cell(model, swappable, target, features, grid)
    else:
        copies = swappable.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
        swapped = copies.select("feature", "rep", col(target), *[
            F.when(F.col("feature") == F.lit(f), F.col("_other").getField(f)).otherwise(F.col("_own").getField(f)).alias(f)
            for f in features])
        scored = predict(model, swapped, target, features)
    per_rep = scored.groupBy("feature", "rep").agg(
        (F.lit(base_acc) - F.avg((F.col("prediction") == F.col(LABEL)).cast("double"))).alias("drop"))
    pos = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    return per_rep.groupBy("feature").agg(F.avg("drop").alias("importance"),
                                          F.stddev_pop("drop").alias("importance_std")) \
        .withColumn("position", F.element_at(pos, F.col("feature")))


def _cells(model: PipelineModel, features: Sequence[str]) -> list[list[float]] | None:
    """Per feature the thresholds of all trees, ascending (None: too many to hold, or the splits are not ordered)."""
    cuts = forest_nodes(model).where("left >= 0").select("feature", "threshold").distinct().limit(MAX_CUTS + 1).collect()
    if len(cuts) > MAX_CUTS or any(r["threshold"] is None for r in cuts):
        return None
    return [sorted(r["threshold"] for r in cuts if r["feature"] == f) for f in range(len(features))]


def _n_cells(grid: list[list[float]]) -> int:
    return math.prod(len(c) + 1 for c in grid)


def _cell_ends(grid: list[list[float]]) -> list[Column]:
    """The features of ``_cell``, which stands as the cuts that end it."""
    sizes = [len(c) + 1 for c in grid]

    def end(f):
        ends = F.array(*[F.lit(float(x)) for x in [*grid[f], math.inf]])
        return F.get(ends, (F.expr(f"_cell div {math.prod(sizes[f + 1:])}") % sizes[f]).cast("int"))

    return [end(f) for f in range(len(grid))]


def _cell_predictions(model: PipelineModel, spark: SparkSession, features: Sequence[str],
                      grid: list[list[float]]) -> DataFrame:
    """(_cell, prediction) of all cells."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = spark.range(0, _n_cells(grid), numPartitions=tasks).select(F.col("id").alias("_cell")) \
        .select("_cell", *[e.alias(f) for e, f in zip(_cell_ends(grid), features, strict=True)])
    return model.stages[-1].transform(model.stages[1].transform(cells)).select("_cell", "prediction")


def _drops_by_bucket(model: PipelineModel, base: DataFrame, target: str, features: Sequence[str],
                     grid: list[list[float]], base_acc: float, repeats: int, seed: int, buckets: int) -> np.ndarray:
    """The drop of accuracy by repeat and feature.  What is shuffled of a row is its hash, class and cell."""
    spark = base.sparkSession
    sizes = [len(c) + 1 for c in grid]
    strides = [math.prod(sizes[i + 1:]) for i in range(len(sizes))]
    labels = class_labels(model)
    known = _cell_predictions(model, spark, features, grid) \
        .select(F.col("_cell").cast("int"), F.col("prediction").cast("short")).toArrow()
    said = np.empty(math.prod(sizes), np.int16)
    said[known.column("_cell").to_numpy()] = known.column("prediction").to_numpy()
    shared = spark.sparkContext.broadcast(said)
    h = F.xxhash64("_rid", F.lit(seed))
    label = F.array_position(F.array(*[F.lit(x) for x in labels]), col(target).cast("string")) - 1
    rows = with_cell(base, features, grid, "_cell").select(
        F.pmod(h, F.lit(buckets)).cast("int").alias("b"), h.alias("o"),
        F.coalesce(label.cast("short"), F.lit(-1).cast("short")).alias("y"), F.col("_cell").cast("int"))

    def run(batches):
        if not (held := list(batches)):
            return
        said = shared.value
        b, o, y, cell = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        order = np.lexsort((cell, y, o, b))   # the same whatever order the rows came in
        b, y, cell = b[order], y[order], cell[order].astype(np.int64)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(b)) + 1, [len(b)]))
        hits = np.zeros((repeats, len(sizes)), np.int64)
        for a, e in zip(starts, starts[1:], strict=False):
            place = [cell[a:e] // s % n for s, n in zip(strides, sizes, strict=True)]
            for rep in range(repeats):
                drawn = np.random.default_rng([seed, int(b[a]), rep]).permutation(e - a)
                other = np.empty(e - a, np.int64)
                other[drawn] = np.roll(drawn, -1)
                for f, s in enumerate(strides):
                    moved = cell[a:e] + (place[f][other] - place[f]) * s
                    hits[rep, f] += np.count_nonzero(said[moved] == y[a:e])
        r, f = (i.ravel().astype(np.int32) for i in np.indices(hits.shape))
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(f), pa.array(hits.ravel()),
                                          pa.array(np.full(len(r), np.count_nonzero(y >= 0)))],
                                         names=["rep", "f", "hits", "n"])

    found = rows.repartition(buckets, "b").mapInArrow(run, "rep int, f int, hits long, n long") \
        .groupBy("rep", "f").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()   # repeats x features
    drops = np.zeros((repeats, len(sizes)))
    for r in found:
        drops[r["rep"], r["f"]] = base_acc - r["hits"] / r["n"]
    return drops


def _scored_by_cell(model: PipelineModel, swappable: DataFrame, target: str, features: Sequence[str],
                    grid: list[list[float]]) -> DataFrame:
    """(feature, rep, label, prediction) of every copy, from the predictions of all cells."""
    sizes = [len(c) + 1 for c in grid]
    strides = [math.prod(sizes[i + 1:]) for i in range(len(sizes))]
    known = _cell_predictions(model, swappable.sparkSession, features, grid)
    home = sum((F.col("_own").getField(f) * F.lit(s).cast("long") for f, s in zip(features, strides, strict=True)),
               F.lit(0).cast("long"))
    moved = F.array(*[F.struct(F.lit(f).alias("feature"), (home + (
        F.col("_other").getField(f) - F.col("_own").getField(f)) * F.lit(s).cast("long")).alias("_cell"))
        for f, s in zip(features, strides, strict=True)])
    labels = F.array(*[F.lit(x) for x in class_labels(model)])
    copies = swappable.select("rep", (F.array_position(labels, col(target).cast("string")) - 1).cast("double").alias(LABEL),
                              F.inline(moved))
    return copies.join(F.broadcast(known), "_cell").select("feature", "rep", LABEL, "prediction")


# --- M-08 .. M-10: evaluation tables ---------------------------------------------------

def confusion(scored: DataFrame, label_col: str, prediction_col: str) -> DataFrame:
    """M-08: (actual, predicted, n) for every observed pair."""
    return scored.groupBy(col(label_col).alias("actual"), col(prediction_col).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_report(conf: DataFrame) -> DataFrame:
    """M-09: precision, recall, F1 and support per class, plus macro and
    weighted averages, from the confusion table (classes x classes rows)."""
    tp = conf.where(F.col("actual") == F.col("predicted")).groupBy("actual").agg(F.sum("n").alias("tp"))
    support = conf.groupBy("actual").agg(F.sum("n").alias("support"))
    predicted = conf.groupBy(F.col("predicted").alias("actual")).agg(F.sum("n").alias("n_pred"))
    per = support.join(tp, "actual", "left").join(predicted, "actual", "full").select(
        F.col("actual").alias("class"), F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"))
    per = per.select("class", "support",
                     F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0)).alias("precision"),
                     F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0)).alias("recall"))
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                         .otherwise(F.lit(0.0)))
    macro = per.agg(F.lit("macro avg").alias("class"), F.sum("support").alias("support"),
                    F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    weighted = per.agg(F.lit("weighted avg").alias("class"), F.sum("support").alias("support"),
                       *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m)
                         for m in ("precision", "recall", "f1")])
    return per.unionByName(macro).unionByName(weighted)


def train_test_gap(scored: DataFrame, split_col: str, label_col: str, prediction_col: str) -> DataFrame:
    """M-10: accuracy on train and test and their difference (one row)."""
    hit = (col(label_col) == col(prediction_col)).cast("double")
    return scored.agg(F.avg(F.when(col(split_col) == "train", hit)).alias("train_accuracy"),
                      F.avg(F.when(col(split_col) == "test", hit)).alias("test_accuracy")) \
        .withColumn("gap", F.col("train_accuracy") - F.col("test_accuracy"))


# --- M-11: probabilities for new rows --------------------------------------------------

def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    q = exact_quantiles(long_values(df, list(columns)), [0.5]).collect()  # one row per column
    return {r["column_name"]: r["quantile"] for r in q}


def medians_row(df: DataFrame, features: Sequence[str], overrides: dict | None = None,
                known: dict | None = None) -> DataFrame:
    """One row of feature medians (``known``: found before) with ``overrides`` applied (numbers only)."""
    med = dict(medians(df, features) if known is None else known)
    for k, v in (overrides or {}).items():
        if k in med:
            try:
                med[k] = float(v)
            except (TypeError, ValueError):
                pass
    spark = df.sparkSession
    return spark.createDataFrame([tuple(med.get(f) for f in features)], ", ".join(f"`{f}` double" for f in features))


def class_probabilities(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """M-11: (row_id, class, probability) for every class."""
    labels = class_labels(model)
    scored = model.stages[-1].transform(model.stages[1].transform(
        rows.select(*[col(f).cast("double").alias(f) for f in features])
        .withColumn("row_id", F.monotonically_increasing_id())))
    probs = vector_to_array("probability")
    return scored.select("row_id", F.posexplode(probs).alias("_i", "probability")).select(
        "row_id", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("_i") + 1).alias("class"), "probability")


# --- M-12: regression -------------------------------------------------------------

def regress(df: DataFrame, target: str, facts: dict | None = None, n_trees: int = 80, max_depth: int = 12,
            seed: int = 42, top: int = 5):
    """M-12: forest regression of ``target`` on the other numeric columns
    (median-filled), prediction for a facts row (medians + overrides), R^2 on
    the training rows and the ``top`` impurity importances.

    A tree sees of a row only between which candidate cuts its values lie.  So a large table with few such
    cells is drawn for all trees in one pass, which sums each tree's draws by cell, and the trees grow over
    the cells; otherwise each level of the trees passes over the rows.

    Returns (summary one-row DataFrame, importances DataFrame).
    """
    feats = [c for c in numeric_columns(df) if c != target]
    cols = feats + [target]
    rows = df.count()
    df = dealt_out(df.select(*[col(c) for c in cols]), rows)
    med = medians(df, cols)
    filled = df.select(*[F.coalesce(col(c).cast("double"), F.lit(med.get(c))).alias(c) for c in cols])
    row = medians_row(filled, feats, facts, known=med)   # filling with a median leaves it the median
    grid = _candidate_cuts(filled, feats, target) if rows > cf.FEW_ROWS else None
    if grid and math.prod(len(c) + 1 for c in grid) <= MAX_SUMMED:
        pred, r2, imp = _forest_by_cell(filled, target, feats, grid, row, n_trees, max_depth, seed)
        df.unpersist()
    else:
        model = Pipeline(stages=[_assembler(feats), RandomForestRegressor(
            featuresCol=FEATURES, labelCol=target, numTrees=n_trees, maxDepth=max_depth, seed=seed,
            featureSubsetStrategy="all", **NODE_IDS)]).fit(filled)
        scored = model.transform(filled)
        fit = scored.agg(F.avg(target).alias("_m")).first()["_m"]
        r2 = scored.agg((1 - F.sum((F.col(target) - F.col("prediction")) ** 2)
                         / F.sum((F.col(target) - F.lit(fit)) ** 2)).alias("r2")).first()["r2"]
        pred = model.transform(row).first()["prediction"]
        imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = df.sparkSession
    summary = spark.createDataFrame([(target, float(pred), float(r2), len(feats))],
                                    "target string, prediction double, r2 double, n_features int")
    ranked = sorted(zip(feats, imp), key=lambda x: -x[1])[:top]
    importances = spark.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(ranked)],
                                        "feature string, importance double, rank int")
    return summary, importances


def _spread_cuts(values: Sequence[float], bins: int) -> np.ndarray:
    """At most ``bins - 1`` cuts midway between neighbouring values: all of them, or those that leave about as
    many values between one and the next."""
    distinct, counts = np.unique(np.array(values, dtype=np.float64), return_counts=True)
    cuts = distinct[:-1] / 2 + distinct[1:] / 2
    if len(cuts) >= bins:
        under = np.cumsum(counts)[:-1]
        wanted = len(values) * np.arange(1, bins) / bins
        after = np.searchsorted(under, wanted).clip(1, len(under) - 1)
        cuts = cuts[np.unique(after - (wanted - under[after - 1] < under[after] - wanted))]
    return cuts


def _candidate_cuts(df: DataFrame, features: Sequence[str], target: str | None,
                    bins: int = TREE_BINS) -> list[list[float]] | None:
    """Per feature the cuts that a tree may choose from, ascending, from percentiles of all rows (None: there are
    values, also of a ``target``, that Spark ML refuses)."""
    at = [i / CUT_PLACES for i in range(CUT_PLACES + 1)]
    finite = [F.coalesce(F.abs(col(c)) < F.lit(math.inf), F.lit(False)) for c in (*features, *([target] if target else []))]
    # one task merges the tasks' summaries: no more of them than cores
    row = df.coalesce(df.sparkSession.sparkContext.defaultParallelism).agg(
        *[F.percentile_approx(col(f), at, 10_000).alias(f"q{i}") for i, f in enumerate(features)],
        F.count_if(~functools.reduce(operator.and_, finite)).alias("refused")).first()
    if row["refused"]:
        return None
    return [_spread_cuts(row[f"q{i}"], bins).tolist() for i in range(len(features))]


def _bootstrap_sums(cells: DataFrame, n_trees: int, n_cells: int, seed: int) -> DataFrame:
    """(tree, cell, n, total): how many of a cell's rows (``_cell``, ``_y``) a tree draws, and the sum of their
    labels.  Every tree draws every row Poisson(1) times, on its own, as Spark ML's forests do: that is a
    Poisson number of draws of any row."""
    def chunks(batches):
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= cf.ROWS_PER_TASK:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def run(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        n, total = np.zeros((2, n_trees, n_cells))
        for rows in chunks(batches):
            cell, y = (rows[c].to_numpy() for c in ("_cell", "_y"))
            for t in range(n_trees):
                drawn = rng.integers(0, len(y), rng.poisson(len(y)))
                at = cell[drawn]
                n[t] += np.bincount(at, minlength=n_cells)
                total[t] += np.bincount(at, y[drawn], n_cells)
        for t in range(n_trees):
            at = np.flatnonzero(n[t])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(at), pa.array(n[t, at]),
                                              pa.array(total[t, at])], names=["tree", "_cell", "n", "total"])

    # a task adds up all its rows first: what is shuffled is bounded by cores x trees x cells
    tasks = cells.coalesce(cells.sparkSession.sparkContext.defaultParallelism)
    return tasks.mapInArrow(run, "tree int, _cell long, n double, total double") \
        .groupBy("tree", "_cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _forest_by_cell(df: DataFrame, target: str, features: Sequence[str], grid: list[list[float]], row: DataFrame,
                    n_trees: int, max_depth: int, seed: int) -> tuple[float, float, list[float]]:
    """The forest of ``regress`` grown over the cells of ``grid`` -> (prediction for ``row``, R^2, importances).

    A cell stands for its rows with their number and mean label: the spread within a cell is the same on
    both sides of every split, so no split, mean or gain depends on it."""
    spark = df.sparkSession
    sizes = [len(c) + 1 for c in grid]
    strides = [math.prod(sizes[i + 1:]) for i in range(len(sizes))]
    placed = df.select(_cell(_places(df, features, grid), sizes).alias("_cell"), col(target).alias("_y"))
    assembler = VectorAssembler(inputCols=[f"_p{i}" for i in range(len(grid))], outputCol=FEATURES)

    def with_places(cells):   # a feature is the number of its interval
        parts = [((F.col("_cell") / s).cast("long") % n).cast("double").alias(f"_p{i}")
                 for i, (s, n) in enumerate(zip(strides, sizes, strict=True))]
        return assembler.transform(cells.select("*", *parts))

    sums = with_places(_bootstrap_sums(placed, n_trees, math.prod(sizes), seed).select(
        "tree", "_cell", "n", (F.col("total") / F.col("n")).alias("_y")))
    sums = sums.repartition(spark.sparkContext.defaultParallelism, "tree").sortWithinPartitions("tree", "_cell").persist()
    sums.count()

    def grown(t):   # at most MAX_SUMMED rows
        return DecisionTreeRegressor(featuresCol=FEATURES, labelCol="_y", weightCol="n", maxDepth=max_depth,
                                     maxBins=TREE_BINS, seed=seed + t, predictionCol=f"_t{t}") \
            .fit(sums.where(F.col("tree") == t).coalesce(1))

    with ThreadPool(min(n_trees, SIDE_BY_SIDE)) as pool:
        trees = pool.map(inheritable_thread_target(spark)(grown), range(n_trees), chunksize=1)
    sums.unpersist()
    whole = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("_y"),
                                        (F.var_pop("_y") * F.count(F.lit(1))).alias("within"))
    scored = with_places(whole)
    for tree in trees:
        scored = tree.transform(scored)
    scored = scored.select("n", "_y", "within", (sum(F.col(f"_t{t}") for t in range(n_trees)) / n_trees).alias("p"))
    scored = scored.withColumn("_m", F.sum(F.col("n") * F.col("_y")).over(Window.partitionBy())
                               / F.sum("n").over(Window.partitionBy()))   # one row per cell
    r2 = scored.agg(1 - F.sum(F.col("within") + F.col("n") * (F.col("_y") - F.col("p")) ** 2)
                    / F.sum(F.col("within") + F.col("n") * (F.col("_y") - F.col("_m")) ** 2)).first()[0]
    wanted = row.first()
    at = Vectors.dense([float(np.searchsorted(c, math.nan if wanted[f] is None else wanted[f]))
                        for f, c in zip(features, grid, strict=True)])
    shares = np.mean([tree.featureImportances.toArray() for tree in trees], axis=0)
    return sum(tree.predict(at) for tree in trees) / n_trees, r2, (shares / (shares.sum() or 1.0)).tolist()


# --- M-13 ---------------------------------------------------------------------------

def driver_ranking(importances: DataFrame, top: int = 8) -> DataFrame:
    """M-13: SHAP importance when present, else permutation importance; top ``top``."""
    score = F.coalesce(F.col("shap"), F.col("importance")) if "shap" in importances.columns else F.col("importance")
    ranked = importances.withColumn("score", score).orderBy(F.desc("score"), "position").limit(top)
    w = Window.orderBy(F.desc("score"), "position")  # at most `top` rows
    return ranked.select(F.row_number().over(w).alias("rank"), "feature", "score")
