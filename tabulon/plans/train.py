"""The "file -> trained state" plan as a composition of operators.

guards (C-26) -> target detection (T-01) -> target tiers (T-02..T-06) ->
cleaning (C-17) -> guards -> stratified split (P-04, P-05) -> decision tree
(M-01) -> rules (M-07) -> forest (M-02) -> accuracies (M-03) -> permutation
importance (M-05) -> cross-validation on a capped hash sample (P-06, P-07, M-04).
Everything after the split is fitted on demand.  Every step is a Spark job; only one-row results and the bounded rule base
reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions import columns
from tabulon.functions.columns import col
from tabulon.operators import clean as cl
from tabulon.operators import model as md
from tabulon.operators import sample as sp
from tabulon.operators import target as tg


HASHED = "_row_keys_hash"   # of a large table, until it is split


@dataclass
class TrainedState:
    """The prepared table and what is fitted on it; every part is fitted once, when it is first asked for."""
    target: str
    features: list[str]
    keys: list[str]
    data: DataFrame
    tree_depth: int = 5
    n_trees: int = 200
    forest_depth: int = 12
    permutation_repeats: int = 10
    cv_cap: int = 20_000
    with_importance: bool = True
    with_cv: bool = True
    extras: dict = field(default_factory=dict)

    @cached_property
    def train(self) -> DataFrame:
        return self.data.where(F.col("split") == "train")

    @cached_property
    def test(self) -> DataFrame:
        return self.data.where(F.col("split") == "test")

    @cached_property
    def tree(self) -> PipelineModel:
        return md.train_tree(self.train, self.target, self.features, max_depth=self.tree_depth)

    @cached_property
    def rules(self) -> DataFrame:
        return md.tree_rules(self.tree, self.features)

    @cached_property
    def forest(self) -> PipelineModel:
        return md.train_forest(self.train, self.target, self.features, n_trees=self.n_trees, max_depth=self.forest_depth)

    def _accuracy(self, model: PipelineModel) -> float:
        return md.accuracy(md.predict(model, self.test, self.target, self.features)).first()["accuracy"]

    @cached_property
    def tree_accuracy(self) -> float:
        return self._accuracy(self.tree)

    @cached_property
    def forest_accuracy(self) -> float:
        return md.forest_accuracy(self.forest, self.test, self.target, self.features)

    @cached_property
    def importances(self) -> DataFrame | None:
        return md.permutation_importance(self.forest, self.test, self.target, self.features, self.keys,
                                         repeats=self.permutation_repeats) if self.with_importance else None

    @cached_property
    def cv(self) -> DataFrame | None:
        if not self.with_cv:
            return None
        # the first rows in hash order are the first of their classes, too: test rows, where every class has so many
        n_test = self.data.groupBy(col(self.target)).agg(F.count_if(F.col("split") == "test").alias("n"))
        rows = self.test if n_test.agg(F.min("n")).first()[0] >= self.cv_cap else self.data
        capped = sp.capped_sample(rows.drop("split"), self.keys, self.cv_cap).checkpoint(eager=True)
        folds = sp.stratified_folds(capped, self.target, self.keys)
        return md.cross_validate(capped, self.target, self.features, self.keys, folds, n_trees=50,
                                 max_depth=self.forest_depth)


def train_agent(df: DataFrame, keys: Sequence[str], target_request: str | None = None, tree_depth: int = 5,
                n_trees: int = 200, forest_depth: int = 12, test_fraction: float = 0.2,
                permutation_repeats: int = 10, cv_cap: int = 20_000, with_importance: bool = True,
                with_cv: bool = True) -> TrainedState:
    keys = list(keys)
    rows = df.count()
    many = rows > columns.FEW_ROWS
    dealt = df = columns.dealt_out(df, rows)
    features_only = df.drop(*keys)  # row keys are never targets or features
    base = target_request[:-len("_tier")] if target_request and target_request.endswith("_tier") else None
    if target_request and target_request not in df.columns and base in features_only.columns:
        target = target_request  # explicit request for tiers of an existing column (T-02)
    else:
        target = tg.detect_target(features_only, target_request).first()["target"]
    model_df = tg.ensure_target(df, target)
    clean_df = _clean_with_keys(model_df, keys, target)
    features = [c for c in clean_df.columns if c != target and c not in keys]
    if many:  # hashed in every pass that asks: kept, the hashes would take as much disk as all else of the rows
        clean_df = clean_df.withColumn(HASHED, sp.hash_order(keys))
    guards = cl.training_guards(clean_df.drop(*keys, HASHED), target)  # what the models are trained on
    failed = [r["check"] for r in guards.collect() if not r["passed"]]  # six rows
    if failed:
        raise ValueError(f"training guards failed: {failed}")
    data = sp.drop_singleton_classes(clean_df, target)
    # many fits and scorings reuse this table: a small one is materialised in the shared checkpoint folder, a large
    # one stays in the tasks it was dealt to, by columns
    if many:
        data = sp.stratified_split(data, target, keys, test_fraction, HASHED).persist(StorageLevel.MEMORY_AND_DISK_DESER)
        data.count()
        dealt.unpersist()
    else:
        data = sp.stratified_split(data, target, keys, test_fraction).checkpoint(eager=True)
    return TrainedState(target, features, keys, data, tree_depth, n_trees, forest_depth, permutation_repeats, cv_cap,
                        with_importance, with_cv)


def _clean_with_keys(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Clean the table while the row keys ride along untouched: they are
    packed into one struct column, which no cleaning pass rewrites (passes act
    on text, numeric and datetime columns), and unpacked afterwards."""
    packed = df.select(F.struct(*[F.col(k) for k in keys]).alias("_row_keys"),
                       *[F.col(f"`{c}`") for c in df.columns if c not in keys])
    cleaned = cl.clean(packed, target=target, carried=("_row_keys",))
    return cleaned.select("_row_keys.*", *[F.col(f"`{c}`") for c in cleaned.columns if c != "_row_keys"])
