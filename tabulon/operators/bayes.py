"""Naive-Bayes style abduction R-05..R-07.

``fit`` builds one long conditional probability table
(feature, bin, bin_label, class, n, likelihood): features are unpivoted once,
binned with the equal-width edges of T-08 (edges come from one min/max
aggregate), counted with a partial-aggregated ``groupBy``, smoothed over the
observed bin x class grid of each feature and normalised per class with a
window over (feature, class) — groups whose size is bounded by the bin count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import col, is_numeric, present
from tabulon.operators.target import bin_index, equal_width_edges


def fit(df: DataFrame, target: str, features: Sequence[str] | None = None, bins: int = 5,
        alpha: float = 1.0) -> DataFrame:
    """R-05: conditional probability table P(bin | class) per feature."""
    feats = list(features or [c for c in df.columns if c != target])
    # text and boolean features are categories (their values are the bins), numbers get equal-width bins
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in feats if is_numeric(kinds[c]) and not isinstance(kinds[c], T.BooleanType)]
    ends = df.agg(F.count(F.lit(1)), *[F.min(present(col(c), kinds[c]).cast("double")).alias(f"lo{i}")
                                       for i, c in enumerate(numeric)],
                  *[F.max(present(col(c), kinds[c]).cast("double")).alias(f"hi{i}")
                    for i, c in enumerate(numeric)]).first()
    labels, structs = {}, []
    for i, c in enumerate(feats):
        if c in numeric:
            lo, hi = ends[f"lo{numeric.index(c)}"], ends[f"hi{numeric.index(c)}"]
            if lo is None:
                continue
            edges = equal_width_edges(lo, hi, bins)
            labels[c] = [f"{edges[j]:.2f}–{edges[j + 1]:.2f}" for j in range(bins)]
            at, name = bin_index(present(col(c), kinds[c]).cast("double"), [F.lit(e) for e in edges]), None
        else:
            at, name = F.when(col(c).isNotNull(), F.lit(-1)), col(c).cast("string")
        structs.append(F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), at.cast("int").alias("bin"),
                                (name if name is not None else F.lit(None).cast("string")).alias("category")))
    # unpivot: one (feature, position, bin, category, class) row per non-null cell
    long = df.select(col(target).cast("string").alias("class"), F.explode_outer(F.array(*structs)).alias("_f")) \
        .select("_f.feature", "_f.position", "_f.bin", "_f.category", "class") \
        .where(F.col("bin").isNotNull() & F.col("class").isNotNull())
    return _table(long, labels, bins, alpha)


def _table(long: DataFrame, labels: dict[str, list[str]], bins: int, alpha: float) -> DataFrame:
    """Smoothed likelihoods over the observed bin x class grid of each feature; categories are
    numbered in sorted order."""
    cats = long.where("category IS NOT NULL").select("feature", "category").distinct()
    coded = cats.withColumn("code", F.row_number().over(Window.partitionBy("feature").orderBy("category")) - 1)
    counts = long.groupBy("feature", "position", "bin", "category", "class").agg(F.count(F.lit(1)).alias("n")) \
        .join(coded, ["feature", "category"], "left").withColumn("bin", F.coalesce("code", "bin")).drop("code")
    obs_bins = counts.select("feature", "position", "bin", "category").distinct()
    obs_classes = counts.select("feature", "class").distinct()
    grid = obs_bins.join(obs_classes, "feature")  # <= bins x classes per feature
    table = grid.join(counts.drop("category"), ["feature", "position", "bin", "class"], "left") \
        .withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    w_class = Window.partitionBy("feature", "class")
    w_feat = Window.partitionBy("feature")
    label_map = F.create_map(*[x for c, own in labels.items() for x in
                               (F.lit(c), F.array(*[F.lit(s) for s in own]))]) if labels \
        else F.create_map().cast("map<string,array<string>>")
    n_obs_bins = F.size(F.collect_set("bin").over(w_feat))
    smoothed = (F.col("n") + F.lit(alpha)) / F.sum(F.col("n") + F.lit(alpha)).over(w_class)
    return table.select(
        "feature", "position", "bin",
        F.when(F.col("category").isNotNull(), F.col("category")).when(n_obs_bins == bins, F.element_at(F.element_at(label_map, F.col("feature")), F.col("bin") + 1))
        .otherwise(F.col("bin").cast("string")).alias("bin_label"),
        "class", "n", smoothed.alias("likelihood"))


def explain(cpt: DataFrame, outcome: str, top_k: int = 5, classes: DataFrame | None = None) -> DataFrame:
    """R-06: best bin per feature for ``outcome`` -> (rank, feature,
    feature_value_range, posterior_score, likelihood, marginal).

    score = P(bin | outcome) x mean over classes of P(bin | class), rounded
    to 6 places; ties keep feature order, then bin order.
    """
    known = cpt.select("class").distinct() if classes is None else classes
    if known.where(F.col("class") == F.lit(outcome)).limit(1).count() == 0:
        raise ValueError(f"outcome '{outcome}' not seen during training")
    w_bin = Window.partitionBy("feature", "bin")
    scored = cpt.withColumn("marginal", F.avg("likelihood").over(w_bin)).where(F.col("class") == F.lit(outcome)) \
        .withColumn("posterior_score", F.round(F.col("likelihood") * F.col("marginal"), 6))
    w_best = Window.partitionBy("feature").orderBy(F.desc("posterior_score"), "bin")
    best = scored.withColumn("_r", F.row_number().over(w_best)).where(F.col("_r") == 1)
    top = best.orderBy(F.desc("posterior_score"), "position").limit(top_k)
    w = Window.orderBy(F.desc("posterior_score"), "position")  # at most top_k rows
    return top.select(F.row_number().over(w).alias("rank"), "feature",
                      F.col("bin_label").alias("feature_value_range"), "posterior_score",
                      F.round("likelihood", 6).alias("likelihood"), F.round("marginal", 6).alias("marginal"))


def why(rule_causes: DataFrame, bayes_hints: DataFrame | None) -> DataFrame:
    """R-07: importance-based causes (R-04) followed by Bayesian hints (R-06)
    as one table (source, rank, feature, detail, score)."""
    a = rule_causes.select(F.lit("rules").alias("source"), "rank", "feature",
                           F.col("direction").alias("detail"), F.col("importance").alias("score"))
    if bayes_hints is None:
        return a
    b = bayes_hints.select(F.lit("bayes").alias("source"), "rank", "feature",
                           F.col("feature_value_range").alias("detail"), F.col("posterior_score").alias("score"))
    return a.unionByName(b)
