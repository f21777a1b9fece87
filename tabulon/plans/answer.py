"""The "prompt -> answer" plan for a whole column of prompts.

prompts -> intent tag (N-01) -> facts (N-02) as one column per
feature -> rule deduction (R-03) for the ``predict`` prompts: projections all
the way, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import numeric_columns, parse_number
from tabulon.functions.ordering import exact_quantiles, long_values
from tabulon.operators import model as md
from tabulon.operators import profile as pr
from tabulon.operators import prompts as pm
from tabulon.operators import rules as rl
from tabulon.operators import text as tx


def facts_table(prompts: DataFrame, keys: Sequence[str], text_col: str, features: Sequence[str]) -> DataFrame:
    """One row per prompt, one column per feature (the first stated value as
    a number, null when absent or not numeric), as a projection."""
    return prompts.select(*keys, *[parse_number(pm.stated_value(F.col(text_col), f)).alias(f) for f in features])


def predict_from_prompts(prompts: DataFrame, keys: Sequence[str], text_col: str, rules: DataFrame,
                         features: Sequence[str], numeric_columns: Sequence[str] = ()) -> DataFrame:
    """Best rule (R-03, top 1) for every prompt tagged ``predict`` that states a fact
    (without one there is nothing to deduce from)."""
    tagged = pm.intent(prompts, text_col, numeric_columns or features)
    asks = tagged.where(F.col("intent") == "predict").select(*keys, text_col)
    facts = facts_table(asks, keys, text_col, features)
    facts = facts.where(F.coalesce(*[F.col(f"`{f}`") for f in features]).isNotNull())
    return rl.deduce(facts, rules, keys, top_k=1).drop("rank")


def why_from_prompts(prompts: DataFrame, keys: Sequence[str], text_col: str, classes: Sequence[str],
                     rules: DataFrame, importances: DataFrame, cpt: DataFrame, numeric_columns: Sequence[str] = (),
                     top_k: int = 5, bayes_k: int = 3) -> DataFrame:
    """Combined explanation (R-07) for every prompt tagged ``why``.

    The observed class is the first class named in the prompt, else the last
    class.  Explanations are computed once per class (a bounded set) and
    joined to the prompts by class, so the per-prompt work is a broadcast join.
    """
    from tabulon.operators import bayes

    tagged = pm.intent(prompts, text_col, numeric_columns)
    low = F.lower(F.col(text_col))
    observed = F.coalesce(*[F.when(F.contains(low, F.lit(c.lower())), F.lit(c)) for c in classes],
                          F.lit(classes[-1]))
    asks = tagged.where(F.col("intent") == "why").select(*keys, observed.alias("observed"))
    per_class = None
    for c in classes:  # one small table per class
        hints = bayes.explain(cpt, c, top_k=bayes_k) if cpt.where(F.col("class") == c).limit(1).count() else None
        part = bayes.why(rl.abduce(rules, importances, c, top_k=top_k), hints).withColumn("observed", F.lit(c))
        per_class = part if per_class is None else per_class.unionByName(part)
    return asks.join(F.broadcast(per_class), "observed")


def reports(df: DataFrame, importances: DataFrame | None = None, columns: Sequence[str] | None = None,
            missing_top: int = 10, drivers_top: int = 8) -> DataFrame:
    """What the data answers without a model run per prompt, as rows (intent, about, item, value):
    the overview (A-01), missing values (A-03), drivers (M-13, given importances) and the
    reading of every numeric column (A-06).  The table is as long as the schema is wide."""
    nums = list(columns or numeric_columns(df))
    over = pr.overview(df).select(F.inline(F.array(*[
        F.struct(F.lit("overview").alias("intent"), F.lit("").alias("about"), F.lit(c).alias("item"),
                 F.col(c).cast("double").alias("value")) for c in ("n_rows", "n_cols", "n_numeric", "n_categorical")])))
    gaps = pr.missing(df, top=missing_top).select(
        F.lit("missing").alias("intent"), F.lit("").alias("about"), F.col("column_name").alias("item"),
        F.col("n_missing").cast("double").alias("value"))
    out = over.unionByName(gaps)
    if importances is not None:
        out = out.unionByName(md.driver_ranking(importances, drivers_top).select(
            F.lit("drivers").alias("intent"), F.lit("").alias("about"), F.col("feature").alias("item"),
            F.col("score").alias("value")))
    if nums:
        medians = exact_quantiles(long_values(df, nums), [0.5]).select("column_name", F.col("quantile").alias("median"))
        stats = pr.per_column(df, nums, {"mean": lambda c: F.avg(c.cast("double")),
                                         "min": lambda c: F.min(c.cast("double")),
                                         "max": lambda c: F.max(c.cast("double"))}).join(medians, "column_name", "left")
        out = out.unionByName(stats.select(F.inline(F.array(*[
            F.struct(F.lit("column").alias("intent"), F.col("column_name").alias("about"), F.lit(m).alias("item"),
                     F.col(m).alias("value")) for m in ("mean", "median", "min", "max")]))))
    return out


def answers(prompts: DataFrame, keys: Sequence[str], text_col: str, report: DataFrame,
            numeric_names: Sequence[str] = ()) -> DataFrame:
    """Rows (keys..., intent, about, item, value) for every prompt that ``report`` answers:
    overview, missing, drivers, and the column a prompt names."""
    tagged = pm.intent(prompts, text_col, numeric_names).select(
        *keys, "intent", F.coalesce("column_name", F.lit("")).alias("about"))
    # a report has a few rows per column of the table: bounded by the schema
    return tagged.join(F.broadcast(report), ["intent", "about"]).select(*keys, "intent", "about", "item", "value")


def retrieve(prompts: DataFrame, keys: Sequence[str], text_col: str, docs: DataFrame, doc_id: str, doc_text: str,
             vocab: DataFrame, top_k: int = 4) -> DataFrame:
    """X-03 for the prompts tagged ``retrieval``: matches with rank, score and snippet."""
    asks = pm.intent(prompts, text_col).where(F.col("intent") == "retrieval").select(*keys, text_col)
    asks = asks.withColumn("_ask", F.to_json(F.struct(*keys)))
    hits = tx.search(asks, "_ask", text_col, docs, doc_id, doc_text, vocab, top_k=top_k)
    return hits.join(asks.select("_ask", *keys), "_ask").drop("_ask")
