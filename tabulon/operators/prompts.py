"""Prompt-table operators N-01..N-03 (re-aimed: one prompt -> a column of prompts).

Intent tagging and fact extraction are built-in string expressions over the
prompt column.  Column-name resolution settles exact names by lookup; only the
other words reach a pandas UDF for the fuzzy string ratio, which length and
letter counts spare most column names (a list bounded by the schema width).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import col, parse_number

# Intent keywords, tested in this order on the lower-cased prompt.
INTENT_WORDS = [
    ("retrieval", ["document", "text", "say", "mention", "find", "what is"]),
    ("overview", ["overview", "summary", "describe", "profile", "dataset"]),
    ("missing", ["missing", "null", "clean", "quality"]),
    ("drivers", ["important", "importance", "driver", "drivers", "influence"]),
    ("why", ["why", "cause", "explain"]),
    ("predict", ["predict", "classify", "if "]),
]
MODEL_INTENTS = {"why", "predict"}

# Words never treated as column references (N-03).
COLUMN_STOP_WORDS = {
    "the", "and", "for", "with", "predict", "forecast", "based",
    "will", "this", "that", "have", "are", "has", "can", "all",
    "next", "month", "months", "year", "years", "data", "values",
    "value", "column", "columns", "using", "over", "time", "series",
    "show", "tell", "about", "give", "find", "how", "what", "which",
    "would", "could", "should", "feature", "features", "row", "rows",
    "trends", "trend", "average", "median", "mean", "max", "min",
    "sum", "total", "count", "based", "outcome", "regression",
    "classify", "classification", "from", "into",
}
WORD_PATTERN = r"\b([A-Za-z_][A-Za-z0-9_]{2,})\b"


def _contains_any(low: Column, words: Sequence[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(low, F.lit(w))
    return cond


def intent(df: DataFrame, text_col: str, numeric_columns: Sequence[str] = (), trained: bool = True,
           retrieval_available: bool = True) -> DataFrame:
    """N-01: add ``intent`` (first matching keyword group, else ``column`` when
    a numeric column name is mentioned, else ``generic``) and ``column_name``."""
    low = F.lower(col(text_col))
    names = F.array(*[F.lit(c) for c in numeric_columns]) if numeric_columns else F.array().cast("array<string>")
    mentioned = F.filter(names, lambda c: F.contains(low, F.lower(c)))
    expr = None
    for name, words in INTENT_WORDS:
        if name in MODEL_INTENTS and not trained:
            continue
        if name == "retrieval" and not retrieval_available:
            continue
        cond = _contains_any(low, words)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = expr.when(F.size(mentioned) > 0, F.lit("column")).otherwise(F.lit("generic"))
    return df.withColumn("intent", expr).withColumn(
        "column_name", F.when(F.col("intent") == "column", mentioned[0]))


def stated_value(text: Column, feature: str) -> Column:
    """The value a text gives for ``feature`` (first match), or null."""
    v = F.regexp_extract(text, r"(?i)" + re.escape(feature) + r"\s*(?:=|is|:)\s*([A-Za-z0-9_.-]+)", 1)
    return F.when(v != "", v)


def facts(df: DataFrame, keys: Sequence[str], text_col: str, features: Sequence[str]) -> DataFrame:
    """N-02: ``feature (=|is|:) value`` per feature, first match, case-insensitive.

    Output: keys..., feature, value_text, value_num (null when not a number).
    """
    structs = [F.struct(F.lit(f).alias("feature"), stated_value(col(text_col), f).alias("value_text"))
               for f in features]
    ex = df.select(*[col(k) for k in keys], F.explode_outer(F.array(*structs)).alias("_f"))
    return ex.select(*keys, "_f.feature", "_f.value_text").where(F.col("value_text").isNotNull()) \
        .withColumn("value_num", parse_number(F.col("value_text")))


def _looks_like_column(word: Column) -> Column:
    return (F.contains(word, F.lit("_")) | F.regexp_like(word, F.lit("[0-9]"))
            | ((word == F.lower(word)) & (F.length(word) >= 4)))


class ClosestName:
    """The name most similar to a word (ratio of matching blocks, at least ``cutoff``), ties to the
    last name in order.

    The ratio cannot exceed twice the common letters over both lengths.  These bounds come for
    all names at once from a matrix of letter counts; the exact ratio is taken from the highest
    bound down, until no bound reaches the best ratio found.
    """

    def __init__(self, names: Sequence[str], cutoff: float, remembered: int = 100_000):
        self.names, self.cutoff, self.remembered = sorted(names), cutoff, remembered
        self.letters = {ch: i for i, ch in enumerate(sorted(set("".join(self.names))))}
        self.lengths = np.array([len(n) for n in self.names], dtype=np.int64)
        self.counts = np.array([self._count(n) for n in self.names], dtype=np.int64) \
            .reshape(len(self.names), len(self.letters))
        self.known: dict[str, str | None] = {}

    def _count(self, word: str) -> np.ndarray:
        found = [self.letters[ch] for ch in word if ch in self.letters]
        return np.bincount(found, minlength=len(self.letters)) if found else np.zeros(len(self.letters), dtype=np.int64)

    def bounds(self, word: str) -> np.ndarray:
        """An upper bound of the ratio of every name."""
        common = np.minimum(self.counts, self._count(word)).sum(axis=1)
        return 2.0 * common / np.maximum(self.lengths + len(word), 1)

    def _search(self, word: str) -> str | None:
        if not self.names:
            return None
        bound = self.bounds(word)
        match = SequenceMatcher()
        match.set_seq2(word)
        best = (self.cutoff, "")
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < best[0]:
                break
            match.set_seq1(self.names[i])
            best = max(best, (match.ratio(), self.names[i]))
        return best[1] or None

    def __call__(self, word: str) -> str | None:
        if word not in self.known:
            if len(self.known) >= self.remembered:
                self.known.clear()
            self.known[word] = self._search(word)
        return self.known[word]


def resolve_columns(df: DataFrame, keys: Sequence[str], text_col: str, columns: Sequence[str],
                    cutoff: float = 0.72) -> DataFrame:
    """N-03: column-like words of each prompt -> (keys..., position, word,
    status, matched_column) with status exact / corrected / unresolved.

    Words: ``[A-Za-z_][A-Za-z0-9_]{2,}``, not a stop word, containing ``_`` or
    a digit or being lower case with 4+ letters; first occurrence per prompt
    (case-insensitive).  Exact names are matched case-insensitively; other
    words take the closest column with similarity >= ``cutoff``.  The one
    shuffle is by prompt; a frequent word meets nothing but its own row.
    """
    words = df.select(*[col(k) for k in keys],
                      F.posexplode_outer(F.regexp_extract_all(col(text_col), F.lit(WORD_PATTERN), 1))
                      .alias("position", "word")).where(F.col("word").isNotNull())
    stop = F.array(*[F.lit(w) for w in sorted(COLUMN_STOP_WORDS)])
    words = words.where(~F.array_contains(stop, F.lower("word")) & _looks_like_column(F.col("word")))
    first = words.groupBy(*[col(k) for k in keys], F.lower("word").alias("word_lower")).agg(
        F.min_by(F.struct("position", "word"), "position").alias("_w"))
    lowered = {c.lower(): c for c in columns}
    name_map = F.create_map(*[x for k, v in lowered.items() for x in (F.lit(k), F.lit(v))]) if lowered else \
        F.lit(None).cast("map<string,string>")

    @F.pandas_udf("string")
    def closest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = ClosestName(list(lowered), cutoff)
        for batch in batches:
            # words that are names themselves come as null
            yield batch.map(lambda w: None if w is None else find(w)).astype(object)

    named = first.select(*[col(k) for k in keys], "_w.position", "_w.word", "word_lower",
                         F.try_element_at(name_map, F.col("word_lower")).alias("_name"))
    found = named.withColumn("_close", closest(F.when(F.col("_name").isNull(), F.col("word_lower"))))
    status = (F.when(F.col("_name").isNotNull(), F.lit("exact"))
              .when(F.col("_close").isNotNull(), F.lit("corrected")).otherwise(F.lit("unresolved")))
    target = F.coalesce(F.col("_name"), F.try_element_at(name_map, F.col("_close")))
    return found.select(*[col(k) for k in keys], "position", "word", status.alias("status"),
                        target.alias("matched_column"))
