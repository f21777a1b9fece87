"""Cells between a forest's cuts: what a tree sees of a row."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import col


def places(df: DataFrame, features: Sequence[str], grid: list[list[float]]) -> list[Column]:
    """Per feature how many of its cuts lie under a row's value: a missing value goes right at every split."""
    def place(v, cuts):
        if not cuts:
            return F.lit(0)
        x = F.coalesce(v.cast("double"), F.lit(float("nan")))
        # halving: the cuts of a feature are at most the forest's bins
        lo, hi = 0, len(cuts)

        def between(lo, hi):
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(x <= F.lit(cuts[mid]), between(lo, mid)).otherwise(between(mid + 1, hi))
        return between(lo, hi)
    return [place(col(f), cuts) for f, cuts in zip(features, grid, strict=True)]


def cell_of(at: Sequence[Column], sizes: Sequence[int]) -> Column:
    """The number of the cell with these places."""
    strides = [math.prod(sizes[i + 1:]) for i in range(len(sizes))]
    return sum((p.cast("long") * F.lit(s).cast("long") for p, s in zip(at, strides, strict=True)),
               F.lit(0).cast("long"))


def with_cell(df: DataFrame, features: Sequence[str], grid: list[list[float]], name: str) -> DataFrame:
    """``df`` with the number of each row's cell as ``name``; by search, where ``places`` compares in an expression
    that grows with the cuts."""
    cut = [i for i in range(len(grid)) if grid[i]]
    there = set(df.columns)
    own = "_at"          # a prefix that no column has
    while any(c.startswith(own) for c in there):
        own = "_" + own
    values = df.withColumns({f"{own}v{i}": F.coalesce(col(features[i]).cast("double"), F.lit(math.nan)) for i in cut})
    if cut:   # what equals a cut lies under it; not-a-number gets a place of its own beyond the last
        splits = [[-math.inf, *np.nextafter(np.array(grid[i]), math.inf).tolist(), math.inf] for i in cut]
        values = Bucketizer(splitsArray=splits, inputCols=[f"{own}v{i}" for i in cut],
                            outputCols=[f"{own}{i}" for i in cut], handleInvalid="keep").transform(values)
    at = [F.least(F.col(f"{own}{i}"), F.lit(float(len(c)))) if c else F.lit(0) for i, c in enumerate(grid)]
    return values.withColumn(name, cell_of(at, [len(c) + 1 for c in grid])) \
        .drop(*[f"{own}v{i}" for i in cut], *[f"{own}{i}" for i in cut])
