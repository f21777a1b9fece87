"""First values of every column and the closest column name, against brute force."""

import random
from difflib import get_close_matches

import pytest
from pyspark.sql import functions as F

from tabulon.functions import ordering
from tabulon.operators import clean as cl
from tabulon.operators import profile as pr
from tabulon.operators import prompts as pm


def test_closest_name_is_the_brute_force_one():
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abcd_e1") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    find = pm.ClosestName(names, 0.72, remembered=50)
    words = ["".join(rng.choice("abcd_e1z") for _ in range(rng.randint(3, 10))) for _ in range(400)] + names[:40]
    got = [find(w) for w in words]
    assert got == [(get_close_matches(w, names, n=1, cutoff=0.72) or [None])[0] for w in words]
    assert None in got and len(set(got)) > 50
    assert pm.ClosestName([], 0.72)("word") is None


def test_resolution_without_names_and_with_a_hot_word(spark):
    rows = spark.createDataFrame([(i, "price of the hot_word") for i in range(500)] + [(500, None), (501, "")],
                                 "id long, text string")
    assert pm.resolve_columns(rows, ["id"], "text", []).where("status <> 'unresolved'").count() == 0
    got = pm.resolve_columns(rows, ["id"], "text", ["Price", "hot_wort"])
    assert {(r["word"], r["status"], r["matched_column"], r["n"]) for r in
            got.groupBy("word", "status", "matched_column").agg(F.count("*").alias("n")).collect()} == {
        ("price", "exact", "Price", 500), ("hot_word", "corrected", "hot_wort", 500)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("k", [1, 3])
def test_first_values_are_the_brute_force_ones(spark, k):
    rng = random.Random(5)
    rows = [(None if i == 7 else i, rng.random() < 0.5, i % 2 or None, None if rng.random() < 0.95 else f"v{i}", None)
            for i in range(1000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "`a.key` long, flag boolean, half int, rare string, empty double").repartition(7)
    order = ["flag", "a.key"]
    got = {}
    for r in pr.first_values(df, order, k).collect():
        got.setdefault(r["column_name"], []).append((r["rank"], r["value"]))
    ordered = sorted(rows, key=lambda r: (r[1], r[0] is not None, r[0] or 0))
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    for i, c in enumerate(df.columns):
        first = [text(r[i]) for r in ordered if r[i] is not None][:k]
        assert sorted(got.get(c, [])) == list(enumerate(first, start=1))
    assert "empty" not in got


def test_first_values_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k long, v string")
    assert pr.first_values(df, ["k"], 3).count() == 0
    meta = {r["column_name"]: r["examples"] for r in pr.column_metadata(df, ["k"]).collect()}
    assert meta == {"k": None, "v": None}


def test_value_maps_are_bounded_together(spark, monkeypatch):
    assert cl._within_limit({"a": 50, "b": 10, "c": 90}, 100) == {"a", "b"}
    assert cl._within_limit({}, 100) == set() and cl._within_limit({"a": 1000}, 100) == set()
    rng = random.Random(9)
    rows = [(i, *(None if rng.random() < 0.2 else float(rng.randint(0, 40 * (c + 1))) for c in range(4)),
             *(None if rng.random() < 0.2 else f"t{rng.randint(0, 30 * (c + 1))}" for c in range(2))) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, s string, t string")
    want = sorted(map(tuple, cl.clean(df, target="a").collect()), key=repr)
    monkeypatch.setattr(cl, "IN_MEMORY_LIMIT", 120)   # some columns fit together, none fits with all others
    assert sorted(map(tuple, cl.clean(df, target="a").collect()), key=repr) == want


def test_ranks_are_long_on_both_paths(spark):
    df = spark.range(50).withColumn("g", F.col("id") % 2)
    for limit in (1, 1000):
        ranked = ordering.rank_within(df, "g", F.col("id"), window_limit=limit)
        assert dict(ranked.dtypes)["rank"] == "bigint" and ranked.agg(F.max("rank")).first()[0] == 25
