"""ST-01 batch = stream, S-01..S-03/S-05/S-06 sources, N-01..N-03 prompt tables."""

import os
import tempfile
import uuid
from difflib import get_close_matches

from pyspark.sql import functions as F

from tabulon.operators import clean as cl
from tabulon.operators import prompts as pm
from tabulon.plans.catalog.common import orders_dirty
from tabulon.session import checkpoint_dir
from tabulon.sources import files as fs
from tabulon.streaming.rules_stream import stream_apply_rules

from conftest import SF_SMALL

RULES = {"drop": ["Unnamed: 0", "empty_col"], "rename": {"o_orderpriority": "priority"},
         "cast": {"o_orderkey": "str"}, "impute": {"o_totalprice": "median", "priority": "mode"},
         "target": "o_orderstatus"}


def _scratch(spark, tag):
    return os.path.join(checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")


def test_stream_equals_batch(spark):
    src = _scratch(spark, "src")
    od = orders_dirty(spark, SF_SMALL)
    od.repartition(3).write.parquet(src)
    streamed = stream_apply_rules(spark, src, RULES)
    batch = cl.apply_rules(spark.read.parquet(src), RULES)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_csv_sources(spark):
    path = _scratch(spark, "csv")
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    o.write.option("header", "true").option("sep", "|").csv(path)
    back = fs.read_csv_robust(spark, path)
    assert back.count() == o.count() and back.columns == o.columns
    assert fs.choose_delimiter("a;b\n1;2\n") == ";"


def test_encoding_of_the_whole_input(spark):
    pad = "plain,1\n" * 10_000   # beyond any head
    cases = [("a,b\n" + pad + "caf\u00e9,2\n", "utf-8"), ("a,b\n" + pad + "caf\u00e9 \u20ac,2\n", "cp1252"),
             ("a,b\nx,1\n\u00e9,2\n", "utf-16"), ("a,b\n" + "\u00e9" * 33_000 + ",2\n", "utf-8")]
    for text, enc in cases:
        path = _scratch(spark, "enc") + ".csv"
        with open(path, "wb") as fh:
            fh.write(text.encode(enc))
        got = fs.read_csv_robust(spark, path)
        assert got.columns == ["a", "b"]
        last = text.rstrip("\n").split("\n")[-1].split(",")[0]
        assert got.where(got["a"] == last).count() == 1


def test_repeated_headers(spark):
    path = _scratch(spark, "dup") + ".csv"
    with open(path, "w") as fh:
        fh.write("k,k,k_1,Age,age\n1,2,3,4,5\n")
    for read in (fs.read_csv, fs.read_csv_robust):
        got = read(spark, path)
        assert got.columns == ["k", "k_2", "k_1", "Age", "age_1"] and tuple(got.first()) == (1, 2, 3, 4, 5)


def test_json_flat_object(spark):
    d = tempfile.mkdtemp(dir=checkpoint_dir(spark))
    with open(os.path.join(d, "one.json"), "w") as fh:
        fh.write('{"a": 1, "b": {"c": "x", "d": {"e": 2.5}}}')
    df = fs.read_json_flat(spark, d)
    assert df.columns == ["a", "b.c", "b.d.e"] and df.count() == 1


def test_infer_types(spark):
    df = spark.createDataFrame([("2020-01-02", "x", 1, None), ("2021-03-04", "y", 2, None)],
                               "d string, t string, n int, e string")
    kinds = {r["column_name"]: r["kind"] for r in fs.infer_types(df).collect()}
    assert kinds == {"d": "datetime", "t": "categorical", "n": "numeric", "e": "datetime"}


def test_intent_order(spark):
    df = spark.createDataFrame([(1, "Why is the summary high?"), (2, "what drives l_tax"), (3, "predict if a=1"),
                                (4, "hello"), (5, "find the document")], "id int, text string")
    got = {r["id"]: (r["intent"], r["column_name"]) for r in pm.intent(df, "text", ["l_tax"]).collect()}
    assert got == {1: ("overview", None), 2: ("column", "l_tax"), 3: ("predict", None), 4: ("generic", None),
                   5: ("retrieval", None)}
    untrained = {r["id"]: r["intent"] for r in pm.intent(df, "text", ["l_tax"], trained=False).collect()}
    assert untrained[3] == "generic"


def test_facts_first_match(spark):
    df = spark.createDataFrame([(1, "predict if L_Quantity = 5 and l_tax is high, l_quantity: 7")], "id int, text string")
    got = {(r["feature"], r["value_text"], r["value_num"]) for r in pm.facts(df, ["id"], "text", ["l_quantity", "l_tax"]).collect()}
    assert got == {("l_quantity", "5", 5.0), ("l_tax", "high", None)}


def py_resolve(text, columns):
    import re
    lower = {c.lower(): c for c in columns}
    out, seen = [], set()
    for m in re.finditer(pm.WORD_PATTERN, text):
        w = m.group(1)
        if w.lower() in pm.COLUMN_STOP_WORDS or w.lower() in seen:
            continue
        if not ("_" in w or any(ch.isdigit() for ch in w) or (w.islower() and len(w) >= 4)):
            continue
        seen.add(w.lower())
        if w.lower() in lower:
            out.append((w, "exact", lower[w.lower()]))
            continue
        close = get_close_matches(w.lower(), list(lower), n=1, cutoff=0.72)
        out.append((w, "corrected", lower[close[0]]) if close else (w, "unresolved", None))
    return out


def test_resolve_columns_matches_python(spark):
    cols = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").columns
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "text")
    extra = spark.createDataFrame([(999_999, 0, "avg of l_extendedprise and L_TAX by l_returnflg, l_tax again 42abc")],
                                  "conv_id long, turn long, text string")
    rows = conv.unionByName(extra)
    got = {}
    for r in pm.resolve_columns(rows, ["conv_id", "turn"], "text", cols).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["position"], r["word"], r["status"], r["matched_column"]))
    for r in rows.collect():
        exp = py_resolve(r["text"], cols)
        assert [x[1:] for x in sorted(got.get((r["conv_id"], r["turn"]), []))] == exp
