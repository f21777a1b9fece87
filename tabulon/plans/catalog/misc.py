"""Catalog entries for prompts (N-01..N-03), set operations (U-01..U-03),
file sources (S-01..S-03, S-06, S-10) and the streaming rule application (ST-01).

File-source queries first write a whole driver table with Spark into the
shared checkpoint folder and read it back, so their work grows with the table.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tabulon.operators import clean as cl
from tabulon.operators import prompts as pm
from tabulon.operators import setops as so
from tabulon.plans.catalog.common import ORDERS_DIRTY_SQL, orders_dirty, t, with_sql
from tabulon.session import checkpoint_dir
from tabulon.sources import files as fs
from tabulon.streaming.rules_stream import stream_apply_rules

QUERIES = {}
SQL = {}

LI_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scratch(spark, tag):
    return os.path.join(checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")


# --- prompts ------------------------------------------------------------------

def _lineitem_prompts(spark, sf_dir):
    """One prompt per lineitem row, naming real columns (plus a misspelt one)."""
    li = t(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("predict if l_quantity="), F.col("l_quantity").cast("string"),
                    F.lit(" and L_TAX is "), F.col("l_tax").cast("string"),
                    F.lit(", l_discont: "), F.col("l_discount").cast("string"),
                    F.when(F.col("l_linenumber") % 3 == 0, F.lit(" why high?")).otherwise(F.lit("")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", text.alias("text"))


_PROMPTS_SQL = """
prompts AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  'predict if l_quantity=' || CAST(l_quantity AS VARCHAR) || ' and L_TAX is ' || CAST(l_tax AS VARCHAR)
  || ', l_discont: ' || CAST(l_discount AS VARCHAR)
  || CASE WHEN l_linenumber % 3 = 0 THEN ' why high?' ELSE '' END AS text FROM lineitem)"""
PKEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
LINEITEM_COLUMNS = [*PKEYS, *LI_NUMERIC, "l_returnflag", "l_linestatus"]


def _intent_sql(source, keys):
    cases = []
    for name, words in pm.INTENT_WORDS:
        cond = " OR ".join(f"contains(lower(text), '{w}')" for w in words)
        cases.append(f"WHEN {cond} THEN '{name}'")
    cols = "[" + ", ".join(f"'{c}'" for c in LI_NUMERIC) + "]"
    return f"""
SELECT {keys}, text, intent, CASE WHEN intent = 'column' THEN m[1] END AS column_name FROM (
  SELECT *, CASE {' '.join(cases)} WHEN len(m) > 0 THEN 'column' ELSE 'generic' END AS intent FROM (
    SELECT {keys}, text, list_filter({cols}, lambda c: contains(lower(text), lower(c))) AS m FROM {source}))"""


def n01_intent_conversations(spark, sf_dir):
    return pm.intent(t(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", LI_NUMERIC)


QUERIES["n01_intent_conversations"] = n01_intent_conversations
SQL["n01_intent_conversations"] = _intent_sql("conversations", "conv_id, turn")


def n01_intent_prompts(spark, sf_dir):
    return pm.intent(_lineitem_prompts(spark, sf_dir), "text", LI_NUMERIC)


QUERIES["n01_intent_prompts"] = n01_intent_prompts
SQL["n01_intent_prompts"] = with_sql(_PROMPTS_SQL, body=_intent_sql("prompts", ", ".join(PKEYS)))


def n02_facts(spark, sf_dir):
    return pm.facts(_lineitem_prompts(spark, sf_dir), PKEYS, "text", LI_NUMERIC)


def _facts_sql():
    parts = []
    for f in LI_NUMERIC:
        v = f"regexp_extract(text, '(?i){f}\\s*(?:=|is|:)\\s*([A-Za-z0-9_.-]+)', 1)"
        parts.append(f"SELECT {', '.join(PKEYS)}, '{f}' AS feature, {v} AS value_text FROM prompts")
    return with_sql(_PROMPTS_SQL, body=f"""
SELECT *, TRY_CAST(value_text AS DOUBLE) AS value_num FROM ({' UNION ALL '.join(parts)}) WHERE value_text <> ''""")


QUERIES["n02_facts"] = n02_facts
SQL["n02_facts"] = _facts_sql()


def n03_resolve_columns(spark, sf_dir):
    return pm.resolve_columns(_lineitem_prompts(spark, sf_dir), PKEYS, "text", t(spark, sf_dir, "lineitem").columns)


QUERIES["n03_resolve_columns"] = n03_resolve_columns


def n03_resolve_conversations(spark, sf_dir):
    return pm.resolve_columns(t(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text",
                              t(spark, sf_dir, "documents").columns + t(spark, sf_dir, "conversations").columns)


QUERIES["n03_resolve_conversations"] = n03_resolve_conversations


def n03_exact_prompts(spark, sf_dir):
    """The names that prompts spell as they are; the fuzzy rest is beyond SQL."""
    return n03_resolve_columns(spark, sf_dir).where("status = 'exact'")


def _exact_sql(source, keys, names):
    quoted = lambda ws: ", ".join(f"'{w}'" for w in sorted(ws))
    return f"""
SELECT {keys}, CAST(position AS INTEGER) AS position, word, 'exact' AS status, word_lower AS matched_column FROM (
  SELECT {keys}, lower(word) AS word_lower, min(position) AS position, arg_min(word, position) AS word FROM (
    SELECT {keys}, unnest(w) AS word, unnest(range(len(w))) AS position FROM (
      SELECT {keys}, regexp_extract_all(text, '{pm.WORD_PATTERN}', 1) AS w FROM {source}))
  WHERE lower(word) NOT IN ({quoted(pm.COLUMN_STOP_WORDS)})
    AND (contains(word, '_') OR regexp_matches(word, '[0-9]') OR (word = lower(word) AND length(word) >= 4))
  GROUP BY {keys}, lower(word))
WHERE word_lower IN ({quoted(names)})"""


QUERIES["n03_exact_prompts"] = n03_exact_prompts
SQL["n03_exact_prompts"] = with_sql(_PROMPTS_SQL, body=_exact_sql("prompts", ", ".join(PKEYS), LINEITEM_COLUMNS))


def n02_predict_from_prompts(spark, sf_dir):
    """Prompt table -> intent -> facts -> rule deduction (the prompt-to-answer plan)."""
    from tabulon.operators.rules import rules_frame
    from tabulon.plans.answer import predict_from_prompts
    from tabulon.plans.catalog.reasoning import RULES
    return predict_from_prompts(_lineitem_prompts(spark, sf_dir), PKEYS, "text", rules_frame(spark, RULES),
                                LI_NUMERIC)


def _predict_condition():
    """SQL for intent = 'predict': no earlier keyword group matches, a predict word does."""
    groups = dict(pm.INTENT_WORDS)
    earlier = [w for name, words in pm.INTENT_WORDS if name != "predict" and
               [n for n, _ in pm.INTENT_WORDS].index(name) < [n for n, _ in pm.INTENT_WORDS].index("predict")
               for w in words]
    any_of = lambda ws: " OR ".join(f"contains(lower(text), '{w}')" for w in ws)
    return f"NOT ({any_of(earlier)}) AND ({any_of(groups['predict'])})"


def _predict_sql():
    from tabulon.plans.catalog.reasoning import RULES, _cond_sql
    cols = ", ".join(
        f"TRY_CAST(nullif(regexp_extract(text, '(?i){f}\\s*(?:=|is|:)\\s*([A-Za-z0-9_.-]+)', 1), '') AS DOUBLE) AS {f}"
        for f in LI_NUMERIC)
    parts = []
    for i, r in enumerate(RULES):
        if not r["conditions"]:
            continue
        sats, knowns = zip(*[_cond_sql(c) for c in r["conditions"]])
        parts.append(
            f"SELECT {', '.join(PKEYS)}, {i} AS rule_id, '{r['prediction']}' AS prediction, "
            f"CAST({r['confidence']} AS DOUBLE) AS confidence, round(({' + '.join(sats)}) / {float(len(sats))}, 4) "
            f"AS match_score, {' + '.join(knowns)} AS known_conditions, CAST({r['samples']} AS BIGINT) AS samples, "
            f"'{' AND '.join(r['conditions'])}' AS conditions "
            f"FROM facts")
    return with_sql(_PROMPTS_SQL, f"""
facts AS (SELECT {', '.join(PKEYS)}, {cols} FROM prompts
          WHERE {_predict_condition()})""",
                    body=f"""
SELECT * EXCLUDE (r) FROM (
  SELECT *, row_number() OVER (PARTITION BY {', '.join(PKEYS)} ORDER BY match_score DESC, confidence DESC, rule_id) AS r
  FROM ({' UNION ALL '.join(parts)}))
WHERE r = 1""")


QUERIES["n02_predict_from_prompts"] = n02_predict_from_prompts
SQL["n02_predict_from_prompts"] = _predict_sql()


def r07_why_from_prompts(spark, sf_dir):
    """'why' prompts -> observed return flag -> rule causes and Bayesian hints."""
    from tabulon.operators import bayes
    from tabulon.operators.rules import rules_frame
    from tabulon.plans.answer import why_from_prompts
    from tabulon.plans.catalog.reasoning import FEATURES, RULES, _importances
    cpt = bayes.fit(t(spark, sf_dir, "lineitem"), "l_returnflag", FEATURES)
    classes = sorted(r[0] for r in t(spark, sf_dir, "lineitem").select("l_returnflag").distinct().collect())
    return why_from_prompts(_lineitem_prompts(spark, sf_dir), PKEYS, "text", classes, rules_frame(spark, RULES),
                            _importances(spark, sf_dir), cpt, LI_NUMERIC)


def _why_from_prompts_sql():
    from tabulon.plans.catalog.reasoning import _IMP_SQL, _abduce_sql, _conditions_values, _cpt_sql, _explain_sql
    classes, keys = ("A", "N", "R"), ", ".join(PKEYS)
    one = [with_sql(_IMP_SQL, _conditions_values(), _abduce_sql(c), _cpt_sql(), _explain_sql(c, 3), body=f"""
SELECT '{c}' AS observed, 'rules' AS source, rank, feature, direction AS detail, importance AS score FROM causes
UNION ALL
SELECT '{c}', 'bayes', rank, feature, feature_value_range, posterior_score FROM hints""") for c in classes]
    named = " ".join(f"WHEN contains(lower(text), '{c.lower()}') THEN '{c}'" for c in classes)
    return with_sql(_PROMPTS_SQL, f"""
asks AS (SELECT {keys}, CASE {named} ELSE '{classes[-1]}' END AS observed
         FROM ({_intent_sql('prompts', keys)}) WHERE intent = 'why')""", f"""
explained AS ({' UNION ALL '.join(f'(SELECT * FROM ({sql}))' for sql in one)})""",
                    body="SELECT * FROM asks JOIN explained USING (observed)")


QUERIES["r07_why_from_prompts"] = r07_why_from_prompts
SQL["r07_why_from_prompts"] = _why_from_prompts_sql()


# --- set operations --------------------------------------------------------------

def u01_union_parts(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    li = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"),
                                             F.col("l_extendedprice").alias("o_totalprice"), "l_linenumber")
    return so.union_parts(o, li)


QUERIES["u01_union_parts"] = u01_union_parts
SQL["u01_union_parts"] = """
SELECT o_orderkey, o_totalprice, CAST(NULL AS INTEGER) AS l_linenumber FROM orders
UNION ALL SELECT l_orderkey, l_extendedprice, l_linenumber FROM lineitem"""


def u02_dropped_columns(spark, sf_dir):
    before = orders_dirty(spark, sf_dir)
    return so.dropped_columns(before, cl.clean(before, target="o_orderstatus"))


QUERIES["u02_dropped_columns"] = u02_dropped_columns
SQL["u02_dropped_columns"] = """
SELECT * FROM (VALUES ('ship_date_text', 4), ('constant_col', 5), ('empty_col', 6), ('Unnamed: 0', 7))
  v(column_name, position)"""


def u03_drop_duplicates(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return so.drop_duplicates(d, ["text"], order_by=["doc_id"]).select("doc_id", "lang", "source", "n_chars")


QUERIES["u03_drop_duplicates"] = u03_drop_duplicates
SQL["u03_drop_duplicates"] = """
SELECT doc_id, lang, source, n_chars FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)"""


# --- file sources ------------------------------------------------------------------

def s01_csv_roundtrip(spark, sf_dir):
    path = _scratch(spark, "csv")
    t(spark, sf_dir, "orders").write.option("header", "true").csv(path)
    return fs.read_csv(spark, path)


QUERIES["s01_csv_roundtrip"] = s01_csv_roundtrip
SQL["s01_csv_roundtrip"] = "SELECT * FROM orders"


def s02_robust_csv(spark, sf_dir):
    path = _scratch(spark, "csv1252")
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("€"), F.col("o_totalprice").cast("string"))
                                          .alias("price_text"), "o_orderpriority")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    o.write.option("header", "true").option("sep", ";").option("encoding", "windows-1252").csv(path)
    return fs.read_csv_robust(spark, path)


QUERIES["s02_robust_csv"] = s02_robust_csv
SQL["s02_robust_csv"] = """
SELECT o_orderkey, '€' || CAST(o_totalprice AS VARCHAR) AS price_text, o_orderpriority FROM orders"""


def s03_json_flat(spark, sf_dir):
    path = _scratch(spark, "json")
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value",
                                          F.from_json("props", "k long").alias("props"))
    e.write.json(path)
    return fs.read_json_flat(spark, path, multi_line=False)


QUERIES["s03_json_flat"] = s03_json_flat
SQL["s03_json_flat"] = """
SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events"""


def s06_infer_types(spark, sf_dir):
    return fs.infer_types(orders_dirty(spark, sf_dir))


QUERIES["s06_infer_types"] = s06_infer_types
SQL["s06_infer_types"] = with_sql(ORDERS_DIRTY_SQL, body="""
SELECT 'o_orderkey' AS column_name, 'numeric' AS kind, 0 AS position
UNION ALL SELECT 'price_text', CASE WHEN count(price_text) = count(try_strptime(price_text, '%Y-%m-%d'))
  THEN 'datetime' ELSE 'categorical' END, 1 FROM orders_dirty
UNION ALL SELECT 'o_orderpriority', CASE WHEN count(o_orderpriority) = count(try_strptime(o_orderpriority, '%Y-%m-%d'))
  THEN 'datetime' ELSE 'categorical' END, 2 FROM orders_dirty
UNION ALL SELECT 'o_orderstatus', CASE WHEN count(o_orderstatus) = count(try_strptime(trim(o_orderstatus), '%Y-%m-%d'))
  THEN 'datetime' ELSE 'categorical' END, 3 FROM orders_dirty
UNION ALL SELECT 'ship_date_text', CASE WHEN count(ship_date_text) = count(try_strptime(ship_date_text, '%Y-%m-%d'))
  THEN 'datetime' ELSE 'categorical' END, 4 FROM orders_dirty
UNION ALL SELECT 'constant_col', 'categorical', 5
UNION ALL SELECT 'empty_col', 'numeric', 6
UNION ALL SELECT 'Unnamed: 0', 'numeric', 7
UNION ALL SELECT 'o_totalprice', 'numeric', 8""")


def s10_preview_head(spark, sf_dir):
    return fs.preview(t(spark, sf_dir, "orders"), ["o_orderkey"], 30)


QUERIES["s10_preview_head"] = s10_preview_head
SQL["s10_preview_head"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 30"


def s10_preview_tail(spark, sf_dir):
    return fs.preview(t(spark, sf_dir, "orders"), ["o_orderkey"], 30, tail=True)


QUERIES["s10_preview_tail"] = s10_preview_tail
SQL["s10_preview_tail"] = "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 30"


# --- streaming --------------------------------------------------------------------

STREAM_RULES = {"drop": ["Unnamed: 0", "empty_col"], "rename": {"o_orderpriority": "priority"},
                "cast": {"o_orderkey": "str"}, "impute": {"o_totalprice": "median", "priority": "mode"},
                "target": "o_orderstatus"}


def st01_stream_rules(spark, sf_dir):
    src = _scratch(spark, "stream-src")
    orders_dirty(spark, sf_dir).repartition(4).write.parquet(src)
    return stream_apply_rules(spark, src, STREAM_RULES)


QUERIES["st01_stream_rules"] = st01_stream_rules
SQL["st01_stream_rules"] = with_sql(ORDERS_DIRTY_SQL, body="""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, price_text,
       coalesce(o_orderpriority, (SELECT o_orderpriority FROM orders_dirty WHERE o_orderpriority IS NOT NULL
                                  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority,
       o_orderstatus, ship_date_text, constant_col,
       coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_dirty)) AS o_totalprice
FROM orders_dirty""")
