"""Catalog entries for the text operators X-01..X-06 and S-04 (documents, benchmark, conversations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import text as tx
from tabulon.plans import answer
from tabulon.plans.catalog.common import t, with_sql

QUERIES = {}
SQL = {}

_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _trim(x):
    return _TRIM.format(x=x)


def _stop_sql():
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in tx.english_stop_words()) + "]"


def s04_split_text(spark, sf_dir):
    return tx.split_text(t(spark, sf_dir, "documents"), ["doc_id"], "text")


QUERIES["s04_split_text"] = s04_split_text
SQL["s04_split_text"] = f"""
WITH m AS (
  SELECT doc_id, regexp_replace(regexp_replace(text, '\\n\\s*\\n', chr(1), 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g') AS t
  FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: {_trim('x')}), lambda x: x <> '') AS parts
      FROM m),
q AS (SELECT doc_id, CASE WHEN len(parts) > 0 THEN parts ELSE ['{tx.EMPTY_TEXT_CHUNK}'] END AS parts FROM p),
u AS (SELECT doc_id, generate_subscripts(parts, 1) AS document_id, unnest(parts) AS content FROM q)
SELECT doc_id, document_id, content, length(content) AS char_count,
       CASE WHEN {_trim('content')} = '' THEN 0 ELSE len(regexp_split_to_array({_trim('content')}, '\\s+')) END
         AS word_count
FROM u"""


def x01_row_text(spark, sf_dir):
    return tx.row_text(t(spark, sf_dir, "customer"), ["c_custkey"])


QUERIES["x01_row_text"] = x01_row_text
SQL["x01_row_text"] = """
SELECT c_custkey, concat_ws(' | ', coalesce(c_name, ''), coalesce(c_mktsegment, '')) AS row_text FROM customer"""


def x04_counts(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", tx.char_count(F.col("text")).alias("char_count"),
                    tx.word_count(F.col("text")).alias("word_count"))


QUERIES["x04_counts"] = x04_counts
SQL["x04_counts"] = f"""
SELECT doc_id, length(text) AS char_count,
       CASE WHEN {_trim('text')} = '' THEN 0 ELSE len(regexp_split_to_array({_trim('text')}, '\\s+')) END AS word_count
FROM documents"""


def x05_truncate(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", tx.truncate(F.col("text"), 40).alias("preview"))


QUERIES["x05_truncate"] = x05_truncate
SQL["x05_truncate"] = """
SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS preview FROM documents"""


def x06_bullets(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tx.normalize_bullets(F.col("text")).alias("text"))


QUERIES["x06_bullets"] = x06_bullets
# line by line: a head and one "- item." line per part where " - " stands twice or more
SQL["x06_bullets"] = f"""
WITH l AS (
  SELECT conv_id, turn, line, place, {_trim('line')} AS s
  FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
               unnest(generate_series(1, len(string_split(text, chr(10))))) AS place FROM conversations)),
p AS (
  SELECT *, (length(s) - length(replace(s, ' - ', ''))) / 3 >= 2 AND NOT starts_with(s, '-') AS listed,
         regexp_split_to_array(s, '\\s+-\\s+') AS parts
  FROM l),
b AS (
  SELECT *, {_trim('parts[1]')} AS head,
         list_transform(list_filter(list_transform(parts[2:], lambda x: regexp_replace({_trim('x')}, '\\.+$', '')),
                                    lambda x: x <> ''), lambda x: '- ' || x || '.') AS items
  FROM p)
SELECT conv_id, turn, string_agg(
         CASE WHEN listed THEN array_to_string(
           list_concat(CASE WHEN head <> '' THEN [head, ''] ELSE CAST([] AS VARCHAR[]) END, items), chr(10))
         ELSE line END, chr(10) ORDER BY place) AS text
FROM b GROUP BY conv_id, turn"""


def _terms_sql(table, id_col, text_col):
    return f"""
tok_{table} AS (
  SELECT {id_col} AS id, list_filter(regexp_extract_all(lower({text_col}), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                     lambda w: NOT list_contains({_stop_sql()}, w)) AS w
  FROM {table}),
occ_{table} AS (
  SELECT id, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS term
  FROM tok_{table}),
tf_{table} AS (SELECT id, term, count(*) AS tf FROM occ_{table} GROUP BY 1, 2)"""


def _index_sql():
    return _terms_sql("documents", "doc_id", "text") + """,
vocab AS (
  SELECT term, df, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM (
    SELECT term, sum(tf) AS cf, count(*) AS df FROM tf_documents GROUP BY term ORDER BY cf DESC, term LIMIT 4000)),
raw AS (SELECT d.id, d.term, d.tf, d.tf * v.idf AS w FROM tf_documents d JOIN vocab v ON d.term = v.term),
postings AS (SELECT id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"""


def x02_tfidf(spark, sf_dir):
    postings, _ = tx.tfidf_index(t(spark, sf_dir, "documents"), "doc_id", "text", max_terms=4000)
    return postings.select("doc_id", "term", "tf", F.round("weight", 8).alias("weight"))


QUERIES["x02_tfidf"] = x02_tfidf
SQL["x02_tfidf"] = "WITH " + _index_sql().strip() + """
SELECT id AS doc_id, term, tf, round(weight, 8) AS weight FROM postings"""


def x02_vocabulary(spark, sf_dir):
    vocab = tx.vocabulary(t(spark, sf_dir, "documents"), "text", max_terms=4000)
    return vocab.select("term", "df", F.round("idf", 10).alias("idf"))


QUERIES["x02_vocabulary"] = x02_vocabulary
SQL["x02_vocabulary"] = "WITH " + _index_sql().strip() + """
SELECT term, df, round(idf, 10) AS idf FROM vocab"""


def x03_search(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    words = tx.words_of(docs, "doc_id", "text")
    hits = tx.search(t(spark, sf_dir, "benchmark"), "item_id", "text", docs, "doc_id", "text",
                     tx.vocabulary_of(words, max_terms=4000), top_k=4, words=words)
    return hits.select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id",
                       F.round("score", 8).alias("score"), "snippet")


QUERIES["x03_search"] = x03_search
SQL["x03_search"] = "WITH " + _index_sql().strip() + "," + _terms_sql("benchmark", "item_id", "text") + """,
qraw AS (SELECT q.id, q.term, q.tf * v.idf AS w FROM tf_benchmark q JOIN vocab v ON q.term = v.term),
qp AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM qraw),
scores AS (SELECT qp.id AS item_id, p.id AS doc_id, round(sum(qp.weight * p.weight), 10) AS score
           FROM qp JOIN postings p ON qp.term = p.term GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores)
SELECT item_id, rank, r.doc_id, round(score, 8) AS score, substr(d.text, 1, 420) AS snippet
FROM ranked r JOIN documents d ON d.doc_id = r.doc_id
WHERE rank <= 4 AND item_id IN (SELECT item_id FROM ranked WHERE rank = 1 AND score >= 0.04)"""


def x03_retrieval_prompts(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    asks = t(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("find "), F.col("text")).alias("prompt"))
    hits = answer.retrieve(asks, ["item_id"], "prompt", docs, "doc_id", "text",
                           tx.vocabulary(docs, "text", max_terms=4000))
    return hits.select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"),
                       "snippet")


QUERIES["x03_retrieval_prompts"] = x03_retrieval_prompts
SQL["x03_retrieval_prompts"] = "WITH asks AS (SELECT item_id, 'find ' || text AS prompt FROM benchmark),\n" \
    + _index_sql().strip() + "," + _terms_sql("asks", "item_id", "prompt") + """,
qraw AS (SELECT q.id, q.term, q.tf * v.idf AS w FROM tf_asks q JOIN vocab v ON q.term = v.term),
qp AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM qraw),
scores AS (SELECT qp.id AS item_id, p.id AS doc_id, round(sum(qp.weight * p.weight), 10) AS score
           FROM qp JOIN postings p ON qp.term = p.term GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores)
SELECT item_id, rank, r.doc_id, round(score, 6) AS score, substr(d.text, 1, 420) AS snippet
FROM ranked r JOIN documents d ON d.doc_id = r.doc_id
WHERE rank <= 4 AND item_id IN (SELECT item_id FROM ranked WHERE rank = 1 AND score >= 0.04)"""
