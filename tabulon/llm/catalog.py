"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import (
    bagminhash, decontam, itq, langid, merkle, mixing, negatives, quality, secrets, sharding, substrings, toxicity, urls,
)
from tabulon.llm.scratch import prepare
from tabulon.session import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


def op2_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classify(table(spark, sf_dir, "documents"))


def op5_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    law, grown = sharding.grown()
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op7_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_itq_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.link_vectors(table(spark, sf_dir, "embeddings"))


def op10_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_midstate_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


def op12_l2ap_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_debruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_url_language_models, op3_secret_ownership, op4_bagminhash, op5_kneser_ney_toxicity,
    op6_sampled_splitters, op7_zstd_quality, op8_suffix_automaton, op9_itq_embeddings, op10_ecoc_language,
    op11_midstate_merkle, op12_l2ap_negatives, op13_debruijn_substrings)}
SQL: dict[str, str] = {}

# words as positions, windows as joined words; a shorter item is one window of its own length
SQL["op8_suffix_automaton"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 10) AS k FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k,
         array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw USING (k, win)),
h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM m) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

# crc32 bit by bit over the digits of doc_id; the trees level by level; every leaf folded level by level
# (joins by lang: the tables hold no null lang; tests/llm cover it)
SQL["op11_midstate_merkle"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, n_chars,
         list_reduce(flatten([[4294967295], flatten(list_transform(generate_series(1, len(CAST(doc_id AS VARCHAR))),
             lambda i: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT),
                        -1, -1, -1, -1, -1, -1, -1, -1]))]),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
                             ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END) AS crc,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
           || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body
  FROM documents),
leaf AS (
  SELECT row, doc_id, lang,
         sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || body) AS h,
         CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS forged,
         sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-')
                || body) AS h_forged
  FROM d),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS place FROM leaf),
tree(lang, level, nodes) AS (
  SELECT lang, 0, list(h ORDER BY place) FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(generate_series(0, (len(nodes) - 1) // 2),
                                         lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM tree WHERE len(nodes) > 1),
subroot AS (
  SELECT lang, nodes[1] AS h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, level AS height
  FROM tree WHERE len(nodes) = 1),
crown(level, nodes) AS (
  SELECT 0, list(h ORDER BY place) FROM subroot
  UNION ALL
  SELECT level + 1, list_transform(generate_series(0, (len(nodes) - 1) // 2),
                                   lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM crown WHERE len(nodes) > 1),
runs AS (   -- all levels above the leaves, the crown's after the lang's
  SELECT t.lang, t.level, t.nodes, false AS upper FROM tree t WHERE len(t.nodes) > 1
  UNION ALL
  SELECT s.lang, s.height + c.level, c.nodes, true FROM subroot s, crown c WHERE len(c.nodes) > 1),
fold(row, lang, level, place, cur, proof) AS (
  SELECT row, lang, 0, CASE WHEN s.height = 0 THEN s.place ELSE p.place END,
         CASE WHEN forged = 1 THEN h_forged ELSE p.h END, ''
  FROM placed p JOIN subroot s USING (lang)
  WHERE lang IS NOT NULL
  UNION ALL
  SELECT f.row, f.lang, f.level + 1,
         CASE WHEN NOT r.upper AND f.level + 1 = s.height THEN s.place ELSE f.place // 2 END,
         CASE WHEN f.place % 2 = 0 THEN sha256(f.cur || coalesce(r.nodes[f.place + 2], ''))
              ELSE sha256(r.nodes[f.place] || f.cur) END,
         f.proof || CASE WHEN f.place % 2 = 0 THEN coalesce(r.nodes[f.place + 2], '') ELSE r.nodes[f.place] END
  FROM fold f JOIN runs r ON r.lang = f.lang AND r.level = f.level JOIN subroot s ON s.lang = f.lang),
done AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY row ORDER BY level DESC) = 1),
top AS (SELECT nodes[1] AS root FROM crown WHERE len(nodes) = 1)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, top.root, sha256(done.proof) AS proof_sha256,
       done.cur AS folded_root, done.cur = top.root AS verified
FROM placed p JOIN subroot s USING (lang) JOIN done USING (row), top
"""

# every anchor against every row; products of whole numbers are exact in doubles here
SQL["op12_l2ap_negatives"] = """
WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
h AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 3
"""

# every window as its words; a word is removed when a window over it starts in an earlier document
SQL["op13_debruijn_substrings"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
source AS (SELECT s, min(doc_id) AS first_id FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p
  FROM win JOIN source USING (s) WHERE first_id < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, coalesce(removed.n, 0) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
