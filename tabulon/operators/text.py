"""Text operators X-01..X-06 and the sentence/paragraph splitter S-04.

TF-IDF makes the words of every document once, as a checkpointed table; all
counting is done over whole Arrow batches with numbered words.  Only term
counts are shuffled, and the vocabulary is the ``max_terms`` most frequent terms
(a top-k, so its broadcast size is bounded).  Search reads an index of document
shards (postings by term, with the largest weight of every term); what a shard
can reach at best is compared with what a query is known to reach somewhere, so
shards are skipped, and every task keeps the top-k of its own shards.

Deviation: stop words are Spark ML's built-in English list, not the list of
the reference's library (which is not available here).
"""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import WHITESPACE, WS_CLASS, col, string_columns
from tabulon.functions.columns import strip_ws as _strip
from tabulon.session import bound_batches

# Token pattern (runs of 2+ letters, digits or underscores) and
# the splitter of S-04 (blank line, or whitespace after . ! ?).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
SPLIT_PATTERN = r"\n" + WS_CLASS + r"*\n|(?<=[.!?])" + WS_CLASS + "+"
EMPTY_TEXT_CHUNK = "No readable text was provided."

SNIPPET = 420          # characters of a match that search returns
FLUSH_TERMS = 200_000  # different terms a task counts before it hands them on
NAMED_TERMS = 50_000   # of them, those handed on together
SLICE_BYTES = 1 << 20  # words that a task numbers together, at most (a longer text goes alone)
SHARD_DOCS = 4096      # documents whose postings make one row of the search index, at most (and of one Arrow batch)
QUERY_BLOCK = 512      # queries scored together in a task
QUERIES_PER_PASS = 100_000   # queries broadcast together


@lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    """English stop words, shipped as a data file of the package (Spark ML's default list)."""
    data = pkgutil.get_data("tabulon", "functions/stopwords_en.txt")
    return tuple(data.decode("utf-8").split())


def strip_ws(c: Column) -> Column:
    return _strip(c)


# --- X-01 / X-04 / X-05 --------------------------------------------------------

def row_text(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
             out_col: str = "row_text") -> DataFrame:
    """X-01: text columns (null -> '') joined with ' | '; blank rows removed."""
    cols = list(columns or string_columns(df, exclude=tuple(keys)))
    text = F.concat_ws(" | ", *[F.coalesce(col(c), F.lit("")) for c in cols])
    return df.select(*[col(k) for k in keys], text.alias(out_col)).where(strip_ws(F.col(out_col)) != "")


def char_count(c: Column) -> Column:
    return F.length(c)


def _words_in_stripped(c: Column) -> Column:
    """Words of a stripped, non-empty text: whitespace mapped to spaces with
    ``translate`` and split on the single space (no regular expression)."""
    spaced = F.translate(c, WHITESPACE, " " * len(WHITESPACE))
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != ""))


def word_count(c: Column) -> Column:
    """X-04: whitespace-separated words (0 for blank text)."""
    return _words_in_stripped(strip_ws(c))


def truncate(c: Column, limit: int = 40) -> Column:
    """X-05: cut to ``limit`` characters and add an ellipsis when longer."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


# --- S-04 -----------------------------------------------------------------------

def split_text(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """S-04: split each text into chunks at blank lines and after sentence
    punctuation; chunks are stripped, empty ones dropped and numbered from 1.
    Output: keys..., document_id, content, char_count, word_count.

    Each stage is its own projection so the split/strip expressions are
    evaluated once per row (Spark does not inline an expensive expression
    that is referenced twice)."""
    k = [col(x) for x in keys]
    raw = df.select(*k, F.split(col(text_col), SPLIT_PATTERN, -1).alias("_raw"))
    kept = raw.select(*keys, F.filter(F.transform("_raw", strip_ws), lambda s: s != "").alias("_parts"))
    kept = kept.select(*keys, F.when(F.size("_parts") > 0, F.col("_parts"))
                       .otherwise(F.array(F.lit(EMPTY_TEXT_CHUNK))).alias("_parts"))
    # the outer variant skips the inferred "size > 0" filter, which would
    # re-evaluate the whole split expression; the array is never empty here
    ex = kept.select(*keys, F.posexplode_outer("_parts").alias("_pos", "content"))
    # chunks are non-empty and already stripped: the word count is a plain split
    return ex.select(*keys, (F.col("_pos") + 1).alias("document_id"), "content",
                     char_count(F.col("content")).alias("char_count"),
                     _words_in_stripped(F.col("content")).alias("word_count"))


# --- X-06 -------------------------------------------------------------------------

def normalize_bullets(c: Column) -> Column:
    """X-06: a line holding ' - ' at least twice (and not already a bullet)
    becomes its head, a blank line and one '- item.' line per part."""
    def per_line(line: Column) -> Column:
        s = strip_ws(line)
        n_sep = (F.length(s) - F.length(F.replace(s, F.lit(" - "), F.lit("")))) / 3
        parts = F.split(s, WS_CLASS + "+-" + WS_CLASS + "+", -1)
        head = strip_ws(parts[0])
        items = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))),
                            lambda p: F.regexp_replace(strip_ws(p), r"\.+$", ""))
        bullets = F.transform(F.filter(items, lambda p: p != ""), lambda p: F.concat(F.lit("- "), p, F.lit(".")))
        bullets = F.when(F.size(parts) > 1, bullets).otherwise(F.array().cast("array<string>"))
        expanded = F.concat(F.when(head != "", F.array(head, F.lit(""))).otherwise(F.array().cast("array<string>")),
                            bullets)
        return F.when((n_sep >= 2) & ~s.startswith("-"), expanded).otherwise(F.array(line))
    return F.array_join(F.flatten(F.transform(F.split(c, "\n", -1), per_line)), "\n")


# --- X-02 / X-03 ------------------------------------------------------------------

@lru_cache(maxsize=1)
def _word_finder():
    """text -> its lower-cased words without stop words; plain ASCII needs no Unicode classes."""
    everywhere, ascii_only = regex.compile(TOKEN_PATTERN).findall, re.compile(r"\w{2,}", re.ASCII).findall
    stop = frozenset(english_stop_words())

    def words(text: str | None) -> list[str]:
        low = (text or "").lower()
        return [w for w in (ascii_only if low.isascii() else everywhere)(low) if w not in stop]

    return words


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than tasks can run at a time is dealt out before heavy work per row
    (it is small: a split is at most ``maxPartitionBytes``); others stay where they are."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def words_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words, snippet), checkpointed: words joined by blanks (a word holds none), the text's start."""
    def run(batches):
        words = _word_finder()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([" ".join(words(t)) for t in texts], pa.string()),
                 pa.array([(t or "")[:SNIPPET] for t in texts], pa.string())], names=[id_col, "words", "snippet"])

    bound_batches(docs.sparkSession)   # for all that follows: the words, the postings, the index
    pairs = spread(docs.select(col(id_col), col(text_col).alias("_text")))
    schema = pairs.select(col(id_col)).schema.add("words", "string").add("snippet", "string")
    return pairs.mapInArrow(run, schema).checkpoint()


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``SLICE_BYTES`` (or of one row)."""
    def size(a, n):
        return batch.slice(a, n).nbytes

    a = 0
    while a < batch.num_rows:
        n = min(batch.num_rows - a, max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        while n > 1 and size(a, n) > SLICE_BYTES:
            n //= 2
        yield batch.slice(a, n)
        a += n


def _numbered(texts: list[str | None], number) -> tuple[np.ndarray, np.ndarray]:
    """The number of every word of all texts in a row, and the text of each; the words of one text exist at a time."""
    lengths = []

    def each():
        for t in texts:
            words = (t or "").split()
            lengths.append(len(words))
            yield from map(number, words)

    flat = np.fromiter(each(), np.int64)
    return flat, np.repeat(np.arange(len(lengths)), lengths)


class Numbers:
    """Words numbered as they come; a term of n words is their numbers as one (n) column."""

    def __init__(self):
        self.of: dict[str, int] = {}

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and the text of each."""
        of = self.of
        return _numbered(texts, lambda w: of.setdefault(w, len(of)))


def _grams(flat: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams [*, n] inside each text, and the text of each."""
    if len(flat) < n:
        return np.zeros((0, n), np.int64), np.zeros(0, np.int64)
    inside = text[n - 1:] == text[:len(text) - n + 1]
    return np.lib.stride_tricks.sliding_window_view(flat, n)[inside], text[:len(text) - n + 1][inside]


def _counted(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of the key columns (last key first in order) and how often each stands."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.diff(np.append(at, len(order)))


def vocabulary(docs: DataFrame, text_col: str, max_terms: int = 4000, ngram: int = 2) -> DataFrame:
    """The ``max_terms`` most frequent terms (corpus count desc, term asc): term, df, idf with
    idf = ln((1 + n) / (1 + df)) + 1.  Tasks count their own texts; only term counts are shuffled."""
    ids = docs.select(F.lit(0).alias("_id"), col(text_col).alias("_text"))
    return vocabulary_of(words_of(ids, "_id", "_text"), max_terms, ngram)


def vocabulary_of(words: DataFrame, max_terms: int = 4000, ngram: int = 2) -> DataFrame:
    """``vocabulary`` over the table that ``words_of`` gives."""
    def run(batches):
        numbers = Numbers()
        held = {n: [] for n in range(1, ngram + 1)}
        size = 0
        for part in (part for batch in batches for part in slices(batch)):
            flat, text = numbers.batch(part.column(0).to_pylist())
            for n, parts in held.items():
                grams, where = _grams(flat, text, n)
                (*term, _), tf = _counted(*grams.T, where)      # once per text
                (*term,), df, cf = _summed(term, np.ones(len(tf), np.int64), tf)
                parts.append((term, df, cf))
                size += len(df)
            if size > FLUSH_TERMS:
                held = {n: [_merged(parts)] for n, parts in held.items()}
                size = sum(len(parts[0][1]) for parts in held.values())
            if size > FLUSH_TERMS:
                yield from _named(held, numbers)
                numbers, held, size = Numbers(), {n: [] for n in held}, 0
        yield from _named(held, numbers)

    n_docs = words.count()
    stats = words.select("words").mapInArrow(run, "term string, cf long, df long") \
        .groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
    top = (stats.orderBy(F.desc("cf"), "term").limit(max_terms)
           .select("term", "df", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf")))
    # the vocabulary is a top-k: at most max_terms rows reach the driver
    return words.sparkSession.createDataFrame(top.collect(), "term string, df long, idf double")


def _summed(keys: list[np.ndarray], df: np.ndarray, cf: np.ndarray):
    """Both counts summed over equal keys."""
    order = np.lexsort(keys[::-1])
    found, n = _counted(*[k[order] for k in keys])
    at = np.cumsum(n) - n
    if not len(n):
        return found, df[:0], cf[:0]
    return found, np.add.reduceat(df[order], at), np.add.reduceat(cf[order], at)


def _merged(parts):
    term = [np.concatenate(c) for c in zip(*[t for t, _, _ in parts], strict=True)]
    return _summed(term, np.concatenate([d for _, d, _ in parts]), np.concatenate([c for _, _, c in parts]))


def _named(held, numbers: Numbers) -> Iterator[pa.RecordBatch]:
    """Counted terms by name."""
    names = list(numbers.of)
    for parts in held.values():
        if parts:
            term, df, cf = _merged(parts)
            for a in range(0, len(df), NAMED_TERMS):
                own = slice(a, a + NAMED_TERMS)
                text = [" ".join(names[i] for i in t) for t in zip(*[c[own].tolist() for c in term], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(cf[own], pa.int64()),
                                                  pa.array(df[own], pa.int64())], names=["term", "cf", "df"])


class Weigher:
    """The vocabulary as arrays: weighs the terms of whole batches of texts."""

    def __init__(self, terms: list[str], idf: list[float]):
        self.terms, self.idf = terms, np.array(idf)
        split = [t.split(" ") for t in terms]
        self.number = {w: i for i, w in enumerate(sorted({w for ws in split for w in ws}))}
        self.n = sorted({len(ws) for ws in split})
        # per length: the sorted codes of the terms, and their places in the vocabulary
        self.codes = {}
        for n in self.n:
            at = [i for i, ws in enumerate(split) if len(ws) == n]
            code = self._code(np.array([[self.number[w] for w in split[i]] for i in at], np.int64))
            order = np.argsort(code)
            self.codes[n] = code[order], np.array(at)[order]

    def _code(self, grams: np.ndarray) -> np.ndarray:
        """n-grams of vocabulary words as one number (some word outside: -1)."""
        code = np.zeros(len(grams), np.int64)
        for c in grams.T:
            code = code * (len(self.number) + 1) + c + 1
        return np.where((grams < 0).any(axis=1), -1, code)

    def weigh(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, tf, weight) of the vocabulary terms, by text and term; weights (tf * idf) are
        L2-normalised over the text."""
        get = self.number.get
        flat, text = _numbered(texts, lambda w: get(w, -1))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for n, (codes, places) in self.codes.items():
            grams, where = _grams(flat, text, n)
            code = self._code(grams)
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            known = codes[at] == code
            found.append((where[known], places[at[known]]))
        (text, term), tf = _counted(*[np.concatenate(c) for c in zip(*found, strict=True)])
        weight = tf * self.idf[term] if len(term) else np.zeros(0)
        norm = np.sqrt(np.bincount(text, weight * weight, minlength=len(texts)))
        return text, term, tf, weight / norm[text]


def _weigher(spark, vocab: DataFrame):
    rows = vocab.collect()   # at most max_terms
    return spark.sparkContext.broadcast(Weigher([r["term"] for r in rows], [r["idf"] for r in rows]))


def postings_of(docs: DataFrame, id_col: str, text_col: str, vocab: DataFrame, ngram: int = 2) -> DataFrame:
    """id, term, tf, weight (tf * idf, L2-normalised per document): a map over the documents, no shuffle."""
    return _postings(words_of(docs, id_col, text_col), id_col, vocab)


def _postings(words: DataFrame, id_col: str, vocab: DataFrame) -> DataFrame:
    shared = _weigher(words.sparkSession, vocab)

    def run(batches):
        weigher = shared.value
        names = pa.array(weigher.terms, pa.string())
        for part in (part for batch in batches for part in slices(batch)):
            text, term, tf, weight = weigher.weigh(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(text)), names.take(pa.array(term)), pa.array(tf, pa.int64()),
                 pa.array(weight)], names=[id_col, "term", "tf", "weight"])

    schema = words.select(col(id_col)).schema.add("term", "string").add("tf", "long").add("weight", "double")
    return words.select(col(id_col), "words").mapInArrow(run, schema)


def tfidf_index(docs: DataFrame, id_col: str, text_col: str, max_terms: int = 4000, ngram: int = 2):
    """X-02: (postings, vocabulary); see ``postings_of`` and ``vocabulary``.  Words are made once for both."""
    words = words_of(docs, id_col, text_col)
    vocab = vocabulary_of(words, max_terms, ngram)
    return _postings(words, id_col, vocab), vocab


def search_index(words: DataFrame, doc_id: str, vocab: DataFrame) -> DataFrame:
    """The documents of ``words_of`` as shards, checkpointed: per row up to ``SHARD_DOCS`` documents with ids and
    snippets, and their postings by term (numbers as bytes): term[k] owns doc and weight from
    start[k] on, and top[k] is its largest weight in the shard."""
    shared = _weigher(words.sparkSession, vocab)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, SHARD_DOCS):
                part = batch.slice(a, SHARD_DOCS)
                text, term, _, weight = shared.value.weigh(part.column(1).to_pylist())
                order = np.lexsort((text, term))
                text, term, weight = text[order].astype(np.int32), term[order], weight[order]
                (own,), n = _counted(term)
                start = np.cumsum(n) - n
                top = np.maximum.reduceat(weight, start) if len(n) else weight
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)),
                     pa.array([part.column(2).to_pylist()], pa.list_(pa.string())),
                     *[pa.array([v.tobytes()], pa.binary())
                       for v in (own.astype(np.int32), np.append(start, len(term)).astype(np.int64), text, weight, top)]],
                    names=["ids", "snippets", "term", "start", "doc", "weight", "top"])

    kind = words.schema[doc_id].dataType
    schema = T.StructType().add("ids", T.ArrayType(kind)).add("snippets", T.ArrayType(T.StringType()))
    for name in ("term", "start", "doc", "weight", "top"):
        schema = schema.add(name, "binary")
    return words.mapInArrow(run, schema).checkpoint()


def _numbers(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[c], dtype=d) for c, d in
                 (("term", np.int32), ("start", np.int64), ("doc", np.int32), ("weight", np.float64), ("top", np.float64)))


def _kth_weights(index: DataFrame, n_terms: int, k: int) -> np.ndarray:
    """The k-th largest weight of every term over all documents (0: fewer documents hold it)."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                term, start, _, weight, _ = _numbers(row)
                best = [np.sort(weight[a:b])[::-1][:k] for a, b in zip(start[:-1], start[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(term, [len(b) for b in best])),
                     pa.array(np.concatenate([*best, np.zeros(0)]))], names=["term", "weight"])

    w = Window.partitionBy("term").orderBy(F.desc("weight"))   # at most k rows of every shard
    top = index.select("term", "start", "doc", "weight", "top").mapInArrow(run, "term int, weight double") \
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k)
    out = np.zeros(n_terms)
    for r in top.select("term", "weight").collect():   # one row per vocabulary term
        out[r["term"]] = r["weight"]
    return out


def search(queries: DataFrame, query_id: str, query_text: str, docs: DataFrame, doc_id: str, text_col: str,
           vocab: DataFrame, top_k: int = 4, min_score: float = 0.04, score_digits: int = 10,
           query_block: int = QUERIES_PER_PASS, words: DataFrame | None = None) -> DataFrame:
    """X-03: cosine top-k documents per query with the first ``SNIPPET`` characters of each;
    queries whose best score is under ``min_score`` get no rows.

    Scores are rounded so that copies of a document tie exactly and fall back to document order
    (null ids last).  ``words`` is ``words_of`` of the documents if the caller has it already.
    Output: query_id, rank, doc_id, score, snippet.
    """
    spark = docs.sparkSession
    index = search_index(words_of(docs, doc_id, text_col) if words is None else words, doc_id, vocab)
    shared = _weigher(spark, vocab)
    known = _kth_weights(index, len(shared.value.terms), top_k)
    split, out = _word_finder(), None
    for block in _blocks(queries.select(col(query_id).alias("q"), col(query_text).alias("t")), query_block):
        query, term, _, weight = shared.value.weigh([" ".join(split(r["t"])) for r in block])
        part = _best(index, doc_id, spark.sparkContext.broadcast((len(block), query, term, weight, known)), top_k,
                     score_digits)
        names = spark.createDataFrame([(j, r["q"]) for j, r in enumerate(block)],
                                      T.StructType().add("_q", T.IntegerType()).add(query_id, queries.schema[query_id].dataType))
        part = part.join(F.broadcast(names), "_q")   # the block's ids
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.limit(0).select(F.lit(None).cast(queries.schema[query_id].dataType).alias(query_id),
                                    F.lit(0).alias("rank"), col(doc_id), F.lit(0.0).alias("score"),
                                    F.lit("").alias("snippet"))
    w = Window.partitionBy(query_id, "_q")   # at most top_k rows of every task
    ranked = out.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), col(doc_id).asc_nulls_last(), "snippet"))) \
        .withColumn("_best", F.max("score").over(w))
    return ranked.where((F.col("rank") <= top_k) & (F.col("_best") >= F.lit(min_score))) \
        .select(query_id, "rank", doc_id, "score", "snippet")


def _blocks(queries: DataFrame, size: int):
    """Queries in blocks, streamed to the driver."""
    block = []
    for r in queries.toLocalIterator():
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _reachable(term: np.ndarray, top: np.ndarray, query: np.ndarray, q_term: np.ndarray, q_weight: np.ndarray,
               n_queries: int) -> np.ndarray:
    """The most that any document of a shard can score with each query."""
    if not len(term):
        return np.zeros(n_queries)
    at = np.minimum(np.searchsorted(term, q_term), len(term) - 1)
    return np.bincount(query, np.where(term[at] == q_term, q_weight * top[at], 0.0), minlength=n_queries)


def _best(index: DataFrame, doc_id: str, shared, top_k: int, digits: int) -> DataFrame:
    """(_q, doc_id, score, snippet): the ``top_k`` documents of every task per query, scores above zero."""
    def run(batches):
        n_queries, query, q_term, q_weight, known = shared.value
        # k documents hold a term with at least its k-th weight: the k-th score is no lower
        least = np.zeros(n_queries)
        np.maximum.at(least, query, q_weight * known[q_term])
        best: list[list[tuple]] = [[] for _ in range(n_queries)]
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type.value_type
            for row in batch.to_pylist():
                term, start, doc, weight, top = _numbers(row)
                slack = 10.0 ** -(digits - 1)
                open_ = _reachable(term, top, query, q_term, q_weight, n_queries) >= np.maximum(least - slack, slack)
                asked = np.flatnonzero(open_)
                for a in range(0, len(asked), QUERY_BLOCK):
                    own = asked[a:a + QUERY_BLOCK]
                    place = np.full(n_queries, -1)
                    place[own] = np.arange(len(own))
                    mine = np.flatnonzero(place[query] >= 0)
                    mine = mine[np.argsort(q_term[mine], kind="stable")]
                    (of,), n = _counted(q_term[mine])
                    scores = np.zeros((len(row["ids"]), len(own)))
                    where = np.searchsorted(term, of)
                    first = np.cumsum(n) - n
                    for t, k, i, c in zip(of.tolist(), where.tolist(), first.tolist(), n.tolist(), strict=True):
                        if k < len(term) and term[k] == t:
                            rows, cols = doc[start[k]:start[k + 1]], mine[i:i + c]
                            scores[np.ix_(rows, place[query[cols]])] += np.outer(weight[start[k]:start[k + 1]],
                                                                                 q_weight[cols])
                    scores = np.round(scores, digits)
                    at, col_ = np.nonzero((scores >= (least[own] - slack)[None, :]) & (scores > 0))
                    for i, j in zip(at.tolist(), col_.tolist(), strict=True):
                        best[own[j]].append((float(scores[i, j]), row["ids"][i], row["snippets"][i]))
                    for j in np.unique(col_).tolist():
                        q = own[j]
                        best[q] = sorted(best[q], key=_place)[:top_k]
                        if len(best[q]) == top_k:
                            least[q] = max(least[q], best[q][-1][0])
        rows = [(j, *r) for j, kept in enumerate(best) for r in kept]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], kind),
                 pa.array([r[1] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.string())],
                names=["_q", doc_id, "score", "snippet"])

    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType().add("_q", T.IntegerType()).add(doc_id, kind).add("score", "double").add("snippet", "string")
    return index.mapInArrow(run, schema)


def _place(hit: tuple):
    """Ranking: score, then ids with null last, then the text."""
    return -hit[0], hit[1] is None, hit[1] if hit[1] is not None else 0, hit[2]
