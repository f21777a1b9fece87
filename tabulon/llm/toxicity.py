"""Operator 5 — toxicity by class-conditional Kneser-Ney word models.

Two bigram models, of toxic and of ordinary text, are counted in one pass over
all labelled rows, in a Spark table keyed by the n-gram.  As in Kneser-Ney
smoothing the pair (left neighbour, word) counts as often as it occurs, less a
discount, and backs off to the word's continuation counts: in how many
different contexts it stands, not how often copies repeat it.  These distinct
left neighbours are counted exactly, for words and for their stems (first 4, 5,
6 bytes); a rare word backs off to its stems and these to the class shares.
Each step adds ``SHARED`` backoff counts, split between the classes as the
shorter expression is split (for a pair: as word and left neighbour are,
taken as independent).

A text is scored by windows of a few words: the length-normalised difference
of the two log-likelihoods, each word given the one before it, of the most
toxic window, so a long text does not dilute what it says.  A logistic fit on
labelled rows kept out of the counts turns the difference into a score.

The model is broadcast in pieces.  Up to ``BROADCAST_NGRAMS`` rows a task holds
them all; of a larger one it loads a piece at a time and looks up there what
its texts ask for, about ``STREAMED_BYTES`` of them together, so that no n-gram
of the texts is shuffled; one beyond ``STREAMED_NGRAMS`` is joined to them.
The results are the same.
Lookups go by 64-bit hashes of the n-grams, counts by the n-grams themselves.

Defined results: null and empty texts have difference 0; rows without a label
teach nothing, without any labels every text scores alike; repeated rows are
scored alike; long texts are used whole; a text's first word has the empty word
before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.calibration import fit_logistic, logistic
from tabulon.llm.langid import held_out
from tabulon.llm.scratch import broadcast_if, prepare, utf8_values, words_of, written

STEMS = (4, 5, 6)
SHARED = 10.0         # backoff counts
DISCOUNT = 0.75
#: Of pairs, by class (toxic, ordinary).  A pair seen once in ordinary text, by far the larger class and
#: mostly such pairs, keeps nothing; one that no class keeps anything of is not stored.
PAIR_DISCOUNT = (0.75, 1.0)
WINDOW = 3            # words
CHUNK_WORDS = 2_000_000   # counted together
SCORED_WORDS = 300_000    # scored together: arrays and keys of a whole batch took too much beside the model
BROADCAST_NGRAMS = 16_000_000   # of 10 to 16 bytes
STREAMED_NGRAMS = 1_000_000_000   # on the disks of the executors
STREAMED_BYTES = 16 << 20       # of text for which the pieces are loaded once; some 11 bytes in a task for each
PIECE = 2_000_000     # of them reach the driver at a time
CALIBRATION = 5       # one learnable row in so many calibrates, the others are counted
THRESHOLD = 0.7


class _Ids(dict):
    """Dense numbers for words in the order of their first appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _chunks(texts, most: int = CHUNK_WORDS):
    """Runs of texts with about ``most`` words: (index of the first text, words as numbers
    per text, the words by number).  Number 0 is the empty word."""
    ids, rows, first, size = _Ids({b"": 0}), [], 0, 0
    for raw in texts:
        words = words_of(raw)
        rows.append(np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words)))
        size += len(words)
        if size >= most:
            yield first, rows, list(ids)
            first += len(rows)
            ids, rows, size = _Ids({b"": 0}), [], 0
    if rows:
        yield first, rows, list(ids)


def _pairs(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every word of the texts as (its text, the number of its left neighbour, its number)."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    word = np.concatenate(rows)
    left = np.concatenate(([0], word[:-1])) * np.concatenate(([False], owner[1:] == owner[:-1]))
    return owner, left, word


def count_pairs(labelled: DataFrame, label_col: str, text_col: str) -> DataFrame:
    """(s, r, l, n_1, n_0): how often the word s + r, s its first ``STEMS[0]`` bytes, follows l,
    by class; with null s and r, how often any word follows l.

    Rows are dealt by (s, l): all words that share a stem and a left neighbour meet, so every
    count below needs this one shuffle.  A task combines its rows in runs of texts first.
    """
    names = ["s", "r", "l", "n_1", "n_0"]

    def run(batches):
        for batch in batches:
            label = np.array(batch.column(1).to_pylist(), dtype=np.int64)
            for first, rows, words in _chunks(utf8_values(batch.column(0))):
                owner, left, word = _pairs(rows)
                toxic = label[first + owner]
                # by stem, so that neighbouring rows of the shuffle are alike
                order = sorted(range(len(words)), key=words.__getitem__)
                place = np.empty(len(words), dtype=np.int64)
                place[order] = np.arange(len(words))
                words = [words[i] for i in order]
                seen, n = np.unique((place[word] << 33) | (place[left] << 1) | toxic, return_counts=True)
                ends, m = np.unique((place[left] << 1) | toxic, return_counts=True)
                stems, rests, whole = (pa.array([v[p] for v in words], pa.binary()) for p in
                                       (slice(STEMS[0]), slice(STEMS[0], None), slice(None)))
                w, l = pa.array(seen >> 33), pa.array((seen >> 1) & 0xFFFFFFFF)
                nothing = pa.nulls(len(ends), pa.binary())
                for head, key, count in (([stems.take(w), rests.take(w), whole.take(l)], seen, n),
                                         ([nothing, nothing, whole.take(pa.array(ends >> 1))], ends, m)):
                    yield pa.RecordBatch.from_arrays([*head, pa.array(np.where(key & 1, count, 0)),
                                                      pa.array(np.where(key & 1, 0, count))], names=names)

    counted = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y")) \
        .mapInArrow(run, "s binary, r binary, l binary, n_1 long, n_0 long")
    return counted.repartition("s", "l").groupBy("s", "r", "l").agg(F.sum("n_1").alias("n_1"), F.sum("n_0").alias("n_0"))


def continuations(pairs: DataFrame) -> DataFrame:
    """(x, c_1, c_0): distinct left neighbours of every expression, by class.  An expression
    is a tag, the length of the stem or 0 for the word, and its bytes."""
    part = lambda k: F.substring("r", 1, k - STEMS[0]) if k else F.col("r")
    tagged = F.array(*[F.concat(F.lit(f"{k} ").cast("binary"), F.col("s"), part(k)) for k in (*STEMS, 0)])
    # rows of neighbours alone have null expressions; a filter on s would reach below the shuffle, which
    # could then not be shared with the counts of pairs
    seen = pairs.select("s", "l", F.explode(tagged).alias("x"), (F.col("n_1") > 0).cast("int").alias("s_1"),
                        (F.col("n_0") > 0).cast("int").alias("s_0")).where(F.col("x").isNotNull())
    distinct = seen.groupBy("s", "l", "x").agg(F.max("s_1").alias("s_1"), F.max("s_0").alias("s_0"))
    return distinct.groupBy("x").agg(F.sum("s_1").alias("c_1"), F.sum("s_0").alias("c_0"))


def _hash(tagged: bytes) -> int:
    """Spark's xxhash64 of a binary value."""
    h = xxhash.xxh64_intdigest(tagged, seed=42)
    return h - (1 << 64) if h >> 63 else h


def _tagged(tag: str, word: Column) -> Column:
    return F.xxhash64(F.concat(F.lit(f"{tag} ").cast("binary"), word))


def _discounted(n: str, discount: float) -> Column:
    return F.greatest(F.col(n) - discount, F.lit(0.0)).cast("float")


class Keys:
    """The model's keys for the words of a chunk and for the pairs in it."""

    def __init__(self, words: list[bytes]):
        made = lambda tag, k: np.fromiter(
            (_hash(tag + (w[:k] if k else w)) for w in words), dtype=np.int64, count=len(words))
        self.levels = [made(b"%d " % k, k) for k in (*STEMS, 0)]
        self.context = made(b"c ", 0)

    def pair(self, left: np.ndarray, word: np.ndarray) -> np.ndarray:
        u = self.context[left].view(np.uint64)
        return ((u << np.uint64(17)) | (u >> np.uint64(47))).view(np.int64) ^ self.levels[-1][word]


class KneserNey:
    """The two models as a table (key, t, o) of discounted counts, with the class shares
    among continuations and among running words."""

    def __init__(self, table: DataFrame, share: float, running: float):
        self.table, self.share, self.running = table, share, running
        self.rows = table.count()
        self.bits = (max(self.rows - 1, 0) // PIECE).bit_length()
        self._pieces: list = []

    def pieces(self) -> list:
        """Broadcast (key, t, o, which t and o) sorted by key, one for every value of the key's first ``bits`` bits."""
        if not self._pieces:
            spark = self.table.sparkSession
            first = F.shiftrightunsigned("key", 64 - self.bits) if self.bits else F.lit(0).cast("long")
            for i in range(1 << self.bits):
                local = self.table.where(first == i).toArrow()
                key, t, o = (local.column(c).to_numpy() for c in ("key", "t", "o"))
                order = np.argsort(key)
                # few pairs of counts stand for most keys
                both = (t.view(np.uint32).astype(np.uint64) << np.uint64(32)) | o.view(np.uint32)
                pairs, which = np.unique(both[order], return_inverse=True)
                self._pieces.append(spark.sparkContext.broadcast(
                    (key[order], (pairs >> np.uint64(32)).astype(np.uint32).view(np.float32),
                     pairs.astype(np.uint32).view(np.float32), which.astype(np.min_scalar_type(len(pairs))))))
        return self._pieces


def _logit(q):
    return np.log(q) - np.log1p(-q)


def _differences(keys: Keys, left: np.ndarray, word: np.ndarray, find, share: float, running: float) -> np.ndarray:
    """log P(word | left, toxic) - log P(word | left, ordinary) of every pair."""
    asked = [*keys.levels, keys.context, keys.pair(left, word)]
    ends = np.cumsum([len(k) for k in asked])[:-1]
    found = iter(zip(*(np.split(c, ends) for c in find(np.concatenate(asked))), strict=True))

    def back(q):
        t, o = next(found)
        return (t + SHARED * q) / (t + o + SHARED)

    q = np.full(len(keys.context), share)
    for _ in keys.levels:
        q = back(q)
    context = _logit(back(np.full(len(q), running)))[left]
    alone = _logit(q)[word] - _logit(share)
    return _logit(back(1 / (1 + np.exp(-context - alone)))) - context


def _window(d: np.ndarray) -> float:
    if not len(d):
        return 0.0
    run = np.concatenate(([0.0], np.cumsum(d)))
    w = min(WINDOW, len(d))
    return float((run[w:] - run[:-w]).max() / w)


def _finder(key: np.ndarray, t: np.ndarray, o: np.ndarray, which: np.ndarray | None = None):
    """Lookup in arrays sorted by key: counts, 0 for what is not there."""
    def find(wanted):
        if not len(key):
            return np.zeros(len(wanted)), np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        there = key[at] == wanted
        at = at if which is None else which[at]
        return np.where(there, t[at], 0.0).astype(np.float64), np.where(there, o[at], 0.0).astype(np.float64)

    return find


def _unique_pairs(rows):
    owner, left, word = _pairs(rows)
    seen, at = np.unique((left << 32) | word, return_inverse=True)
    return owner, seen >> 32, seen & 0xFFFFFFFF, at


def fit(labelled: DataFrame, label_col: str, text_col: str) -> KneserNey:
    """Count both models over every row given."""
    pairs = count_pairs(labelled, label_col, text_col)
    words = continuations(pairs).select(F.xxhash64("x").alias("key"), _discounted("c_1", DISCOUNT).alias("t"),
                                        _discounted("c_0", DISCOUNT).alias("o"), F.lit(0).alias("kind"))
    alone = F.col("s").isNull()
    turned = _tagged("c", F.col("l"))
    context = turned
    turned = F.shiftleft(turned, 17).bitwiseOR(F.shiftrightunsigned(turned, 47))
    both = turned.bitwiseXOR(_tagged("0", F.concat("s", "r")))
    # a context's own count is whole; a pair with nothing left after the discount says nothing
    left = [F.when(alone, F.col(n).cast("float")).otherwise(_discounted(n, d)).alias(a)
            for n, a, d in zip(("n_1", "n_0"), ("t", "o"), PAIR_DISCOUNT, strict=True)]
    others = pairs.select(F.when(alone, context).otherwise(both).alias("key"), *left,
                          F.when(alone, 1).otherwise(2).alias("kind")).where((F.col("t") > 0) | (F.col("o") > 0))
    # the shuffles of the counts are most of the disk that the operator takes
    table = written(words.unionByName(others), drop_shuffles=True)
    sums = {r["kind"]: (r["t"] + 1.0, r["o"] + 1.0) for r in table.groupBy("kind").agg(
        F.sum("t").alias("t"), F.sum("o").alias("o")).collect()}
    # kept off the ends when a class is missing
    shares = [min(max(t / (t + o), 1e-4), 1 - 1e-4) for t, o in (sums.get(k, (1.0, 1.0)) for k in (0, 1))]
    return KneserNey(table.drop("kind"), *shares)


def _loaded(piece):
    """A broadcast's value, which the worker does not keep: asked again, it is read from the executor's disk again."""
    value = piece.value
    piece.__dict__.pop("_value", None)
    return value


def _together(batches, most: int):
    """Batches joined to tables of about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def differences(docs: DataFrame, model: KneserNey, keep: list[str], text_col: str,
                limit: int = BROADCAST_NGRAMS, streamed: int = STREAMED_NGRAMS) -> DataFrame:
    """``keep`` columns and _x, the most toxic window's length-normalised difference."""
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    share, running = model.share, model.running
    out = rows.drop("_text").schema.add("_x", "double")
    if model.rows > max(limit, streamed):
        return _joined(rows, model, keep, out)
    pieces, bits, resident = model.pieces(), model.bits, model.rows <= limit
    # a chunk of a large model's texts is all that is held: every chunk loads every piece
    most, words_together = (0, SCORED_WORDS) if resident else (STREAMED_BYTES, STREAMED_BYTES)

    def run(batches):
        finders = [_finder(*p.value) for p in pieces] if resident else []

        def find(wanted):
            part = wanted.view(np.uint64) >> np.uint64(64 - bits) if bits else np.zeros(len(wanted), dtype=np.uint64)
            t, o = np.zeros(len(wanted)), np.zeros(len(wanted))
            for i, piece in enumerate(pieces):
                here = part == i
                t[here], o[here] = (finders[i] if resident else _finder(*_loaded(piece)))(wanted[here])
            return t, o

        for table in _together(batches, most):
            x = []
            for _, texts, words in _chunks(utf8_values(table.column(len(keep)).combine_chunks()), words_together):
                owner, left, word, at = _unique_pairs(texts)
                d = _differences(Keys(words), left, word, find, share, running)[at]
                x += map(_window, np.split(d, np.searchsorted(owner, np.arange(1, len(texts)))))
            columns = [c.combine_chunks() for c in table.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(x, pa.float64())], names=[*keep, "_x"])

    return rows.mapInArrow(run, out)


def _joined(rows: DataFrame, model: KneserNey, keep: list[str], out) -> DataFrame:
    """``differences`` with a model too large to broadcast: the n-grams of the texts meet it in a join."""
    share, running = model.share, model.running
    # the row number is fixed by writing the table
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()))

    def ask(batches):
        for batch in batches:
            for no, raw in zip(batch.column(0).to_pylist(), utf8_values(batch.column(1)), strict=True):
                for _, texts, words in _chunks([raw]):
                    _, left, word, _ = _unique_pairs(texts)
                    keys = Keys(words)
                    key = np.unique(np.concatenate([*keys.levels, keys.context, keys.pair(left, word)]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), no)), pa.array(key)],
                                                     names=["_row", "key"])

    def run(batches):
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            x = []
            for raw, found in zip(utf8_values(column["_text"]), column["_found"], strict=True):
                key, t, o = (found.values.field(f).to_numpy() for f in ("key", "t", "o")) if found.is_valid else \
                    (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))
                order = np.argsort(key)
                find = _finder(key[order], t[order], o[order])
                for _, texts, words in _chunks([raw]):
                    _, left, word, at = _unique_pairs(texts)
                    x.append(_window(_differences(Keys(words), left, word, find, share, running)[at]))
            yield pa.RecordBatch.from_arrays([*[column[c] for c in keep], pa.array(x, pa.float64())],
                                             names=[*keep, "_x"])

    asked = rows.select("_row", "_text").mapInArrow(ask, "_row long, key long")
    found = asked.join(model.table, "key").groupBy("_row").agg(F.collect_list(F.struct("key", "t", "o")).alias("_found"))
    return rows.join(found, "_row", "left").select(*keep, "_text", "_found").mapInArrow(run, out)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic") -> DataFrame:
    """One row per document: id, held_out, score, predicted, difference."""
    prepare(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(id_col).agg(F.max(label_col).alias("_label"))
    learnable = docs.select(id_col, text_col).where(~held_out(id_col, 3, 1)) \
        .join(broadcast_if(known, labels.count()), id_col)
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(CALIBRATION)) == 0
    model = fit(learnable.where(~part), "_label", text_col)
    checked = differences(learnable.where(part), model, ["_label"], text_col)
    beta = fit_logistic(checked, ["_x"], "_label", [0.05],
                        anchors=[(0.0, 0, 2.0), (2.0, 0, 0.5), (3.0, 1, 1.0)])
    beta[1] = max(beta[1], 0.1)
    out = differences(docs, model, [id_col], text_col)
    score = logistic(beta, "_x")
    return out.select(id_col, held_out(id_col, 3, 1).alias("held_out"), score.alias("score"),
                      (score >= THRESHOLD).cast("int").alias("predicted"), F.col("_x").alias("difference"))
