"""Operator 10 — language identification with error-correcting output codes.

Every language gets a codeword of bits.  One binary classifier per bit tells
the languages whose bit is set from the others: a naive-Bayes log-odds over
hashed byte n-grams, from counts that Spark gathers over all labelled texts.
A text's bit margins are decoded by loss: each codeword pays the exponential
loss of every bit, bits weighted by how well their classifier separates the
training languages, and the cheapest codeword wins.  The gap to the runner-up
becomes the score; small gaps mark a text as ambiguous.

Defined results: null texts and texts without a letter are ``und`` with score
0; texts without a language label teach nothing; without any label every text
is ``und``; repeated rows are judged alike; very long texts are used whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.scratch import prepare, utf8_values

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15        # hashed n-grams per order
SMOOTH = 0.5
MAX_DENSE = 7            # languages up to which every useful split of them is a bit
SHARPNESS = 40.0         # of the bit margins (mean log-odds per n-gram)
AMBIGUOUS = 0.6          # scores below are ambiguous
UND = "und"

_LETTER = regex.compile(r"\p{L}")
#: A-Z in lower case, digits as one digit, other ASCII non-letters as blanks
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32
              for b in range(256))
_CHUNK_BYTES = 200_000


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Rows whose CRC-32 of the id as text leaves ``remainder``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def _grams(texts: list[bytes]):
    """(order index, bucket per byte position) of the texts' n-grams, and the texts' first
    positions; positions whose n-gram leaves its text hold the bucket ``BUCKETS``."""
    joined = np.frombuffer(b"".join([t.translate(_FOLD) + b"\0" for t in texts]), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    starts = np.cumsum(sizes) - sizes
    ends = np.flatnonzero(joined == 0)
    rolled = np.zeros(len(joined), dtype=np.uint32)
    made = []
    for k in range(max(ORDERS)):
        rolled = rolled[: len(joined) - k] * np.uint32(0x01000193) ^ joined[k:]
        if k + 1 in ORDERS:
            code = np.full(len(joined), BUCKETS, dtype=np.int32)
            code[: len(rolled)] = (rolled * np.uint32(0x9E3779B1)) >> np.uint32(33 - BUCKETS.bit_length())
            for j in range(k + 1):   # the text's end mark lies inside the n-gram
                code[np.maximum(ends - j, 0)] = BUCKETS
            made.append(code)
    return made, starts, sizes


def _chunks(raws: list[bytes]):
    first, size = 0, 0
    for k, raw in enumerate(raws):
        if size and size + len(raw) > _CHUNK_BYTES:
            yield first, raws[first:k]
            first, size = k, 0
        size += len(raw)
    yield first, raws[first:]


def count_grams(labelled: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, order, bucket, n) over all labelled texts; each task adds up before the shuffle."""
    def run(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            raws = utf8_values(batch.column(1))
            langs = batch.column(0).to_pylist()
            for first, part in _chunks(raws):
                names, which = np.unique(np.array(langs[first:first + len(part)], dtype=object), return_inverse=True)
                made, _, sizes = _grams(part)
                base = np.repeat((which * (BUCKETS + 1)).astype(np.int32), sizes)
                for k, code in enumerate(made):
                    flat = np.bincount(base + code, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), -1)
                    for i, name in enumerate(names):
                        seen.setdefault(name, np.zeros((len(ORDERS), BUCKETS), dtype=np.int64))[k] += flat[i, :-1]
        for name, table in seen.items():
            k, code = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.astype(np.int32)),
                                              pa.array(code.astype(np.int32)), pa.array(table[k, code])],
                                             names=["lang", "k", "bucket", "n"])

    counted = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "lang string, k int, bucket int, n long")
    return counted.groupBy("lang", "k", "bucket").agg(F.sum("n").alias("n"))


def codewords(n: int) -> np.ndarray:
    """+1/-1 codewords, one row per language: all splits for few languages, else a
    random dense code (the best of several by its least distance)."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= MAX_DENSE:
        bits = [[1 if i == 0 or (mask >> (i - 1)) & 1 else -1 for i in range(n)] for mask in range(2 ** (n - 1) - 1)]
        return np.array(bits, dtype=np.int8).T
    width = int(np.ceil(15 * np.log2(n)))
    best, gap = None, -1
    for seed in range(20):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        near = min((int((code[a] != code[b]).sum()) for a, b in combinations(range(n), 2)), default=0)
        if near > gap:
            best, gap = code, near
    return best


class Ecoc:
    """Languages, codewords, per-bit n-gram weights and bit weights."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        # counts: language x order x bucket
        self.langs = langs
        self.code = codewords(len(langs)).astype(np.float64)
        share = np.zeros(counts.shape)
        for k in range(len(ORDERS)):
            c = counts[:, k] + SMOOTH
            share[:, k] = c / c.sum(axis=1, keepdims=True)
        bits = self.code.shape[1]
        # one more bucket, without weight, for positions that hold no n-gram; rows padded to whole vectors
        self.weights = np.zeros((len(ORDERS), BUCKETS + 1, -(-bits // 8) * 8), dtype=np.float32)
        seen = counts.sum(axis=0) > 0
        for b in range(bits):
            on, off = self.code[:, b] > 0, self.code[:, b] < 0
            if on.any() and off.any():
                w = np.log(share[on].mean(axis=0)) - np.log(share[off].mean(axis=0))
                self.weights[:, :-1, b] = np.where(seen, w, 0.0)
        # expected margin of every training language: what separates the bit's two sides
        expect = np.einsum("lkb,kbj->lj", share, self.weights[:, :-1, :bits]) / len(ORDERS)
        edge = (expect * self.code).min(axis=0) if len(langs) > 1 else np.ones(bits)
        self.bit_weight = np.maximum(edge, 1e-3) / max(np.maximum(edge, 1e-3).sum(), 1e-9)
        self.centre = np.array([
            (expect[self.code[:, b] > 0, b].min() + expect[self.code[:, b] < 0, b].max()) / 2
            if (self.code[:, b] < 0).any() else 0.0 for b in range(bits)])

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Log-odds per byte of every bit, summed over the orders and centred between the bit's two sides."""
        made, starts, sizes = _grams(texts)
        rows = self.weights[0].take(made[0], axis=0)
        for k, code in enumerate(made[1:], 1):
            rows += self.weights[k].take(code, axis=0)
        ones = np.ones(int(sizes.max(initial=1)), dtype=np.float32)
        out = np.stack([ones[:n] @ rows[a:a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        return out[:, :self.code.shape[1]] / (len(ORDERS) * np.maximum(sizes - 1, 1))[:, None] - self.centre

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codeword index and score (0 to 1) by the weighted exponential loss."""
        z = np.clip(margins * SHARPNESS / 10, -8, 8)
        loss = np.stack([(np.exp(-row * z) * self.bit_weight).sum(axis=1) for row in self.code], axis=1)
        best = loss.argmin(axis=1)
        if loss.shape[1] == 1:
            return best, np.ones(len(best))
        two = np.partition(loss, 1, axis=1)[:, :2]
        return best, 1 - np.sqrt(two[:, 0] / np.maximum(two[:, 1], 1e-300))


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Ecoc | None:
    """Learn from every row with a language label.  The counts that reach the driver are
    bounded by languages x orders x buckets."""
    rows = count_grams(labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()),
                       lang_col, text_col).toPandas()
    if rows.empty:
        return None
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), len(ORDERS), BUCKETS))
    at = rows["lang"].map({name: i for i, name in enumerate(langs)}).to_numpy()
    counts[at, rows["k"].to_numpy(), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return Ecoc(langs, counts)


def predict(docs: DataFrame, model: Ecoc | None, text_col: str = "text") -> DataFrame:
    """_rec (the columns of ``docs`` but the text), _text, _lang and _score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            raws = utf8_values(batch.column(1))
            lang, score = [], []
            for _, part in _chunks(raws):
                if m is None:
                    lang += [UND] * len(part)
                    score += [0.0] * len(part)
                    continue
                best, s = m.decode(m.margins(part))
                for raw, i, x in zip(part, best.tolist(), s.tolist(), strict=True):
                    letter = _LETTER.search(raw.decode("utf-8", "replace"))
                    lang.append(m.langs[i] if letter else UND)
                    score.append(min(max(x, 0.0), 1.0) if letter else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["_rec", "_text", "_lang", "_score"])

    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0).alias("_none")]
    rec = docs.select(F.struct(*rest).alias("_rec"), F.col(text_col).alias("_text"))
    return rec.mapInArrow(run, rec.select("*").schema.add("_lang", "string").add("_score", "double"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, ambiguous."""
    prepare(docs.sparkSession)
    model = fit(docs.where(~held_out(id_col, 4, 2)), lang_col, text_col)
    found = predict(docs.select(id_col, text_col), model, text_col)
    return found.select(F.col(f"_rec.`{id_col}`").alias(id_col),
                        held_out(f"_rec.`{id_col}`", 4, 2).alias("held_out"),
                        F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"),
                        ((F.col("_score") < AMBIGUOUS) | (F.col("_lang") == UND)).alias("ambiguous"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang") -> DataFrame:
    """Documents whose language was told: no ``und`` and none whose prediction is a toss-up
    (a score under a tenth of the ambiguity limit)."""
    prepare(docs.sparkSession)
    model = fit(docs.where(~held_out(id_col, 4, 2)), lang_col, text_col)
    found = predict(docs, model, text_col)
    return found.where((F.col("_lang") != UND) & (F.col("_score") >= AMBIGUOUS / 10)).select(
        *[F.col("_text").alias(c) if c == text_col else F.col(f"_rec.`{c}`").alias(c) for c in docs.columns])
