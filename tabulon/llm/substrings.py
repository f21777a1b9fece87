"""Operator 13 — duplicate passages by De Bruijn compaction.

The graph's edges are token k-mers.  Every window of ``WINDOW`` words is
represented by one edge, the k-mer of least hash in it (equal windows choose
equal edges), so 1 position in 22 becomes a row instead of every one.  The
consecutive windows that share an edge are a path through it, known by the
hash of all its words; a path row holds the edge, the path and its source
coordinates (document, text key, first word).

Compaction is aggregation and joins: equal paths collapse into one row with
its first source.  Where an edge carries a single path it does not branch, and
the path is decided as a whole: later documents repeat all its windows.  Where
an edge branches into several paths, only the first source of each path is
unrolled into windows, which are joined among each other.  Repeated paths and
windows that lie on one diagonal (same document, same source, same distance)
compact into spans.  Source coordinates then verify every span: its words are
read again on both sides, and a span counts only if their digests agree.

Defined results: a null or wordless text has no words; texts under ``WINDOW``
words lose nothing; rows that share an id never count against each other; a
row with a null id neither loses words nor takes any from others; empty tables
give no rows; other columns are ignored.  Very long texts are hashed, scanned
and digested in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.scratch import broadcast_if, prepare, utf8_values, written

WINDOW = 50
EDGE = 8                        # words of a k-mer
PIECE = 1 << 16                 # words hashed, windows scanned or words joined at a time
LONG_WORD = 256                 # bytes; longer words are hashed one by one
BROADCAST_REQUESTS = 200_000    # documents with a few spans each, joined to the texts
BROADCAST_PATHS = 20_000        # paths or windows, joined to rows of their own size

_M = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95      # odd: invertible modulo 2^64
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word: maximal runs without ASCII blanks."""
    inside = ~_BLANK[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(inside) and inside[-1]:
        edge = np.concatenate((edge, [len(inside)]))
    return edge[::2], edge[1::2]


def tokens(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes at a time over all words of a piece."""
    eights = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw + bytes(8), dtype=np.uint8), 8)
    out = np.empty(len(starts), dtype=np.uint64)
    for a in range(0, len(starts), PIECE):
        at, left = starts[a:a + PIECE], ends[a:a + PIECE] - starts[a:a + PIECE]
        h = mix(left.astype(np.uint64) * _M)
        todo = np.flatnonzero(left <= LONG_WORD)
        offset = 0
        while len(todo):
            rest = left[todo] - offset
            lane = eights[at[todo] + offset].view("<u8")[:, 0]
            lane &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * np.minimum(rest, 8)).astype(np.uint64)
            h[todo] = mix((h[todo] ^ lane) * _M)
            offset += 8
            todo = todo[rest > 8]
        for i in np.flatnonzero(left > LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(raw[at[i]:at[i] + left[i]])
        out[a:a + PIECE] = h
    return out


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = PIECE + 2 * WINDOW
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Runs:
    """Hashes of any run of a piece's tokens, from one running sum."""

    def __init__(self, t: np.ndarray):
        up, self.down = _powers()
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(t * up[:len(t)])))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _M)


def paths(t: np.ndarray, window: int = WINDOW, edge: int = EDGE) -> Iterator[tuple[np.ndarray, ...]]:
    """Per piece: edge hash, path hash, first window and number of windows of every path."""
    for a in range(0, len(t) - window + 1, PIECE):
        piece = t[a:a + PIECE + window - 1]
        runs = Runs(piece)
        k = np.arange(len(piece) - edge + 1)
        hashes = runs(k, k + edge)
        least = np.lib.stride_tricks.sliding_window_view(hashes, window - edge + 1).argmin(axis=1)
        chosen = least + np.arange(len(least))          # the edge of every window
        first = np.concatenate(([0], np.flatnonzero(np.diff(chosen)) + 1))
        n = np.diff(np.concatenate((first, [len(chosen)])))
        e = hashes[chosen[first]]
        # the place of the edge in the path belongs to its name: the path's windows all choose it
        name = mix(runs(first, first + n + window - 1) ^ mix((chosen[first] - first).astype(np.uint64) + e))
        yield e, name, first + a, n


def _texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    yield from enumerate(utf8_values(batch.column(2)))


def _signed(hashes: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(hashes).view(np.int64), pa.int64())


def _path_rows(texts: DataFrame, window: int, edge: int) -> DataFrame:
    """(doc, key, edge, path, at, n) of every document's paths."""
    def run(batches):
        for batch in batches:
            row, found = [], []
            for i, raw in _texts_of(batch):
                starts, ends = bounds(raw)
                if len(starts) >= window:
                    for part in paths(tokens(raw, starts, ends), window, edge):
                        row.append(np.full(len(part[0]), i))
                        found.append(part)
            if row:
                where = pa.array(np.concatenate(row))
                e, name, at, n = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(where), batch.column(1).take(where), _signed(e), _signed(name),
                     pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(n).astype(np.int32))],
                    names=["doc", "key", "edge", "path", "at", "n"])

    schema = texts.select("doc", "key").schema.add("edge", "long").add("path", "long").add("at", "integer").add("n", "integer")
    return texts.mapInArrow(run, schema)


def _per_document(requests: DataFrame, *fields: str) -> DataFrame:
    """One row per document: the array ``asked`` of its requests."""
    return written(requests.groupBy("doc", "key").agg(F.collect_list(F.struct(*fields)).alias("asked")))


def _requested(texts: DataFrame, requests: DataFrame, how: str = "inner") -> DataFrame:
    """(doc, key, text, asked): texts with their requests, which are broadcast only when few."""
    small = broadcast_if(requests, requests.count(), BROADCAST_REQUESTS)
    return texts.join(small, ["doc", "key"], how).select("doc", "key", "text", "asked")


def _unrolled(texts: DataFrame, requests: DataFrame, window: int) -> DataFrame:
    """(doc, key, path, off, at, run): the windows of the requested paths, each with its hash ``run``."""
    def run(batches):
        for batch in batches:
            asked = batch.column(3).to_pylist()
            row, path, off, at, hashes = [], [], [], [], []
            for i, raw in _texts_of(batch):
                starts, ends = bounds(raw)
                for a in asked[i]:
                    part = slice(a["at"], a["at"] + a["n"] + window - 1)
                    low, high = int(starts[part][0]), int(ends[part][-1])
                    t = tokens(raw[low:high], starts[part] - low, ends[part] - low)
                    k = np.arange(a["n"])            # a path lies within one piece
                    hashes.append(Runs(t)(k, k + window))
                    row.append(np.full(len(k), i))
                    path.append(np.full(len(k), a["path"], dtype=np.int64))
                    off.append(k.astype(np.int32))
                    at.append((k + a["at"]).astype(np.int32))
            if row:
                where = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(where), batch.column(1).take(where), pa.array(np.concatenate(path)),
                     pa.array(np.concatenate(off)), pa.array(np.concatenate(at)), _signed(hashes)],
                    names=["doc", "key", "path", "off", "at", "run"])

    schema = texts.select("doc", "key").schema.add("path", "long").add("off", "integer").add("at", "integer").add("run", "long")
    return _requested(texts, requests).mapInArrow(run, schema)


def _joined(raw: bytes, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> Iterator[bytes]:
    """Words [a, b) joined by single blanks, in pieces."""
    for i in range(a, b, PIECE):
        j = min(i + PIECE, b)
        yield (b" " if i > a else b"") + b" ".join(raw[starts[i]:ends[j - 1]].split())


def _digest(raw: bytes, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for part in _joined(raw, starts, ends, a, b):
        h.update(part)
    return h.digest()


def _digests(texts: DataFrame, requests: DataFrame) -> DataFrame:
    """(doc, key, start, end, digest) of the requested runs of words."""
    def run(batches):
        for batch in batches:
            asked = batch.column(3).to_pylist()
            row, spans, digests = [], [], []
            for i, raw in _texts_of(batch):
                starts, ends = bounds(raw)
                for a in asked[i]:
                    row.append(i)
                    spans.append((a["start"], a["end"]))
                    digests.append(_digest(raw, starts, ends, a["start"], a["end"]))
            where = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(where), batch.column(1).take(where), pa.array([s for s, _ in spans], pa.int32()),
                 pa.array([e for _, e in spans], pa.int32()), pa.array(digests, pa.binary())],
                names=["doc", "key", "start", "end", "digest"])

    schema = texts.select("doc", "key").schema.add("start", "integer").add("end", "integer").add("digest", "binary")
    return _requested(texts, requests).mapInArrow(run, schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, key, text): the key tells rows that share an id apart; where none do it is 0, which
    costs next to nothing in the shuffles."""
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).count()
    key = F.xxhash64(F.col(text_col)) if ids.where(F.col("count") > 1).limit(1).count() else F.lit(0).cast("long")
    return docs.select(F.col(id_col).alias("doc"), key.alias("key"), F.col(text_col).alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   edge: int = EDGE) -> DataFrame:
    """(doc, key, start, end, digest): runs of words, each verified to stand in a document with a
    smaller id, that together hold every window that also starts in one.  ``key`` is the text's hash."""
    return _spans(_texts(docs, id_col, text_col), window, edge)


def _spans(texts: DataFrame, window: int, edge: int) -> DataFrame:
    prepare(texts.sparkSession)
    rows = written(_path_rows(texts.where("doc IS NOT NULL AND text IS NOT NULL"), window, edge))
    source = F.min(F.struct("doc", "key", "at")).alias("first")
    known = written(rows.groupBy("path").agg(F.min("edge").alias("edge"), F.max("n").alias("n"), source,
                                             F.max("doc").alias("last")))
    # an edge branches when several paths run through it in more than one document
    branching = written(known.groupBy("edge").agg(
        F.count(F.lit(1)).alias("paths"), F.min("first.doc").alias("low"), F.max("last").alias("high"))
        .where("paths > 1 AND low < high").select("edge", F.lit(True).alias("branches")))
    found = written(known.join(broadcast_if(branching, branching.count()), "edge", "left")
                    .where("branches OR first.doc < last").withColumn("branches", F.coalesce("branches", F.lit(False)))
                    .select("path", "n", "first", "branches"))
    few = broadcast_if(found.select("path", "first", "branches"), found.count(), BROADCAST_PATHS)
    met = written(rows.drop("edge").join(few, "path").where("first.doc < doc OR branches"))

    # paths as a whole: every later document repeats the first source
    whole = met.where("first.doc < doc").select(
        "doc", "key", F.col("at").alias("start"), (F.col("at") + F.col("n") + (window - 1)).alias("end"),
        F.col("first.doc").alias("s_doc"), F.col("first.key").alias("s_key"), F.col("first.at").alias("s_start"))

    # branching paths: the windows of the first sources, among each other
    firsts = found.where("branches").select("path", "n", "first.*")
    unrolled = written(_unrolled(texts, _per_document(firsts, "path", "at", "n"), window))
    windows = unrolled.groupBy("run").agg(source, F.max("doc").alias("last")).where("first.doc < last")
    windows = written(windows.drop("last"))
    again = unrolled.select("doc", "path", "off", "run").join(
        broadcast_if(windows, windows.count(), BROADCAST_PATHS), "run").where("first.doc < doc")
    again = written(again.select("path", "off", "first"))
    # every place of the path in the document of its first source
    owners = met.where("branches AND first.doc = doc").select("path", "doc", "key", "at")
    single = owners.join(broadcast_if(again, again.count(), BROADCAST_PATHS), "path").select(
        "doc", "key", (F.col("at") + F.col("off")).alias("start"), (F.col("at") + F.col("off") + window).alias("end"),
        F.col("first.doc").alias("s_doc"), F.col("first.key").alias("s_key"), F.col("first.at").alias("s_start"))

    # what touches on one diagonal is one span
    diagonal = Window.partitionBy("doc", "key", "s_doc", "s_key", "shift").orderBy("start", "end")
    before = F.max("end").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    lined = whole.unionByName(single).withColumn("shift", F.col("s_start") - F.col("start"))
    numbered = lined.withColumn("opens", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)) \
        .withColumn("nth", F.sum("opens").over(diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    spans = written(numbered.groupBy("doc", "key", "s_doc", "s_key", "shift", "nth").agg(
        F.min("start").alias("start"), F.max("end").alias("end")).select(
        "doc", "key", "start", "end", "s_doc", "s_key", (F.col("start") + F.col("shift")).alias("s_start"),
        (F.col("end") + F.col("shift")).alias("s_end")))

    # the words at the source coordinates; the other side is compared where they are removed
    sources = spans.select(F.col("s_doc").alias("doc"), F.col("s_key").alias("key"), F.col("s_start").alias("start"),
                           F.col("s_end").alias("end")).distinct()
    digests = written(_digests(texts, _per_document(sources, "start", "end")).distinct())
    named = digests.select(F.col("doc").alias("s_doc"), F.col("key").alias("s_key"), F.col("start").alias("s_start"),
                           F.col("end").alias("s_end"), "digest")
    return spans.join(broadcast_if(named, digests.count(), BROADCAST_REQUESTS), ["s_doc", "s_key", "s_start", "s_end"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   edge: int = EDGE) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256 (kept words joined by single blanks)."""
    texts = _texts(docs, id_col, text_col)
    spans = _spans(texts, window, edge)
    asked = _per_document(spans, "start", "end", "digest")
    id_type = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            every = batch.column(3).to_pylist()
            n_words, n_removed, digests = [], [], []
            for i, raw in _texts_of(batch):
                starts, ends = bounds(raw)
                gone = np.zeros(len(starts), dtype=bool)
                for s in every[i] or ():
                    if _digest(raw, starts, ends, s["start"], s["end"]) == s["digest"]:
                        gone[s["start"]:s["end"]] = True
                turns = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))
                h = hashlib.sha256()
                for nth, (a, b) in enumerate(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)):
                    if nth:
                        h.update(b" ")
                    for part in _joined(raw, starts, ends, a, b):
                        h.update(part)
                n_words.append(len(starts))
                n_removed.append(int(gone.sum()))
                digests.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(digests, pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    schema = T.StructType().add(id_col, id_type).add("n_words", "long").add("n_removed", "long") \
        .add("kept_sha256", "string")
    return _requested(texts, asked, "left").mapInArrow(run, schema)
