"""Operator 4 — near-duplicates by BagMinHash.

A document is the multiset of its five-word shingles (lower-cased words).
Every shingle owns Poisson processes over the weight axis, cut into dyadic
levels [0,1), [1,2), [2,4), ...: a level's process runs at the level's width
for all signature registers together, each point names its register and its
place in the level, and a point counts when its place lies below the shingle's
multiplicity (thinning).  The earliest point per register is the signature;
two documents agree in a register with probability equal to their weighted
Jaccard similarity.  Times are generated in ascending order and only up to a
per-document horizon, so a signature costs O(words + m log m).

Signatures are cut into bands.  Documents of a band bucket are compared with
the bucket's smallest id (its hub), first by sketch, then exactly by multiset
overlap.  Buckets whose members are still in different classes get the
remaining cross-class pairs tested, block by block, so no candidate link is
lost and pairs inside a class are never listed.  Classes are the connected
components of the verified links.

Defined results: equal word sequences are one class without any comparison;
texts without words (null, empty) and rows without id stand alone and stay;
texts of one to four words are a single shingle (equal or different); rows
sharing id and text are one document; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.graph import components
from tabulon.llm.scratch import broadcast_if, prepare, utf8_values, words_of, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6            # 192 registers; a pair at 0.8 is missed with probability 6e-5
HORIZON = 3.0                  # a register stays empty with probability exp(-HORIZON) / m; then the horizon doubles
SLACK = 0.15                   # five standard deviations of a 192-register estimate at 0.8
CHUNK_WORDS = 150_000          # words handled at once in a task
BLOCK_ROWS = 512               # members of a large bucket compared at once,
BLOCK_SHINGLES = 1_000_000     # and their shingles
MEMO_WORDS = 150_000

# Constants of the splitmix64 generator.
_GOLDEN, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S30, _S27, _S31, _S32, _S11 = (np.uint64(x) for x in (30, 27, 31, 32, 11))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _MIX1
    x = (x ^ (x >> _S27)) * _MIX2
    return x ^ (x >> _S31)


class _WordHash(dict):
    """64-bit hash of a word, remembered for frequent words."""

    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = value
        return value


def bags(texts: list[list[bytes]], hashes: _WordHash):
    """Shingle multisets of tokenised texts: (text index, shingle hash, multiplicity), sorted."""
    counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    total = int(counts.sum())
    word = np.fromiter((hashes[w] for ws in texts for w in ws), dtype=np.uint64, count=total)
    starts = np.cumsum(counts) - counts
    rolled = np.zeros(total, dtype=np.uint64)
    for j in range(SHINGLE):   # a shorter text has one shingle: what there is of it from its start
        part = _mix(word + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2 ** 64))
        rolled[: total - j] += part[j:] if j else part
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(total) - starts[owner]
    valid = place <= counts[owner] - SHINGLE
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    for d in short.tolist():
        own = word[starts[d]:starts[d] + counts[d]]
        rolled[starts[d]] = sum((int(_mix(own[j:j + 1] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2 ** 64))[0])
                                 for j in range(len(own)))) % 2 ** 64
        valid[starts[d]] = True
    owner, shingle = owner[valid], _mix(rolled[valid])
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(owner)))
    return owner[at], shingle[at], weight


def signatures(owner, shingle, weight, n_texts: int, m: int) -> np.ndarray:
    """Earliest point time per (text, register); infinity for texts without shingles."""
    total = np.bincount(owner, weights=weight, minlength=n_texts)
    horizon = np.where(total > 0, (np.log(m) + HORIZON) / np.maximum(total, 1), 0.0)
    sig = np.full(n_texts * m, np.inf)
    todo = np.ones(n_texts, dtype=bool)
    while True:
        pick = todo[owner]
        _points(owner[pick], shingle[pick], weight[pick], horizon, sig, m)
        todo &= np.isinf(sig.reshape(n_texts, m)).any(axis=1) & (total > 0)
        if not todo.any():
            return sig.reshape(n_texts, m)
        horizon[todo] *= 2


def _points(owner, shingle, weight, horizon, sig, m: int) -> None:
    level = 0
    low, width = 0, 1          # the level covers weights [low, low + width)
    while len(owner):
        state = _mix(shingle + np.uint64((level + 1) * 0xD1B54A32D192ED03 % 2 ** 64))
        o, limit, w, t = owner, horizon[owner], weight, np.zeros(len(owner))
        while len(o):
            state = state + _GOLDEN
            z = _mix(state)
            # an exponential gap of the merged process: rate width for each of m registers
            t = t - np.log(((z >> _S11).astype(np.float64) + 1.0) * 2.0 ** -53) / (m * width)
            live = t <= limit
            o, limit, w, t, state, z = o[live], limit[live], w[live], t[live], state[live], z[live]
            r = _mix(z ^ _GOLDEN)
            register = ((r >> _S32) * np.uint64(m)) >> _S32
            at = o * m + register.astype(np.int64)
            if width > 1:      # thinning: the point's unit of the level must lie below the multiplicity
                unit = low + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(width)) >> _S32).astype(np.int64)
                ok = unit < w
                np.minimum.at(sig, at[ok], t[ok])
            else:
                np.minimum.at(sig, at, t)
        low, width, level = low + width, (1 if level == 0 else 2 * width), level + 1
        more = weight > low
        owner, shingle, weight = owner[more], shingle[more], weight[more]


def _chunks(batch, text_at: int):
    """(first row, tokenised texts) with at most about CHUNK_WORDS words each."""
    first, texts, size = 0, [], 0
    column = batch.column(text_at)
    raws = (raw for at in range(0, len(column), 256) for raw in utf8_values(column.slice(at, 256)))
    for k, raw in enumerate(raws):
        words = words_of(raw)
        if texts and size + len(words) > CHUNK_WORDS:
            yield first, texts
            first, texts, size = k, [], 0
        texts.append(words)
        size += len(words)
    yield first, texts


def sign(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, key (hash of the words; null without words), n (shingles), sketch (a byte per register), bands."""
    m = bands * rows

    def run(batches):
        hashes = _WordHash()
        band_salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN)
        for batch in batches:
            for first, texts in _chunks(batch, 1):
                owner, shingle, weight = bags(texts, hashes)
                sig = signatures(owner, shingle, weight, len(texts), m)
                code = _mix(np.ascontiguousarray(sig).view(np.uint64))
                sketch = (code & np.uint64(255)).astype(np.uint8)
                band = band_salt[None, :].repeat(len(texts), axis=0)
                for j in range(rows):
                    band = _mix(band ^ code.reshape(len(texts), bands, rows)[:, :, j])
                n = np.bincount(owner, weights=weight, minlength=len(texts)).astype(np.int64)
                has = [len(ws) >= SHINGLE for ws in texts]
                offsets = np.concatenate(([0], np.cumsum(np.where(has, bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(texts)),
                    pa.array([xxhash.xxh3_128_digest(b" ".join(ws)) if ws else None for ws in texts], pa.binary()),
                    pa.array(n),
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[has].reshape(-1).view(np.int64)))],
                    names=["id", "key", "n", "sketch", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")) \
        .where("id IS NOT NULL").mapInArrow(run, "id long, key binary, n long, sketch binary, bands array<long>")


def _payload(docs: DataFrame, ids: DataFrame, n_ids: int, id_col: str, text_col: str) -> DataFrame:
    """id, grams of the wanted documents: shingle hashes as a sorted set of 64-bit numbers in
    which the k-th copy of a shingle is an element of its own."""
    def run(batches):
        hashes = _WordHash()
        for batch in batches:
            for first, texts in _chunks(batch, 1):
                owner, shingle, weight = bags(texts, hashes)
                copy = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                who = np.repeat(owner, weight)
                gram = np.repeat(shingle, weight)
                gram = np.where(copy > 0, _mix(gram + copy.astype(np.uint64) * _GOLDEN), gram)
                order = np.lexsort((gram, who))
                cuts = np.searchsorted(who[order], np.arange(len(texts) + 1))
                gram = gram[order]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(texts)),
                    pa.array([xxhash.xxh3_128_digest(b" ".join(ws)) if ws else None for ws in texts], pa.binary()),
                    pa.array([gram[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                    names=["id", "key", "grams"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")) \
        .join(broadcast_if(ids.select("id"), n_ids), "id", "left_semi")
    made = texts.mapInArrow(run, "id long, key binary, grams binary")
    # an id may stand before several texts: only the one that represents the class counts
    return written(made.join(broadcast_if(ids, n_ids), ["id", "key"], "left_semi").drop("key"))


def _overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(large):
        return 0.0
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both / (len(small) + len(large) - both)


def _verify(pairs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose multisets overlap by ``threshold`` or more, with the exact similarity."""
    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sim = np.array([_overlap(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64))
                            for x, y in zip(a, b, strict=True)])
            keep = pa.array(sim >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)],
                                             names=["a", "b", "sim"]).filter(keep)

    g = grams
    both = pairs.join(g.select(F.col("id").alias("a"), F.col("grams").alias("_a")), "a") \
        .join(g.select(F.col("id").alias("b"), F.col("grams").alias("_b")), "b")
    return both.select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long, sim double")


def _likely(pairs: DataFrame, sketches: DataFrame, floor: float) -> DataFrame:
    """Pairs whose sketches agree in a share of at least ``floor`` of the registers."""
    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8)
                    .reshape(batch.num_rows, -1) for k in (2, 3))
            keep = pa.array(_estimate((x == y).mean(axis=1)) >= floor)
            yield batch.select(["a", "b"]).filter(keep)

    s = sketches
    both = pairs.join(s.select(F.col("id").alias("a"), F.col("sketch").alias("_a"), F.col("n").alias("_na")), "a") \
        .join(s.select(F.col("id").alias("b"), F.col("sketch").alias("_b"), F.col("n").alias("_nb")), "b") \
        .where(F.least("_na", "_nb") >= THRESHOLD * F.greatest("_na", "_nb"))
    return both.select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def _estimate(agree):
    return (agree - 1 / 256) / (1 - 1 / 256)   # bytes agree by chance once in 256


def _open_members(members: DataFrame, labels: DataFrame, n_labels: int) -> DataFrame:
    """(band, blocks, id, label) of the buckets whose members, the hub aside, are in several
    classes; blocks says into how many parts such a bucket is cut."""
    tagged = written(members.where("id <> hub").join(broadcast_if(labels, n_labels), "id", "left")
                     .select("band", "id", "n", F.coalesce("component", "id").alias("label")))
    state = tagged.groupBy("band").agg(F.min("label").alias("_l"), F.max("label").alias("_h"),
                                       F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_n")).where("_l <> _h")
    state = written(state.select("band", F.ceil(F.greatest(
        F.col("_c") / F.lit(float(BLOCK_ROWS)), F.col("_n") / F.lit(float(BLOCK_SHINGLES)))).cast("int")
        .alias("blocks")))
    return tagged.join(broadcast_if(state, state.count()), "band").select("band", "blocks", "id", "label")


def _rest(members: DataFrame, signed: DataFrame, grams: DataFrame, floor: float, threshold: float) -> DataFrame:
    """Links (a, b) that no hub comparison has settled: members of different classes,
    compared block by block.  A pair meets in the first band its members share, is
    screened by sketch and decided by its multisets inside the task, so only links
    leave it — and of these only what joins classes not yet joined there."""
    rows = members.join(signed.select("id", "n", "sketch", "bands"), "id").join(grams, "id") \
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                "block", "id", "label", "n", "sketch", "bands", "grams")

    def compare(key, rows):
        band, i, j = key
        block, ids, label, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
        sketch = np.frombuffer(b"".join([r[4] for r in rows]), dtype=np.uint8).reshape(len(rows), -1)
        bands = np.array([r[5] for r in rows], dtype=np.int64)
        sets = [np.frombuffer(r[6], dtype=np.uint64) for r in rows]
        here = int(np.flatnonzero(bands[0] == band)[0])
        right = np.flatnonzero(block == j)
        for p in np.flatnonzero(block == i).tolist():
            q = right[right > p] if i == j else right
            q = q[(label[q] != label[p]) & (np.minimum(n[q], n[p]) >= threshold * np.maximum(n[q], n[p]))]
            if len(q):
                q = q[_estimate((sketch[q] == sketch[p]).mean(axis=1)) >= floor]
            if len(q):
                q = q[(bands[q] == bands[p]).argmax(axis=1) == here]
            for other in q.tolist():
                if label[other] != label[p] and _overlap(sets[p], sets[other]) >= threshold:
                    label[label == label[other]] = label[p]
                    yield max(ids[p], ids[other]), min(ids[p], ids[other])

    def run(batches):
        def values():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for key, group in groupby(values(), key=lambda r: r[:3]):
            found = list(compare(key, [r[3:] for r in group]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()),
                                                  pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j") \
        .mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document with words and id: id, class_id (smallest id of its class)."""
    prepare(docs.sparkSession)
    floor = threshold - SLACK
    signed = written(sign(docs, id_col, text_col, bands, rows))
    classes = written(signed.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep")))
    n_classes = classes.count()
    reps = signed.join(broadcast_if(classes.select("key", F.col("rep").alias("id")), n_classes, 500_000),
                       ["key", "id"], "left_semi")
    exploded = reps.select("id", "n", F.explode("bands").alias("band"))
    buckets = written(exploded.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("top"),
                                                   F.count(F.lit(1)).alias("c")).where("hub <> top"))
    large = buckets.where("c > 2").select("band", "hub")
    members = written(exploded.join(broadcast_if(large, large.count()), "band"))
    pairs = buckets.where("c = 2").select(F.col("top").alias("a"), F.col("hub").alias("b")).unionByName(
        members.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))).distinct()
    likely = written(_likely(written(pairs), reps.select("id", "n", "sketch"), floor))

    def grams_of(ids: DataFrame) -> DataFrame:
        keyed = written(ids.withColumnRenamed("id", "rep").distinct().join(classes, "rep")
                        .select(F.col("rep").alias("id"), "key"))
        return _payload(docs, keyed, keyed.count(), id_col, text_col)

    ends = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id")))
    links = written(_verify(likely, grams_of(ends), threshold).select("a", "b"))
    labels = written(components(links))
    still = written(_open_members(members, labels, labels.count()))
    if not still.isEmpty():
        more = written(_rest(still, reps, grams_of(still.select("id")), floor, threshold))
        if not more.isEmpty():
            # the classes so far are stars already
            stars = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
            labels = written(components(stars.unionByName(more)))
    n_labels = labels.count()
    placed = signed.select("id", "key").where("key IS NOT NULL") \
        .join(broadcast_if(classes, n_classes, 500_000), "key") \
        .join(broadcast_if(labels.withColumnRenamed("id", "rep"), n_labels), "rep", "left") \
        .select("id", F.coalesce("component", "rep").alias("class_id"))
    return placed


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id, kept (the row's document represents its class)."""
    found = written(near_duplicates(docs, id_col, text_col).distinct())
    rows = docs.select(F.col(id_col).cast("long").alias("id"))
    out = rows.join(broadcast_if(found, found.count(), 500_000), "id", "left") \
        .withColumn("class_id", F.coalesce("class_id", "id"))
    return out.select(F.col("id").alias(id_col), "class_id",
                      F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of every class; rows sharing id and text become one row."""
    found = near_duplicates(docs, id_col, text_col)
    gone = written(found.where("id <> class_id").select(F.col("id").alias("_nd_id")).distinct())
    again = written(found.groupBy("id").count().where("count > 1").select(F.col("id").alias("_nd_id")))
    on = F.col(id_col).cast("long") == F.col("_nd_id")
    kept = docs.join(broadcast_if(gone, gone.count()), on, "left_anti")
    n_again = again.count()
    if not n_again:
        return kept
    repeated = kept.join(broadcast_if(again, n_again), on, "left_semi").dropDuplicates([id_col])
    return kept.join(broadcast_if(again, n_again), on, "left_anti").unionByName(repeated)
