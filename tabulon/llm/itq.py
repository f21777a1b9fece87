"""Operator 9 — embedding near-duplicates by iterative quantisation.

Rotations are learned that turn unit vectors into binary codes whose bits flip
with the angle between vectors.  The vectors are not centred: the limit is one
on their own cosine, and the angle seen from a mean that a large cluster has
drawn near is wider.  The codes are cut into the chunks of a
multi-index: a pair is retrieved when one of its chunks differs in at most one
bit, in the first table where that holds, so every pair comes up once.  Pairs
near in Hamming distance over all chunks are reranked with the original
vectors in double precision.  Equal vectors are one class with a multiplicity;
their pairs are counted, never listed.

Chunks get one bit more than the logarithm of the number of classes, so a
bucket of spread-out vectors holds about half a one at every size.  The wider
the chunks, the less often one of them agrees, so their number grows with their
width: a pair at the cosine limit is missed with probability ``MISS`` at most
at every size, by the binomial formula for independent bits that flip with
probability angle / pi.

The rotations are fitted on a bounded sample (``FIT_ROWS`` classes in the
order of a hash of the id); every row is coded, stored and searched.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; shorter vectors
compare as if filled up with zeros; rows repeating a vector (and even an id)
are separate vectors; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.graph import components
from tabulon.llm.scratch import broadcast_if, prepare, written

COSINE = 0.95
TABLES = 8            # at least
MISS = 0.001          # of the pairs at the limit
FIT_ROWS = 20_000
ITERATIONS = 30
MIN_CHUNK = 8
BROADCAST_CLASSES = 100_000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)   # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def missed(chunk: int, tables: int, cosine: float) -> float:
    """Probability that no chunk of a pair at ``cosine`` differs in at most one bit."""
    flip = math.acos(cosine) / math.pi
    return (1 - (1 - flip) ** chunk - chunk * flip * (1 - flip) ** (chunk - 1)) ** tables


def tables_for(chunk: int, cosine: float) -> int:
    """So many chunks that a pair at ``cosine`` is missed with probability ``MISS`` at most."""
    once = missed(chunk, 1, cosine)
    return TABLES if once <= 0 else max(TABLES, math.ceil(math.log(MISS) / math.log(once)))


def learn(sample: np.ndarray, bits: int, seed: int = 11) -> np.ndarray:
    """Projection with ``bits`` columns: principal axes turned by ITQ rotations."""
    x = _unit(sample)
    d = x.shape[1]
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1]
    rng = np.random.default_rng(seed)
    out, made = [], 0
    while made < bits:
        v = x @ axes
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ITERATIONS):   # codes for the rotation, then the rotation for the codes
            b = np.where(v @ r >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(v.T @ b)
            r = left @ right
        out.append(axes @ r)
        made += d
    columns = np.concatenate(out, axis=1)
    return columns[:, rng.permutation(columns.shape[1])[:bits]]


def _encode(classes: DataFrame, model, tables: int, chunk: int) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        turn = shared.value
        weight = (1 << np.arange(chunk, dtype=np.int64))
        for batch in batches:
            x = _unit(_matrix(batch.column(1)))
            bits = (x @ turn >= 0).reshape(len(x), tables, chunk)
            codes = (bits * weight).sum(axis=2)
            offsets = pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(codes.reshape(-1)))],
                names=["id", "codes"])

    return classes.select("id", "vec").mapInArrow(run, "id long, codes array<long>")


def _flips(a: Column, b: Column) -> Column:
    """Differing bits per chunk."""
    return F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))


def _candidates(codes: DataFrame, tables: int, chunk: int, limit: int, n: int) -> DataFrame:
    """Pairs (a < b) with a chunk at distance 0 or 1, each once, near over all chunks."""
    placed = codes.select("id", "codes", F.posexplode("codes").alias("t", "value"))
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(chunk)])
    probes = placed.select(F.col("id").alias("a"), F.col("codes").alias("ca"), "t", "value",
                           F.explode(masks).alias("mask"))
    probes = probes.select("a", "ca", "t", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    stored = placed.select(F.col("id").alias("b"), F.col("codes").alias("cb"), "t", "value")
    pairs = probes.join(broadcast_if(stored, n, BROADCAST_CLASSES), ["t", "value"]).where("a < b") \
        .withColumn("flips", _flips(F.col("ca"), F.col("cb")))
    earlier = F.exists(F.slice("flips", F.lit(1), F.col("t")), lambda x: x <= 1)
    near = F.aggregate("flips", F.lit(0), lambda s, x: s + x) <= limit
    return pairs.where(~earlier & near).select("a", "b")


def _rerank(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """Pairs with a cosine of at least ``cosine`` and the copies on either side."""
    def run(batches):
        for batch in batches:
            x, y = _unit(_matrix(batch.column(4))), _unit(_matrix(batch.column(5)))
            keep = pa.array((x * y).sum(axis=1) >= cosine)
            yield batch.select(["a", "b", "na", "nb"]).filter(keep)

    c = classes
    both = pairs.join(c.select(F.col("id").alias("a"), F.col("copies").alias("na"), F.col("vec").alias("va")), "a") \
        .join(c.select(F.col("id").alias("b"), F.col("copies").alias("nb"), F.col("vec").alias("vb")), "b")
    return both.select("a", "b", "na", "nb", "va", "vb").mapInArrow(run, "a long, b long, na long, nb long")


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE,
                 tables: int | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", _usable(F.col("v")) & F.col("id").isNotNull())
    good = rows.where("ok").withColumn("key", F.xxhash64("v"))
    # class numbers are dense in no order; an id may stand before several vectors, so classes get their own
    classes = good.groupBy("key", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    dim = rows.where("ok").agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return _alone(rows, id_col)
    filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))
    classes = written(classes.select("key", "v", "least", "copies", filled.alias("vec"),
                                     F.monotonically_increasing_id().alias("id")))
    n = classes.count()
    chunk = max(MIN_CHUNK, math.ceil(math.log2(max(n, 2))) + 1)
    tables = tables or tables_for(chunk, cosine)
    sample = classes.orderBy(F.xxhash64("least", "key")).limit(fit_rows).select("vec").toArrow()
    model = learn(_matrix(sample.column("vec").combine_chunks()), tables * chunk)
    flip = math.acos(cosine) / math.pi
    bits = tables * chunk
    limit = math.ceil(bits * flip + 8 * math.sqrt(bits * flip * (1 - flip)))
    codes = written(_encode(classes, model, tables, chunk))
    pairs = written(_candidates(codes, tables, chunk, limit, n))
    links = written(_rerank(pairs, classes, cosine))
    counts = links.select(F.col("a").alias("id"), F.col("nb").alias("n")) \
        .unionByName(links.select(F.col("b").alias("id"), F.col("na").alias("n"))) \
        .groupBy("id").agg(F.sum("n").alias("linked"))
    labels = written(components(links))
    slim = classes.select("id", "least", "copies")
    joined = slim.join(counts, "id", "left").join(labels, "id", "left") \
        .withColumn("component", F.coalesce("component", "id"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = written(joined.join(smallest, "component").select(
        "id", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    by_vector = classes.select("id", "key", "v").join(placed, "id").select("key", "v", "component_id", "n_links")
    found = good.join(broadcast_if(written(by_vector), n, BROADCAST_CLASSES), ["key", "v"]) \
        .select("id", "n_links", "component_id")
    out = found.select(F.col("id").alias(id_col), "n_links", "component_id",
                       (F.col("id") == F.col("component_id")).alias("kept"))
    return out.unionByName(_alone(rows.where("NOT ok"), id_col))


def _alone(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                       F.col("id").alias("component_id"), F.lit(True).alias("kept"))
