"""Operator 6 — sharding by sampled splitters.

Size-weighted key samples give quantile boundaries; records are
range-partitioned by them on (hash of the text, id), overfull ranges are
subdivided by boundaries from a second, denser sample, and a running byte
count inside the ranges turns the global key order into shards of equal size.

Law: ``bytes`` — shard sizes are near equal at every scale.  Records larger
than ``1/big_share`` of a shard (there can be at most ``shards * big_share``
of them) are dealt first, largest to the emptiest shard; the ranges then fill
what is left, so a shard misses its share by about one small record.  Equal
texts have neighbouring keys and stay together unless balance needs a cut.

Defined results: a null text has no bytes (size 8, checksum of no bytes);
records that agree in key and size are interchangeable, repeated rows each
get their own slot; an empty table gives an empty result; columns of the
input may have any other names (they are not touched).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.scratch import uniform, written

SHARDS = 24
RANGES = 256          # fine ranges; each is one sort group
SAMPLES_PER_RANGE = 32
BIG_SHARE = 64
MAX_BIG = 50_000      # records dealt on their own, at most


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long")


def _splitters(rows: DataFrame, total: float, ranges: int, per_range: int, seed: int) -> list[tuple[int, int]]:
    """Boundaries (h, id) at weight quantiles of a size-weighted Bernoulli sample."""
    if not total:
        return []
    step = total / (ranges * per_range)
    picked = rows.where(uniform(F.lit(seed), "_h", "_id") * step < F.col("_w"))
    running = F.sum(F.greatest(F.col("_w"), F.lit(step))).over(
        Window.orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, 0))
    # the sample holds about ranges * per_range rows, whatever the input
    cuts = (picked.select("_h", "_id", running.alias("_run"))
            .groupBy(F.floor(F.col("_run") / F.lit(total / ranges)).alias("_q"))
            .agg(F.min(F.struct("_h", "_id")).alias("_k")).where("_q > 0"))
    return sorted((r["_k"]["_h"], r["_k"]["_id"]) for r in cuts.collect())


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """Index of the range that holds (_h, _id): binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    table = F.expr("array(" + ",".join(f"named_struct('_h',{h}L,'_id',{i}L)" for h, i in bounds) + ")")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    key = F.struct("_h", "_id")

    def halve(pos, step):
        inside = pos + step <= len(bounds)
        return F.when(inside & (F.get(table, F.least(pos + step, F.lit(len(bounds))) - 1) <= key),
                      pos + step).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)


def assign(rows: DataFrame, key: Column, size: Column, tie: Column, shards: int = SHARDS, ranges: int = RANGES,
           per_range: int = SAMPLES_PER_RANGE, big_share: int = BIG_SHARE) -> DataFrame:
    """``rows`` plus ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``key`` (long) orders the records, ``tie`` (long) separates equal keys.
    """
    # the record travels as one struct, so its columns may have any names; everything is
    # planned on slim rows, and the records themselves are moved once
    full = rows.select(F.struct("*").alias("_rec"), key.alias("_h"), F.coalesce(tie, F.lit(-1)).cast("long")
                       .alias("_id"), size.cast("long").alias("_size"))
    slim = written(full.drop("_rec"))
    total, largest = slim.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
    big_share = max(1, min(big_share, MAX_BIG // shards))
    big_from = total / (shards * big_share)
    filled, big_slots = [0] * shards, [0] * shards
    out = None
    if largest > big_from:
        places = _deal(slim.where(F.col("_size") > big_from), filled, big_slots)
        same = ["_h", "_id", "_size"]
        out = full.where(F.col("_size") > big_from) \
            .withColumn("_copy", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))) \
            .join(F.broadcast(places), [*same, "_copy"]).select("_rec.*", "shard", "slot")
    small = slim.where(F.col("_size") <= big_from)
    n_small, rest = small.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    # what every shard may still take: the level that the big records leave, filled to the rest
    ends, run = [], 0.0
    for x in _room(filled, rest):
        run += x
        ends.append(run)
    # a range is weighed by bytes and by rows, so that neither a long nor a short text overfills its sort group
    small = small.withColumn("_w", F.col("_size") + F.lit(rest / max(n_small, 1)))
    weight = 2.0 * rest
    bounds = _splitters(small, weight, ranges, per_range, 1)
    ranged = small.withColumn("_range", _range_of(bounds))
    # overfull ranges are subdivided from a denser sample of their own
    loads = {r["_range"]: r["w"] for r in ranged.groupBy("_range").agg(F.sum("_w").alias("w")).collect()}
    over = [k for k, w in loads.items() if w > 2 * weight / ranges]
    if over:
        extra = _splitters(ranged.where(F.col("_range").isin(over)), sum(loads[k] for k in over),
                           2 * len(over) * (1 + int(max(loads[k] for k in over) * ranges / weight)), per_range, 2)
        bounds = sorted(set(bounds) | set(extra))
    totals = {r["_range"]: (r["s"], r["n"]) for r in
              small.groupBy(_range_of(bounds).alias("_range"))
              .agg(F.sum("_size").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    starts, ranks, s, k = [], [], 0, 0
    for i in range(len(bounds) + 1):
        starts.append(s)
        ranks.append(k)
        s, k = s + totals.get(i, (0, 0))[0], k + totals.get(i, (0, 0))[1]

    def place(df: DataFrame) -> DataFrame:
        """Shard and rank in the global key order, by running totals inside the ranges."""
        inside = Window.partitionBy("_range").orderBy("_h", "_id", "_size") \
            .rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("_range", _range_of(bounds)).withColumn("_run", F.sum("_size").over(inside)) \
            .withColumn("_n", F.count(F.lit(1)).over(inside))
        middle = F.get(_longs(starts), F.col("_range")) + F.col("_run") - F.col("_size") / 2
        return df.withColumn("shard", F.least(_position(ends, middle), F.lit(shards - 1)).cast("int")) \
            .withColumn("_rank", F.get(_longs(ranks), F.col("_range")) + F.col("_n") - 1)

    first = {r["shard"]: r["f"] for r in place(small).groupBy("shard").agg(F.min("_rank").alias("f")).collect()}
    base_slot = _longs([big_slots[k] - first.get(k, 0) for k in range(shards)])
    rest_rows = place(full.where(F.col("_size") <= big_from)).withColumn(
        "slot", F.get(base_slot, F.col("shard")) + F.col("_rank")).select("_rec.*", "shard", "slot")
    return rest_rows if out is None else out.unionByName(rest_rows)


def _deal(big: DataFrame, filled: list[int], slots: list[int]) -> DataFrame:
    """Records above the size limit, largest first, each to the emptiest shard.

    At most shards * big_share records exceed the limit.  Updates ``filled`` and ``slots``;
    returns (_h, _id, _size, _copy, shard, slot), _copy numbering equal keys.
    """
    copies: dict[tuple, int] = {}
    dealt = []
    for r in sorted(big.collect(), key=lambda r: (-r["_size"], r["_h"], r["_id"])):
        shard = min(range(len(filled)), key=lambda k: (filled[k], k))
        key = (r["_h"], r["_id"], r["_size"])
        copies[key] = copies.get(key, 0) + 1
        dealt.append((*key, copies[key], shard, slots[shard]))
        filled[shard] += r["_size"]
        slots[shard] += 1
    return big.sparkSession.createDataFrame(dealt, "_h long, _id long, _size long, _copy int, shard int, slot long")


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" for v in values) + ")")


def _room(filled: list[int], rest: int) -> list[float]:
    """Share of ``rest`` that lifts every shard to one level (none to the shards above it)."""
    order, level, used = sorted(filled), 0.0, 0
    for k in range(1, len(order) + 1):
        used += order[k - 1]
        level = (rest + used) / k
        if k == len(order) or level <= order[k]:
            break
    return [max(0.0, level - x) for x in filled]


def _position(ends: list[float], value: Column) -> Column:
    """Number of shard ends at or below ``value``: binary search in a constant array."""
    table = F.array(*[F.lit(float(e)) for e in ends])
    steps = [1 << k for k in reversed(range(len(ends).bit_length()))]

    def halve(pos, step):
        return F.when((pos + step <= len(ends))
                      & (F.get(table, F.least(pos + step, F.lit(len(ends))) - 1) <= value), pos + step).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                    carry: bool = False) -> DataFrame:
    """Place every row: id, size, text_crc32, shard, slot (and, with ``carry``, the
    input's other columns, except those named like one of these)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = {"size": text_size(text_col), "text_crc32": F.crc32(text), "_text_key": F.xxhash64(text)}
    rest = [c for c in docs.columns if carry and c != id_col and c not in made and c not in ("shard", "slot")]
    rows = docs.select(id_col, *rest, *[v.alias(k) for k, v in made.items()])
    return assign(rows, F.col("_text_key"), F.col("size"), F.col(id_col), shards).drop("_text_key")


def grown(law: str = "bytes") -> list[Column]:
    return [F.lit(law).alias("law"), F.lit(None).cast("int").alias("grown_shard")]
