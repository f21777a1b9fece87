"""Operator 1 — mixing sources to target weights.

The words of every source are packed into blocks of a fixed length.  The mix
is a sequence of slots, cut into output shards; a pseudorandom permutation of
all slots deals the sources out, so the source counts of a shard are a
multinomial draw conditioned on the corpus quotas (a draw without
replacement): every source meets its target, not only in expectation.  The
j-th slot of a source takes block ``permute(j mod n)`` of pass ``j div n`` —
a keyed permutation of the source's block numbers, so a pass takes every block
once — and slots are joined to blocks by block number.

Packing needs a running total per source.  A source may own any share of the
rows, so its documents are hashed into lanes (about the square root of its
document count in each); blocks are packed inside lanes and numbered through.

Defined results: a null text has no words, a null source is a source of its
own (last); documents without words are never taken; repeated rows are
separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.scratch import broadcast_if, written

# A word, the repeating source weights, the budget and the cap of a source.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_REPEAT = 2.0

BLOCK = 64            # words in a block
SHARD_SLOTS = 4096    # blocks in an output shard
MIN_LANE = 128        # documents in a lane, at least
ROUNDS = 12           # of the permutation
SLOT_CHUNK = 8192     # slots made from one row
SLOTS_PER_TASK = 1_000_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def permute(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """Swap-or-not permutation of [0, n): a bijection for every n and key, in plain arithmetic."""
    def one(pos, r):
        mirror = F.pmod(F.pmod(F.xxhash64(*key, r, F.lit("k")), n) - pos, n)
        swap = F.xxhash64(*key, r, F.greatest(pos, mirror)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirror).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), x, one)


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = MAX_REPEAT) -> DataFrame:
    """Water-filling over (source, size): shares by weight, none above ``cap`` times its size.

    One row per source: it is sorted by the weight at which its cap binds; the
    sources before the level are capped, the others share what is left.
    """
    ranked = sizes.withColumn("source_id", (F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("w", F.get(table, F.col("source_id") % len(weights))) \
        .withColumn("cap", F.col("size") * F.lit(cap))
    by_bind = Window.orderBy(F.col("cap") / F.col("w"), "source_id")
    before = by_bind.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(budget) * F.sum("size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / \
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    bound = ranked.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    # the level of the first source that is not capped holds for all that are not
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), "source_id", "level"))) \
        .over(everything)["level"]
    return bound.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(
        F.least(F.col("cap"), free * F.col("w")))).select("source", "source_id", "size", "n_docs", "target")


@dataclass
class Mix:
    """documents: the input's record, its place and size; sources: quotas; pieces: parts of
    blocks by document; slots: the mix, one row per taken block, with its output shard."""
    documents: DataFrame
    sources: DataFrame
    pieces: DataFrame
    slots: DataFrame

    def taken_pieces(self) -> DataFrame:
        """Slots joined to blocks by block number: every piece of text the mix takes, once per time."""
        # both sides grow with the corpus: never broadcast (the planner takes exploded rows for few)
        return self.slots.join(self.pieces.drop("source_id").hint("merge"), "block")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> Mix:
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
                                word_count(text_col).alias("size")))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_docs")))
    sources = written(sources.withColumn(
        "lanes", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.greatest(
            F.lit(float(MIN_LANE)), F.sqrt("n_docs")))).cast("long")))
    n_sources = sources.count()
    place = broadcast_if(sources.select(F.col("source").alias("_s"), "source_id", "lanes"), n_sources)
    lane = Window.partitionBy("source_id", "lane")
    upto = lane.orderBy(F.col("doc_id").asc_nulls_last(), "text_key", "size") \
        .rowsBetween(Window.unboundedPreceding, 0)
    documents = written(
        sized.join(place, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("lane", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_key"), F.col("lanes")))
        .withColumn("end", F.sum("size").over(upto)).withColumn("nth", F.count(F.lit(1)).over(upto))
        .withColumn("start", F.col("end") - F.col("size"))
        .select("doc_id", "text_key", "source_id", "lane", "nth", "size", "start"))
    # blocks are numbered through: by source, lane and place in the lane
    lanes = documents.groupBy("source_id", "lane").agg(
        F.ceil(F.sum("size") / F.lit(block)).cast("long").alias("n"))
    in_source = Window.partitionBy("source_id").orderBy("lane").rowsBetween(Window.unboundedPreceding, 0)
    lanes = written(lanes.withColumn("lane_start", F.sum("n").over(in_source) - F.col("n")))
    blocks = lanes.groupBy("source_id").agg(F.sum("n").alias("n_blocks"))
    by_source = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0)
    quota = F.round(F.col("target") * F.col("n_blocks") / F.greatest(F.col("size"), F.lit(1))).cast("long")
    plan = written(sources.join(blocks, "source_id").withColumn("n_slots", quota)
                   .withColumn("first_block", F.sum("n_blocks").over(by_source) - F.col("n_blocks"))
                   .withColumn("first_slot", F.sum("n_slots").over(by_source) - F.col("n_slots")))
    total = plan.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    firsts = broadcast_if(plan.select("source_id", "first_block"), n_sources)
    low, high = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = (documents.where("size > 0").join(lanes.select("source_id", "lane", "lane_start"), ["source_id", "lane"])
              .join(firsts, "source_id")
              .withColumn("at", F.explode(F.sequence(low, high)))
              .withColumn("from", F.greatest(F.lit(0), F.col("at") * block - F.col("start")))
              .withColumn("to", F.least(F.col("size"), (F.col("at") + 1) * block - F.col("start")))
              .select((F.col("first_block") + F.col("lane_start") + F.col("at")).alias("block"),
                      "source_id", "lane", "nth", "from", "to"))
    chunks = plan.where("n_slots > 0").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1, F.lit(SLOT_CHUNK).cast("long"))))
    # a fixed number of partitions: the few small rows grow by the explode, which AQE cannot foresee
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SLOTS_PER_TASK + 1)
    spread = chunks.repartition(parts, "source_id", "chunk")
    j = F.col("j")
    slots = (spread.withColumn("j", F.explode(F.sequence(
        F.col("chunk"), F.least(F.col("chunk") + SLOT_CHUNK, F.col("n_slots")) - 1)))
        .withColumn("epoch", F.floor(j / F.col("n_blocks")).cast("int"))
        .withColumn("nth_block", permute(F.pmod(j, F.col("n_blocks")), F.col("n_blocks"),
                                         F.lit(seed), F.col("source_id"), F.col("epoch")))
        .withColumn("position", permute(F.col("first_slot") + j, F.lit(max(total, 1)).cast("long"), F.lit(seed + 1)))
        .select(F.floor(F.col("position") / shard_slots).alias("shard"),
                F.pmod("position", F.lit(shard_slots)).alias("slot"), "source_id", "epoch",
                (F.col("first_block") + F.col("nth_block")).alias("block")))
    return Mix(documents, plan, pieces, slots)


def taken(m: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted), per input row."""
    per_doc = m.taken_pieces().groupBy("source_id", "lane", "nth").agg(
        F.sum(F.col("to") - F.col("from")).alias("taken"))
    src = m.sources.select("source_id", F.col("size").alias("source_size"), "target")
    docs = m.documents.join(per_doc, ["source_id", "lane", "nth"], "left")
    return docs.join(broadcast_if(src, m.sources.count()), "source_id").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, m: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix as rows of ``docs``: one row per document and pass that takes any of its words.

    A pass that takes the whole document keeps its text; otherwise the taken
    words are joined by single blanks, in their order.  Rows are found again by
    id and text hash; rows that repeat both each stand for their own place.
    """
    parts = m.taken_pieces().groupBy("source_id", "lane", "nth", "epoch").agg(
        F.array_sort(F.collect_list(F.struct("from", "to"))).alias("parts"),
        F.sum(F.col("to") - F.col("from")).alias("n"))
    same = Window.partitionBy("doc_id", "text_key").orderBy("source_id", "lane", "nth")
    place = m.documents.withColumn("copy", F.row_number().over(same))
    chosen = written(parts.join(place, ["source_id", "lane", "nth"]).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("copy").alias("_copy"),
        F.when(F.col("n") < F.col("size"), F.col("parts")).alias("_parts")))
    copies = chosen.agg(F.max("_copy")).first()[0]
    rec = docs.select(F.struct("*").alias("_rec"), F.col(id_col).alias("_id2"),
                      F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key2"))
    on = F.col("_id2").eqNullSafe(F.col("_id")) & (F.col("_key2") == F.col("_key"))
    if copies and copies > 1:   # only then must rows that agree in both be told apart
        rec = rec.withColumn("_copy2", F.row_number().over(Window.partitionBy("_id2", "_key2").orderBy(F.lit(0))))
        on = on & (F.col("_copy2") == F.col("_copy"))
    joined = rec.join(chosen.hint("merge"), on)   # the places grow with the documents: one way at every size
    words = F.regexp_extract_all(F.col(f"_rec.`{text_col}`"), F.lit(WORD), F.lit(0))

    def pieces_of(w):
        return F.array_join(F.flatten(F.transform(F.col("_parts"), lambda p: F.slice(
            w, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")))), " ")

    # bound as a lambda's argument, the words are split once for all pieces of a text
    cut = F.get(F.transform(F.array(words), pieces_of), F.lit(0))
    out = joined.withColumn("_text", F.when(F.col("_parts").isNull(), F.col(f"_rec.`{text_col}`")).otherwise(cut))
    cols = [F.col("_text").alias(c) if c == text_col
            else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
            else F.col(f"_rec.`{c}`").alias(c) for c in docs.columns]
    return out.select(*cols)
