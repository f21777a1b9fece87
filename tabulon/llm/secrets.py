"""Operator 3 — secret scan with corpus-wide ownership frequency.

Base secrets of three kinds are found in every whole text, and wider
candidates besides: long tokens that mix letters and digits.  The hashes of
all values are aggregated over the corpus by distinct repositories and owners.
A value that several owners share is an example that everybody copies; one
that a single owner uses, in however many repositories, looks live.  Owner-specific
candidates become spans of kind ``owned``; base spans always stay, with their
verdict beside them.

Spans are found by splitting at the matches: offsets are sums of the lengths
of the pieces before, in code points.  Hashes are counted in three steps
(value with repository, with owner, alone), each combined before its shuffle,
so a value copied into a third of all texts is no hot group; the join back
reads two written tables, which lets AQE split it.

Defined results: a null text is empty; overlapping spans of different kinds
are all listed; repeated rows are scanned alike and count as one repository;
a null owner is an owner of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.scratch import written

# The patterns of the base kinds and their least lengths, in the listed order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = "AKIA[A-Z0-9]+"
ACCESS_LENGTH = 20
HEX = "[0-9a-f]+"
HEX_LENGTH = 24
KINDS = ("assign", "access", "hex", "owned")

#: wider candidates: long runs of token characters; those with letters in both cases and digits are kept
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
MAX_OWNERS = 1  # more owners share an example


def _spans(text: Column, kind: str, pattern: str, group: int, keep, trigger: str) -> Column:
    """array<struct<start, kind_no, end, value>> of the matches that ``keep`` accepts.

    ``trigger`` is a cheap test that every text with an accepted match passes.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    no = KINDS.index(kind)
    parts = F.zip_with(F.zip_with(gaps, whole, lambda g, w: F.struct(g.alias("g"), w.alias("w"))), value,
                       lambda p, v: F.struct(F.length(p["g"]).cast("long").alias("gap"),
                                             F.length(p["w"]).cast("long").alias("size"), v.alias("v")))
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,value:string>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def step(acc, p):
        at = acc["at"] + p["gap"]
        end = at + F.coalesce(p["size"], F.lit(0))
        found = F.array(F.struct(at.alias("start"), F.lit(no).alias("kind_no"), end.alias("end"),
                                 p["v"].alias("value")))
        return F.struct(end.alias("at"), F.when(p["size"].isNotNull() & keep(p["v"]), F.concat(acc["out"], found))
                        .otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(trigger), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(empty)


def scan(docs: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column) -> DataFrame:
    """row, id, repository, owner and the candidate spans of every text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mixed = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")
    found = F.concat(
        _spans(text, "assign", ASSIGN, 2, lambda v: F.length(v) >= ASSIGN_VALUE, ASSIGN),
        _spans(text, "access", ACCESS, 0, lambda v: F.length(v) >= ACCESS_LENGTH, "AKIA"),
        _spans(text, "hex", HEX, 0, lambda v: F.length(v) >= HEX_LENGTH, f"[0-9a-f]{{{HEX_LENGTH},}}"),
        _spans(text, "owned", TOKEN, 0, mixed, TOKEN))
    # the row number is fixed by writing the table
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                               repo.cast("string").alias("repo"), owner.cast("string").alias("owner"),
                               found.alias("found")))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owners, repositories) over the corpus."""
    by_repo = candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"),
                                        F.sum("repositories").alias("repositories"))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None,
                 owner: Column | None = None) -> DataFrame:
    """One row per text: id, counts of the base kinds, base_sha256, spans, and how many of
    its spans look live or are shared examples."""
    repo = F.col(id_col) if repo is None else repo
    owner = F.col("source") if owner is None else owner
    rows = scan(docs, id_col, text_col, repo, owner)
    candidates = written(rows.where(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("s"))
                         .withColumn("hash", F.sha2(F.col("s.value").cast("binary"), 256)))
    shared = written(ownership(candidates))
    judged = candidates.join(shared, "hash").withColumn("live", F.col("owners") <= MAX_OWNERS)
    kept = judged.where((F.col("s.kind_no") < KINDS.index("owned")) | F.col("live"))
    per_row = kept.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("s.start", "s.kind_no", "s.end"))).alias("spans"),
        F.sum(F.col("live").cast("long")).alias("n_live"), F.sum((~F.col("live")).cast("long")).alias("n_example"))
    # a text without candidates has nothing to join
    none = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint>>")
    full = rows.where(F.size("found") > 0).select("row", "id").join(per_row, "row", "left").select(
        "id", F.coalesce("spans", none).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"))
    out = full.unionByName(rows.where(F.size("found") == 0).select(
        "id", none.alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example")))
    base = F.filter("spans", lambda s: s["kind_no"] < KINDS.index("owned"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long")
    return out.select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        "n_live", "n_example")
