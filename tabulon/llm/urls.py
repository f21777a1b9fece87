"""Operator 2 — URL filter by a character language-model ratio.

Host and path rules decide first.  The URLs they decide teach two smoothed
variable-order Markov models over characters, one of accepted and one of
rejected URLs: contexts of up to ``ORDER - 1`` characters, each order
interpolated with the next shorter one by Witten-Bell weights.  URLs without a
rule are judged by the difference of the two log-likelihoods, normalised by
length, against a threshold calibrated on rule-decided URLs that trained
nothing.

Everything is DataFrame work.  The models are tables of distinct n-grams;
joins between orders run on n-grams (no hot keys), and only the last join, of
URL positions with their n-gram's score, sees frequent n-grams: the score
table is broadcast while its counted size allows, else AQE splits the keys.

Defined results: a null url and one without ``://`` have empty host and path
and no rule; a url without characters has ratio 0; without accepted or
rejected examples every undecided URL is allowed; repeated URLs are judged
once and alike; html and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.scratch import broadcast_if, written

# The rules (host, path, verdict); a rule fits its host and all subdomains.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

ORDER = 5
ALPHABET = 256.0         # the uniform base of the shortest order
CALIBRATION = 5          # one decided URL in so many calibrates
PIECE = 64               # positions of a URL handled in one row
SCORE_ROWS = 500_000     # n-grams of the score table that may be broadcast

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    found = F.coalesce(at > 0, F.lit(False))
    return (F.when(found, F.translate(host, _UPPER, _LOWER)).otherwise(F.lit("")),
            F.when(found, path).otherwise(F.lit("")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _positions(urls: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per character with the n-gram of ``ORDER`` characters that ends there.

    Long URLs are cut into pieces first, so a row never grows into more than PIECE rows at once.
    """
    padded = F.concat(F.lit("\u0002" * (ORDER - 1)), F.translate("url", _UPPER, _LOWER), F.lit("\u0003"))
    pieces = F.sequence(F.lit(0), F.length("url"), F.lit(PIECE))
    cut = urls.where(F.length("url") > 0).withColumn("_at", F.explode(pieces)) \
        .withColumn("_part", F.substr(padded, F.col("_at") + 1, F.lit(PIECE + ORDER - 1)))
    return cut.withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("_part") - (ORDER - 1)))) \
        .select(*keep, F.substr("_part", F.col("_i"), F.lit(ORDER)).alias("gram"))


def model(examples: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, diff): log P(last char | rest, accepted) - log P(... rejected) of every wanted n-gram.

    ``examples`` has url, accepted (0/1) and copies; ``wanted`` has distinct n-grams of length ORDER.
    """
    counted = _positions(examples, ["accepted", "copies"]).groupBy("gram").agg(
        F.sum(F.when(F.col("accepted") == 1, F.col("copies")).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col("accepted") == 0, F.col("copies")).otherwise(0)).alias("n0"))
    counted = written(counted)
    need = written(wanted)
    lower = None
    for k in range(1, ORDER + 1):
        tail = F.substr("gram", F.lit(ORDER - k + 1), F.lit(k))
        grams = counted.groupBy(tail.alias("g")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        grams = grams.withColumn("ctx", F.substr("g", F.lit(1), F.lit(k - 1)))
        # a context's total and its number of different continuations, by class
        ctx = grams.groupBy("ctx").agg(
            *[F.sum(f"n{c}").alias(f"all{c}") for c in (1, 0)],
            *[F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"kinds{c}") for c in (1, 0)])
        level = need.select(tail.alias("g")).distinct() \
            .withColumn("ctx", F.substr("g", F.lit(1), F.lit(k - 1))).withColumn("low", F.substr("g", F.lit(2)))
        level = level.join(grams.drop("ctx"), "g", "left").join(ctx, "ctx", "left")
        if lower is None:
            level = level.withColumn("q1", F.lit(1 / ALPHABET)).withColumn("q0", F.lit(1 / ALPHABET))
        else:
            level = level.join(lower, "low")
        p = {}
        for c in (1, 0):
            n, total, kinds = (F.coalesce(F.col(f"{x}{c}"), F.lit(0)) for x in ("n", "all", "kinds"))
            p[c] = F.when(total > 0, (n + kinds * F.col(f"q{c}")) / (total + kinds)).otherwise(F.col(f"q{c}"))
        lower = written(level.select("g", p[1].alias("q1"), p[0].alias("q0"))).withColumnRenamed("g", "low")
    return written(lower.select(F.col("low").alias("gram"), (F.log("q1") - F.log("q0")).alias("diff")))


def ratios(urls: DataFrame, scores: DataFrame) -> DataFrame:
    """(url, ratio) per distinct URL: the length-normalised log-likelihood difference."""
    return _positions(urls, ["url"]).join(broadcast_if(scores, scores.count(), SCORE_ROWS), "gram") \
        .groupBy("url").agg(F.avg("diff").alias("ratio"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
          rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, ratio."""
    host, path = split_url(F.col(url_col))
    seen = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), host.alias("host"),
                        path.alias("path"))
    seen = seen.withColumn("_fit", rule_of(F.col("host"), F.col("path"), rules)) \
        .select("_id", "url", "host", "path", "_fit.rule", "_fit.verdict")
    urls = written(seen.where("url IS NOT NULL").groupBy("url").agg(
        F.first("verdict").alias("verdict"), F.count(F.lit(1)).alias("copies")))
    decided = urls.where("verdict IS NOT NULL").withColumn("accepted", (F.col("verdict") == "allow").cast("int"))
    aside = F.pmod(F.xxhash64("url"), F.lit(CALIBRATION)) == 0
    # several pages of a URL are one example
    examples = decided.where(~aside).withColumn("copies", F.lit(1).cast("long"))
    judged = urls.where("verdict IS NULL").select("url").unionByName(decided.where(aside).select("url"))
    scores = model(examples, _positions(judged, []).distinct())
    found = written(ratios(judged, scores).join(urls.select("url", "verdict"), "url"))
    s = found.groupBy("verdict").agg(F.avg("ratio").alias("m"), F.coalesce(F.stddev_pop("ratio"), F.lit(0.0))
                                     .alias("s")).where("verdict IS NOT NULL").collect()
    side = {r["verdict"]: (r["m"], r["s"]) for r in s}
    if "allow" in side and "block" in side:
        (m1, s1), (m0, s0) = side["allow"], side["block"]
        # the point that lies equally many deviations from either class
        limit = (m1 * (s0 + 1e-9) + m0 * (s1 + 1e-9)) / (s0 + s1 + 2e-9)
    else:
        limit = float("-inf")
    taught = decided.where(~aside).groupBy().agg(F.min("accepted").alias("a"), F.max("accepted").alias("b")).first()
    if taught["a"] is None or taught["a"] == taught["b"]:
        limit = float("-inf")
    ratio = found.select(F.col("url").alias("_u"), "ratio")
    out = seen.join(ratio, F.col("url") == F.col("_u"), "left")
    own = F.when(F.coalesce("ratio", F.lit(0.0)) >= F.lit(limit), "allow").otherwise("block")
    # without characters there is no evidence against a URL
    own = F.when(F.col("ratio").isNull(), "allow").otherwise(own)
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule",
                      F.coalesce("verdict", own).alias("verdict"), "ratio")
