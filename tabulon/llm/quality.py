"""Operator 7 — quality by compression with zstandard dictionaries.

Two dictionaries are trained, one on good and one on bad labelled texts.  A
text is compressed with each in blocks of ``BLOCK`` bytes, every block afresh:
behind the match window of a long frame no byte could refer to the dictionary,
and before that the text's own history takes its place.  The size difference
of all blocks, per byte, says which class the text resembles, and the smaller
of both sizes per byte tells endless repetition from prose.  A logistic fit on labelled rows that trained no
dictionary turns both into a score.

The dictionaries learn from a bounded sample: at most ``SAMPLE`` texts per
class, of at most ``SAMPLE_BYTES`` each, in the order of a hash of the id.
The calibration and the scores use every row.

Defined results: null and empty texts compress to the same few bytes with both
dictionaries and get one common score; without labels of a class its
dictionary is empty; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.calibration import fit_logistic, logistic
from tabulon.llm.langid import held_out
from tabulon.llm.scratch import broadcast_if, prepare, utf8_values

SAMPLE = 1000
SAMPLE_BYTES = 65_536
DICTIONARY = 65_536      # bytes
BLOCK = 16_384           # bytes
UNIT = 32                # bytes of text that the size difference is given for
LEVEL = 3
THRESHOLD = 0.7
MIN_TRAIN = 20           # below so many texts the dictionary is their raw content


def train_dictionary(texts: list[bytes]) -> bytes:
    if len(texts) >= MIN_TRAIN:
        try:
            return zstandard.train_dictionary(DICTIONARY, texts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:   # too little to train on
            pass
    return b"".join(texts)[:DICTIONARY]


class Compressors:
    """Compressors with the bad (0) and the good (1) dictionary."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.make = []
        for raw in dictionaries:
            data = None
            if raw:
                data = zstandard.ZstdCompressionDict(raw)
                data.precompute_compress(level=LEVEL)
            self.make.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False,
                                                      write_checksum=False, write_dict_id=False))

    def features(self, raw: bytes) -> tuple[float, float]:
        """(size difference per ``UNIT`` bytes, log of the smaller size per byte), over all blocks."""
        blocks = [raw[i:i + BLOCK] for i in range(0, max(len(raw), 1), BLOCK)]
        bad, good = (sum(len(c.compress(b)) for b in blocks) for c in self.make)
        n = max(len(raw), 1)
        return UNIT * (bad - good) / n, float(np.log(min(bad, good) / n))


def features(docs: DataFrame, dictionaries: tuple[bytes, bytes], keep: list[str], text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        tools = Compressors(shared.value)
        for batch in batches:
            made = np.array([tools.features(raw) for raw in utf8_values(batch.column(len(keep)))]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made[:, 0]), pa.array(made[:, 1])],
                                             names=[*keep, "_x", "_r"])

    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, rows.drop("_text").schema.add("_x", "double").add("_r", "double"))


def first_texts(rows: DataFrame, order: Column, id_col: str, text_col: str, k: int, n: int) -> list[bytes]:
    """The texts of the first ``k`` of ``n`` rows by ``order``, a hash.

    Every partition would send its first k texts to the driver.  The first k rows lie under a
    bound of the hash that about 2k rows meet, so only these are sent, whatever the partitions;
    where fewer than k rows meet it (repeated ids), the rows are taken without it.
    """
    share = min(1.0, 2 * k / max(n, 1))
    bounds = [order <= F.lit(int(-2 ** 63 + share * 2 ** 64))] if share < 1 else []
    for bound in [*bounds, F.lit(True)]:
        texts = [r["t"].encode("utf-8") for r in rows.where(bound).orderBy(order, id_col).limit(k)
                 .select(F.col(text_col).alias("t")).collect()]
        if len(texts) == min(k, n):
            break
    return texts


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, held_out, score, predicted, difference."""
    prepare(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(id_col).agg(F.max(label_col).alias("_label"))
    order = F.xxhash64(F.col(id_col).cast("string"))
    learnable = docs.select(id_col, text_col).where(~held_out(id_col, 4, 2)) \
        .join(broadcast_if(known, labels.count()), id_col)
    part = F.pmod(order, F.lit(2)) == 0
    fits = learnable.where(part & F.octet_length(text_col).between(8, SAMPLE_BYTES))
    sizes = {r["_label"]: r["n"] for r in fits.where(F.col("_label").isin(0, 1)).groupBy("_label")
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    dictionaries = [train_dictionary(first_texts(fits.where(F.col("_label") == c), order, id_col, text_col, sample,
                                                 sizes.get(c, 0))) for c in (0, 1)]
    pair = (dictionaries[0], dictionaries[1])
    checked = features(learnable.where(~part), pair, ["_label"], text_col)
    beta = fit_logistic(checked, ["_x", "_r"], "_label", [0.05, 0.05],
                        anchors=[(-1.0, -1.0, 0, 1.0), (1.0, -1.0, 1, 1.0)])
    out = features(docs, pair, [id_col], text_col)
    score = logistic(beta, "_x", "_r")
    return out.select(id_col, held_out(id_col, 4, 2).alias("held_out"), score.alias("score"),
                      (score >= THRESHOLD).cast("int").alias("predicted"), F.col("_x").alias("difference"))
