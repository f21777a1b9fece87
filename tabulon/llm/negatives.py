"""Operator 12 — hard-negative mining by an L2AP-style threshold join.

Anchors are matched against all rows twice: the best rows of their own label
are the positives; a positive's score opens a window of scores in which the
best rows of other labels are its hard negatives.

A task takes its rows in blocks and joins a block with the anchors by an
inverted index over dimension chunks.  Dimensions are ordered by energy, the
weakest first; a row's leading chunks are left out of the index while the norm
over them, times the anchor's norm, stays under the threshold: no pair reaches
it through them alone.  Scores are accumulated over the indexed chunks, pairs
are pruned by what the norms over the chunks left out can still add, and the
rest is scored exactly.  An anchor whose windows have an end (their lowest score,
or what they already hold) asks for it at once; for the others the threshold is
lowered, the index grows by the chunks that are no longer covered, and so on
until every window of the block is filled.

Anchors come in groups of at most ``ANCHOR_BYTES`` (a stated query set against
all rows, in blocks); a group is broadcast, and so are the scores that the
anchors' table alone already gives its windows, which is where the thresholds
end.  A task hands on at most k rows per window; they are ranked in Spark.

Defined results: rows with a null label, a null vector or a null or
non-finite component take no part; vectors of unequal length are compared as
if padded with zeros; a null id is never an anchor and comes last in ties,
which go on by label and position; repeated rows are rows of their own; an
anchor without positives, or a positive without negatives, has no rows; a
negative positive score opens no window.  Scores are exact at any size of the
components; beyond 64 bits they are given as the nearest long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.scratch import prepare, written

# Quantisation, anchors, positives and negatives wanted, the window in percent.
SCALE = 256
ANCHOR_EVERY = 50
POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)
RELABEL_EVERY, LABELS = 7, 10

ANCHOR_BYTES = 16 << 20          # of one group's vectors, as doubles
ANCHOR_BLOCK, ROW_BLOCK = 512, 2048
CHUNKS = 8                       # of dimensions
LADDER = (0.9, 0.75, 0.6, 0.45, 0.3, 0.15, -np.inf)   # thresholds, as shares of the largest possible score
SLACK = 1 + 1e-9                 # over the rounding of the norms
PAIRS = 200_000                  # put into windows at a time
EXACT = 2.0 ** 53                # integers that doubles hold


def prepared(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(row, vec_id, label, v): the rows that take part, quantised, with the labels moved on."""
    e = F.col(vector)
    fit = e.isNotNull() & F.col(label).isNotNull() & ~F.exists(
        e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    moved = F.when(F.col(id_col) % RELABEL_EVERY == 0, (F.col(label) + 1) % LABELS).otherwise(F.col(label))
    return embeddings.where(F.coalesce(fit, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
        moved.cast("long").alias("label"),
        # floor of a double as a double: it need not fit a long
        F.transform(e, lambda x: _floor(x.cast("double") * SCALE)).alias("v"))


def _floor(x):
    """Floor that stays a double (beyond 2^53 a double is whole anyway)."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


@dataclass
class Rows:
    """Rows of a batch: ids (null: NaN-free mask), labels, positions and vectors [n, dims]."""
    row: np.ndarray
    vec_id: np.ndarray
    no_id: np.ndarray
    label: np.ndarray
    v: np.ndarray

    def __len__(self) -> int:
        return len(self.row)

    def part(self, at) -> Rows:
        return Rows(self.row[at], self.vec_id[at], self.no_id[at], self.label[at], self.v[at])


def _rows(batch) -> Rows:
    """A record batch or table (row, vec_id, label, v) as arrays."""
    if isinstance(batch, pa.RecordBatch):
        batch = pa.Table.from_batches([batch])
    ids = batch["vec_id"].combine_chunks()
    lists = batch["v"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dims = int(lengths.max(initial=0))
    if (lengths == dims).all():
        v = flat.reshape(len(lengths), dims)
    else:
        v = np.zeros((len(lengths), dims))
        v[np.arange(dims) < lengths[:, None]] = flat
    return Rows(batch["row"].to_numpy(), ids.fill_null(0).to_numpy(zero_copy_only=False),
                ids.is_null().to_numpy(zero_copy_only=False), batch["label"].to_numpy(), v)


def _wide(v: np.ndarray, dims: int) -> np.ndarray:
    return v if v.shape[1] == dims else np.pad(v, ((0, 0), (0, dims - v.shape[1])))


class Found:
    """The best rows of every window so far: at most ``k`` each, best first."""

    FIELDS = ("slot", "score", "no_id", "vec_id", "label", "row")

    def __init__(self, n_slots: int, k: int, floor: np.ndarray):
        self.k, self.n_slots, self.known = k, n_slots, floor
        self.at = {f: np.zeros(0, bool if f == "no_id" else np.int64) for f in self.FIELDS}
        self.at["score"] = np.zeros(0, np.float64)
        self.floor = floor.copy()

    def add(self, **new: np.ndarray) -> None:
        """Takes rows in; ``floor`` becomes the k-th score of the windows that are full."""
        merged = {f: np.concatenate([self.at[f], new[f]]) for f in self.FIELDS}
        order = np.lexsort((merged["row"], merged["label"], merged["vec_id"], merged["no_id"], -merged["score"],
                            merged["slot"]))
        slot = merged["slot"][order]
        start = np.searchsorted(slot, slot)           # first place of the slot
        rank = np.arange(len(slot)) - start
        kept = order[rank < self.k]
        self.at = {f: merged[f][kept] for f in self.FIELDS}
        last = rank == self.k - 1
        self.floor = self.known.copy()
        self.floor[slot[last]] = np.maximum(self.floor[slot[last]], merged["score"][order][last])


@dataclass
class Windows:
    """Windows of scores: anchor (its place), low and high, as arrays over windows."""
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Block:
    """One block of rows and one of anchors: partial scores over an index that grows."""

    def __init__(self, q: np.ndarray, x: np.ndarray):
        order = np.argsort((x * x).sum(axis=0), kind="stable")   # weak dimensions first: they are left out longest
        self.q, self.x = np.ascontiguousarray(q[:, order]), np.ascontiguousarray(x[:, order])
        self.cuts = np.linspace(0, x.shape[1], min(CHUNKS, max(x.shape[1], 1)) + 1).astype(int)
        self.q_norm, self.x_norm = self._norms(self.q), self._norms(self.x)   # over the first c chunks
        n = len(self.cuts) - 1
        self.left_out = np.full(len(x), n)
        self.partial = np.zeros((len(x), len(q)))   # by row, as rows leave out chunks
        self.seen = np.zeros((len(x), len(q)), dtype=bool)

    def _norms(self, m: np.ndarray) -> np.ndarray:
        squares = np.add.reduceat(np.pad(m * m, ((0, 0), (0, 1))), self.cuts, axis=1)[:, :-1] if m.shape[1] \
            else np.zeros((len(m), len(self.cuts) - 1))
        return np.sqrt(np.concatenate([np.zeros((len(m), 1)), np.cumsum(squares, axis=1)], axis=1)) * SLACK

    def lower(self, share: float) -> None:
        """Indexes the chunks that norms no longer cover when scores reach ``share`` of an anchor's norm."""
        covered = (self.x_norm < share).sum(axis=1) - 1 if share > 0 else np.zeros(len(self.x), dtype=int)
        covered = np.clip(covered, 0, self.left_out)
        steps = np.stack([covered, self.left_out], axis=1)
        for new, old in np.unique(steps[covered < self.left_out], axis=0):   # rows that add the same chunks
            rows = np.flatnonzero((covered == new) & (self.left_out == old))
            part = slice(self.cuts[new], self.cuts[old])
            self.partial[rows] += self.x[rows, part] @ self.q[:, part].T
        self.left_out = covered

    def reach(self, limit: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New pairs (anchor, row, exact score) of those that ``fit`` (by anchor) whose score may reach the anchor's
        limit."""
        most = self.q_norm.T[self.left_out]
        most *= self.x_norm[np.arange(len(self.x)), self.left_out][:, None]
        most += self.partial
        r, a = np.nonzero((most >= limit) & fit.T & ~self.seen)
        self.seen[r, a] = True
        # what the index left out, by chunk: the rows of a chunk are those that still miss it
        score = self.partial[r, a]
        for c in range(len(self.cuts) - 1):
            at = np.flatnonzero(self.left_out[r] > c)
            if len(at):
                part = slice(self.cuts[c], self.cuts[c + 1])
                score[at] += np.einsum("ij,ij->i", self.q[a[at], part], self.x[r[at], part])
        return a, r, score


def _exactly(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products beyond doubles, nearest long."""
    whole = np.vectorize(int, otypes=[object])
    got = whole(q) @ whole(x).T if q.size and x.size else np.zeros((len(q), len(x)), dtype=object)
    return np.vectorize(lambda s: min(max(s, -2 ** 63), 2 ** 63 - 1), otypes=[object])(got) if got.size else got


def match(anchors: Rows, windows: Windows, rows: Rows, found: Found, same: bool) -> None:
    """Adds to ``found`` the best of ``rows`` in every window, for rows of the same or of other labels."""
    dims = max(anchors.v.shape[1], rows.v.shape[1])
    q_all, x_all = _wide(anchors.v, dims), _wide(rows.v, dims)
    largest = np.abs(q_all).max(initial=0) * np.abs(x_all).max(initial=0) * max(dims, 1)
    for start in range(0, len(anchors), ANCHOR_BLOCK):
        own = np.flatnonzero((windows.anchor >= start) & (windows.anchor < start + ANCHOR_BLOCK))
        if not len(own):
            continue
        part = slice(start, min(start + ANCHOR_BLOCK, len(anchors)))
        fit = (rows.label[:, None] == anchors.label[None, part]) == same
        fit &= rows.row[:, None] != anchors.row[None, part]
        if largest >= EXACT:
            scores = _exactly(q_all[part], x_all)
            a, r = np.nonzero(fit.T)
            _take(found, windows, own, start, a, r, scores[a, r], rows)
            continue
        block = Block(q_all[part], x_all)
        q_norm, top = block.q_norm[:, -1], block.x_norm[:, -1].max(initial=0)
        open_ = own
        for rung in LADDER:
            share = rung * top
            goal = np.full(len(q_norm), np.inf)    # a window asks for nothing under its end or what it holds
            np.minimum.at(goal, windows.anchor[open_] - start, np.maximum(windows.low[open_], found.floor[open_]))
            # an anchor whose windows all have an end asks for it at once: the ladder is for those that have none
            limit = np.where(np.isinf(goal) & (goal < 0) & np.isfinite(share), share * q_norm, goal)
            asked = np.isfinite(limit) | (limit == -np.inf)
            if not asked.any():
                break
            norms = np.where(q_norm > 0, q_norm, 1.0)
            block.lower(float(np.min(np.where(asked & (q_norm > 0), limit / norms, np.inf), initial=np.inf))
                        if (q_norm[asked] > 0).any() else -np.inf)
            a, r, score = block.reach(limit, fit.T)
            for p in range(0, len(a), PAIRS):   # what a part fills raises the ends for the next
                _take(found, windows, own, start, a[p:p + PAIRS], r[p:p + PAIRS], score[p:p + PAIRS], rows)
            # full windows, and those whose end has been reached, are settled for this block
            end = np.maximum(windows.low[open_], found.floor[open_])
            open_ = open_[limit[windows.anchor[open_] - start] > end]


def _take(found: Found, windows: Windows, own: np.ndarray, start: int, a: np.ndarray, r: np.ndarray,
          score: np.ndarray, rows: Rows) -> None:
    """Puts scored pairs into the windows ``own`` of their anchors."""
    if not len(a):
        return
    order = np.argsort(a, kind="stable")
    a, r, score = a[order], r[order], score[order]
    first = np.searchsorted(a, windows.anchor[own] - start, "left")
    count = np.searchsorted(a, windows.anchor[own] - start, "right") - first
    slot = np.repeat(own, count)
    at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    s = score[at]
    inside = ((s >= np.maximum(windows.low[slot], found.floor[slot])) & (s <= windows.high[slot])).astype(bool)
    slot, at = slot[inside], r[at[inside]]
    found.add(slot=slot, score=s[inside], no_id=rows.no_id[at], vec_id=rows.vec_id[at], label=rows.label[at],
              row=rows.row[at])


def _search(rows: DataFrame, shared, k: int, same: bool) -> DataFrame:
    """(slot, score, vec_id, label, row): at most ``k`` rows per task and window."""
    def run(batches):
        anchors, windows, floor = shared.value
        found = Found(len(windows.anchor), k, floor)
        for batch in batches:
            whole = _rows(batch)
            for start in range(0, len(whole), ROW_BLOCK):
                match(anchors, windows, whole.part(slice(start, start + ROW_BLOCK)), found, same)
        at = found.at
        if len(at["slot"]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(at["slot"], pa.int64()), pa.array([int(s) for s in at["score"]], pa.int64()),
                 pa.array(at["vec_id"], pa.int64(), mask=at["no_id"]), pa.array(at["label"], pa.int64()),
                 pa.array(at["row"], pa.int64())], names=["slot", "score", "vec_id", "label", "row"])

    got = rows.mapInArrow(run, "slot long, score long, vec_id long, label long, row long")
    best = Window.partitionBy("slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "label", "row")
    return got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _best(rows: DataFrame, seeds: DataFrame, anchors: Rows, windows: Windows, k: int, same: bool) -> DataFrame:
    """The ``k`` best rows of every window; the anchors' own table gives the scores to start from."""
    sc = rows.sparkSession.sparkContext
    floor = np.full(len(windows.anchor), -np.inf)
    known = _search(seeds, sc.broadcast((anchors, windows, floor)), k, same).where(F.col("rank") == k)
    for r in known.select("slot", "score").collect():   # one score per window of the group
        floor[r["slot"]] = r["score"]
    return written(_search(rows, sc.broadcast((anchors, windows, floor)), k, same))


def mine(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
         anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
         window: tuple[int, int] = WINDOW, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (see above)."""
    spark = prepare(embeddings.sparkSession)
    rows = written(prepared(embeddings, id_col, vector, label))
    seeds = written(rows.where(F.col("vec_id") % anchor_every == 0))
    n, size = seeds.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v") + 8), F.lit(0)) * 8).first()
    groups = max(1, -(-size // anchor_bytes))
    parts = []
    for g in range(groups if n else 0):
        own = seeds.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g)   # a bounded group of anchors
        anchors = _rows(own.toArrow())
        if not len(anchors):
            continue
        every = np.arange(len(anchors))
        open_end = Windows(every, np.full(len(anchors), -np.inf), np.full(len(anchors), np.inf))
        best = _best(rows, seeds, anchors, open_end, positives, True)
        pos = best.where("score >= 0").select("slot", "score", "vec_id", "rank").toArrow()
        place, score = pos["slot"].to_numpy(), pos["score"].to_pylist()
        low = [-(-window[0] * s // 100) for s in score]
        high = [window[1] * s // 100 for s in score]
        narrow = Windows(place, np.array(low, dtype=np.float64), np.array(high, dtype=np.float64))
        names = pa.table({"slot": pa.array(np.arange(len(place)), pa.int64()),
                          "anchor_id": pa.array(anchors.vec_id[place], pa.int64()), "positive_id": pos["vec_id"],
                          "positive_score": pos["score"]})
        if not len(place):
            continue
        hard = _best(rows, seeds, anchors, narrow, negatives, False)
        named = hard.join(F.broadcast(spark.createDataFrame(names)), "slot")   # the group's positives
        parts.append(written(named.select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"))))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
