"""Operator 8 — benchmark decontamination with a generalised suffix automaton.

All items are normalised to words and fed into one word-level suffix automaton
(built once on the driver, broadcast).  Training documents stream through it
word by word; the automaton reports the longest suffix read so far that occurs
in some item.  A match of ``window`` words or more marks its words as hit, as
does a whole item shorter than the window.  Marked spans can be cut out, and
documents above a coverage limit dropped.

The automaton's size is bounded: items are grouped so that one automaton holds
at most ``MAX_ITEM_WORDS`` words; more items take more passes over the
documents, whose hits are united.

Defined results: null and wordless texts have no words and no hits; a null or
wordless item matches nothing; rows sharing an item id count as one item, and
so do rows without an id, which has no place in the list of ids;
repeated documents are judged alike; empty tables give no hits or no rows;
extra columns are carried by ``remove_spans`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.scratch import WORD_BYTES, prepare, utf8_values, words_of

WINDOW = 10
MAX_ITEM_WORDS = 1_000_000


class SuffixAutomaton:
    """Generalised suffix automaton over word ids; ``add`` one item at a time."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.ends: list[list[int]] = [[]]   # items that have an occurrence ending in this state

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The part of state q whose strings have length up to len(p) + 1, as a state."""
        clone = self._state(self.len[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, item: int, ids: list[int]) -> None:
        last = 0
        for c in ids:
            q = self.next[last].get(c)
            if q is not None:   # the word extends a known string: no new state, or a split one
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
            else:
                cur, p = self._state(self.len[last] + 1), last
                while p != -1 and c not in self.next[p]:
                    self.next[p][c] = cur
                    p = self.link[p]
                if p != -1:
                    q = self.next[p][c]
                    self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
                last = cur
            self.ends[last].append(item)


class Matcher:
    """Automaton, vocabulary and per-state answers, ready to stream documents."""

    def __init__(self, items: list[list[bytes]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        sam = SuffixAutomaton()
        lengths = []
        for k, words in enumerate(items):
            sam.add(k, [self.vocab.setdefault(w, len(self.vocab)) for w in words])
            lengths.append(len(words))
        self.next, self.link, self.len = sam.next, sam.link, sam.len
        order = sorted(range(len(sam.len)), key=sam.len.__getitem__)
        # the state that holds a match's last `window` words, and the short items that end a state's strings
        self.at_window = [-1] * len(order)
        self.short: list[tuple] = [()] * len(order)
        for v in order[1:]:
            up = self.link[v]
            self.at_window[v] = v if self.len[up] < window <= self.len[v] else self.at_window[up]
            own = {(lengths[k], k) for k in sam.ends[v] if lengths[k] < window
                   and self.len[up] < lengths[k] <= self.len[v]}
            self.short[v] = self.short[up] + tuple(sorted(own))
        self.items_at: dict[int, set[int]] = {}
        for v in reversed(order[1:]):   # occurrences of a state are those of its link children too
            found = self.items_at.setdefault(v, set())
            found.update(sam.ends[v])
            if self.len[self.link[v]] >= window:
                self.items_at.setdefault(self.link[v], set()).update(found)
        self.items_at = {v: frozenset(s) for v, s in self.items_at.items() if self.at_window[v] == v}
        # nothing shorter than this run of vocabulary words can hold a window
        self.least = min([window, *lengths]) if lengths else window

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [start, end) in words, merged, and the items whose windows occur."""
        n = len(words)
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), dtype=np.int32, count=n)
        # words outside the vocabulary send the automaton back to its start: stream the runs between them
        inside = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0])).astype(np.int8)))
        spans: list[list[int]] = []
        items: set[int] = set()
        for a, b in zip(inside[::2].tolist(), inside[1::2].tolist(), strict=True):
            if b - a >= self.least:
                self._stream(ids[a:b].tolist(), a, spans, items)
        return [(a, b) for a, b in spans], items

    def _stream(self, ids: list[int], offset: int, spans: list[list[int]], items: set[int]) -> None:
        nxt, link, length = self.next, self.link, self.len
        state = matched = 0
        for i, c in enumerate(ids, offset + 1):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            long = matched if matched >= self.window else 0
            if long:
                items |= self.items_at[self.at_window[state]]
            for size, item in self.short[state]:
                if size <= matched:
                    items.add(item)
                    long = max(long, size)
            if long:
                start = i - long
                while spans and spans[-1][1] >= start:   # touching spans merge
                    start = min(start, spans.pop()[0])
                spans.append([start, i])


def _groups(items: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[dict]:
    """Items with words, by id, in groups of at most ``limit`` words (streamed to the driver)."""
    group, size = {}, 0
    rows = items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")) \
        .where("t IS NOT NULL").distinct().orderBy("i", "t")
    for k, r in enumerate(rows.toLocalIterator()):
        words = words_of(r["t"].encode("utf-8"))
        if words:
            if size and size + len(words) > limit:
                yield group
                group, size = {}, 0
            group[r["i"], k] = words
            size += len(words)
    yield group


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(rows: DataFrame, matcher, names, last: bool, cut: bool) -> DataFrame:
    """One pass over ``rows`` (kept columns, [_prior,] _text): adds _n_words, _hits
    (merged [start, end) word spans), _items and, with ``cut``, the text without the hits."""
    prior = "_prior" in rows.columns
    keep = [c for c in rows.columns if c != "_prior" and not (last and c == "_text")]

    def run(batches):
        m, ids = matcher.value, names.value
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            before = column["_prior"].to_pylist() if prior else repeat(None)
            n_words, hits, items, texts = [], [], [], []
            for raw, old in zip(utf8_values(column["_text"]), before):  # noqa: B905 (repeat is endless)
                words = words_of(raw)
                spans, found = m.hits(words) if m else ([], ())
                found = {ids[k] for k in found}
                if old:
                    spans = merge([*spans, *((s["start"], s["end"]) for s in old["_hits"])])
                    found.update(old["_items"])
                n_words.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in spans])
                items.append(sorted(found, key=lambda i: (i is None, i or "")))
                if cut:
                    texts.append(cut_words(raw, spans).decode("utf-8") if spans else raw.decode("utf-8"))
            made = [pa.array(n_words, pa.int64()), pa.array(hits, _SPANS), pa.array(items, pa.list_(pa.string()))]
            labels = [*keep, "_n_words", "_hits", "_items"]
            if cut:
                made.append(pa.array(texts, pa.string()))
                labels.append("_cut")
            yield pa.RecordBatch.from_arrays([*[column[c] for c in keep], *made], names=labels)

    schema = rows.select(*keep).schema.add("_n_words", "long") \
        .add("_hits", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))) \
        .add("_items", T.ArrayType(T.StringType()))
    return rows.mapInArrow(run, schema.add("_cut", "string") if cut else schema)


def find_hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text",
              item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
              max_item_words: int = MAX_ITEM_WORDS, cut: bool = False) -> DataFrame:
    """The ``keep`` columns plus _n_words, _hits, _items (and _cut) of every row of ``docs``."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    groups = _groups(benchmark, item_col, item_text, max_item_words)
    group = next(groups)
    while True:
        later = next(groups, None)
        names = spark.sparkContext.broadcast([i for i, _ in group])
        matcher = spark.sparkContext.broadcast(Matcher(list(group.values()), window) if group else None)
        rows = _scan(rows, matcher, names, later is None, cut and later is None)
        if later is None:
            return rows
        group = later
        rows = rows.select(*keep, F.struct("_hits", "_items").alias("_prior"), "_text")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Touching or overlapping [start, end) spans united, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def n_hit():
    return F.aggregate("_hits", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          window: int = WINDOW, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_hits(docs, benchmark, [id_col], text_col, window=window, max_item_words=max_item_words)
    return found.select(
        id_col, F.col("_n_words").alias("n_words"), n_hit().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_hits") > 0).alias("contaminated"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW,
                 max_coverage: float = 0.5) -> DataFrame:
    """Documents with the hit spans cut out; those with more than ``max_coverage`` of
    their words hit are dropped.  Untouched documents keep their text byte for byte."""
    # the record travels without its text, which comes back as _cut
    rest = [c for c in docs.columns if c != text_col]
    rec = docs.select(F.struct(*rest).alias("_rec") if rest else F.struct(F.lit(0)).alias("_rec"),
                      F.col(text_col).alias("_doc_text"), F.col(text_col).isNull().alias("_null"))
    found = find_hits(rec, benchmark, ["_rec", "_null"], "_doc_text", window=window, cut=True)
    kept = found.where(n_hit() <= F.lit(max_coverage) * F.col("_n_words"))
    text = F.when(~F.col("_null"), F.col("_cut"))
    return kept.select(*[
        text.alias(c) if c == text_col
        else F.when(F.size("_hits") > 0, F.length("_cut").cast(docs.schema[c].dataType))
        .otherwise(F.col("_rec.n_chars")).alias(c) if c == "n_chars"
        else F.col(f"_rec.`{c}`").alias(c) for c in docs.columns])


def cut_words(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``raw`` without the words of ``spans`` (word numbers), from each span's first byte to its last."""
    flat = np.frombuffer(raw.translate(WORD_BYTES), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flat, [0])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]])
