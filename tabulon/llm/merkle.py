"""Operator 11 — Merkle dataset manifest as a SHA-256 midstate tree.

Every record is a leaf; ``arity`` consecutive nodes become their parent, the
SHA-256 of the children's hex digests.  A digest is exactly one block of
SHA-256, so the hash state before each child slot is eight words: a parent
retains one copy per slot.  Folding a leaf back to the root resumes, on every
level, the state before the leaf's slot with the replacement and absorbs the
right siblings only; what lies to the left is in the state.

The tree grows in subtrees of ``levels`` levels: nodes are numbered inside
their group by a range partitioning, ``arity ** levels`` consecutive ones form
a block, and a task climbs whole blocks at once over numpy arrays.  The roots
of the blocks are the nodes of the next round (1/256 of the rows), so neither
a group with most rows nor the whole tree meets in one task.  The manifest is
the list of written block tables: node digests and retained states.  Paths run
down the same tables; a block receives the path above it once.

Defined results: null fields are hashed as ``-``; a null group is a group of
its own, first; null ids come first in their group, equal ids by leaf digest,
repeated rows are leaves of their own; an empty table has no rows and no root;
columns that are not hashed are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.scratch import broadcast_if, prepare, written

ARITY = 2
LEVELS = 8                 # of a subtree that one task climbs: 256 nodes in a block
BROADCAST_PATHS = 4096     # paths (a few KB each) that may be broadcast
STEP = 64                  # blocks whose nodes are hashed together


# --- SHA-256 with its state in hand (FIPS 180-4), over arrays of messages --------------------

def _root_bits(n: int, cube: bool) -> int:
    """The first 32 bits of the fractional part of the square or cube root of ``n``."""
    if not cube:
        return isqrt(n << 64) & 0xFFFFFFFF
    x, low, high = n << 96, 0, 1 << 40
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (mid, high) if mid ** 3 <= x else (low, mid)
    return low & 0xFFFFFFFF


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]
_K = [np.uint32(_root_bits(p, True)) for p in _PRIMES]
_START = np.array([_root_bits(p, False) for p in _PRIMES[:8]], dtype=np.uint32)


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x >> np.uint32(r)) | (x << np.uint32(32 - r))


def start_state(n: int) -> np.ndarray:
    return np.repeat(_START[:, None], n, axis=1)


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states [8, n] after one more block [16, n] of each message."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + w[t - 7] + (_rotate(x, 7) ^ _rotate(x, 18) ^ (x >> np.uint32(3)))
                 + (_rotate(y, 17) ^ _rotate(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_rotate(e, 6) ^ _rotate(e, 11) ^ _rotate(e, 25)) + (g ^ (e & (f ^ g))) + (_K[t] + w[t])
        two = (_rotate(a, 2) ^ _rotate(a, 13) ^ _rotate(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def _finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of ``blocks`` whole blocks: the padding is a block of its own."""
    pad = np.zeros((16, state.shape[1]), dtype=np.uint32)
    pad[0] = 1 << 31
    pad[15] = blocks * 512
    return absorb(state, pad)


_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def _hex_bytes(digests: np.ndarray) -> np.ndarray:
    """Digests [8, n] as lowercase hex, uint8 [n, 64]."""
    raw = np.ascontiguousarray(digests.T).astype(">u4").view(np.uint8).reshape(digests.shape[1], 32)
    return _HEX[np.stack([raw >> 4, raw & 15], axis=2)].reshape(-1, 64)


def _block_of(digests: np.ndarray) -> np.ndarray:
    """The hex digests as SHA-256 blocks, uint32 [16, n]."""
    return _words(_hex_bytes(digests).tobytes(), 16)


def _words(raw: bytes, width: int) -> np.ndarray:
    """Big-endian words of equally long byte strings, [width, n]."""
    return np.ascontiguousarray(np.frombuffer(raw, dtype=">u4").reshape(-1, width).T.astype(np.uint32))


def _raw(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words.T).astype(">u4").tobytes()


# --- one block of nodes -----------------------------------------------------------------------

def depth(nodes: int, arity: int = ARITY) -> int:
    """Levels above ``nodes`` nodes until one remains."""
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // arity), n + 1
    return n


@dataclass
class Level:
    """Nodes of several blocks on one level, and the states their parents retain.

    nodes [8, m] in block order; sizes and first: nodes of each block and its first place;
    states[s]: state of every parent before slot s; length: children of every parent."""
    nodes: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    states: list[np.ndarray]
    length: np.ndarray


def _first(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)


def _heads(sizes: np.ndarray, first: np.ndarray, arity: int) -> np.ndarray:
    """Places of first children: every ``arity``-th node of each block."""
    n = int(sizes.sum())
    return np.flatnonzero((np.arange(n) - np.repeat(first, sizes)) % arity == 0)


def climb(nodes: np.ndarray, sizes: np.ndarray, levels: np.ndarray, arity: int) -> list[Level]:
    """Levels of blocks climbing together; a block with no levels left keeps its one node."""
    out = []
    for level in range(int(levels.max(initial=0))):
        first = _first(sizes)
        heads = _heads(sizes, first, arity)
        length = np.diff(np.append(heads, nodes.shape[1]))
        blocks = _block_of(nodes)
        state, states = start_state(len(heads)), []
        for slot in range(arity):
            states.append(state)
            here = length > slot
            grown = state.copy()
            grown[:, here] = absorb(state[:, here], blocks[:, heads[here] + slot])
            state = grown
        climbing = levels > level
        upper = np.where(climbing, -(-sizes // arity), sizes)
        parents = np.where(np.repeat(climbing, upper), _finish(state, length), nodes[:, heads])
        out.append(Level(nodes, sizes, first, states, length))
        nodes, sizes = parents, upper
    out.append(Level(nodes, sizes, _first(sizes), [], np.zeros(0, np.int64)))
    return out


def _stored(levels: list[Level], block: int, n_levels: int, arity: int) -> tuple[bytes, bytes]:
    """Node digests above the leaves and states before slots 1.. of one block, level by level."""
    nodes, states = [], []
    for low, high in zip(levels[:n_levels], levels[1:n_levels + 1], strict=True):
        part = slice(int(high.first[block]), int(high.first[block] + high.sizes[block]))
        nodes.append(_raw(high.nodes[:, part]))
        states += [_raw(low.states[s][:, part]) for s in range(1, arity)]
    return b"".join(nodes), b"".join(states)


def _restored(leaves: list[list[bytes]], nodes: list[bytes], states: list[bytes], n_levels: np.ndarray,
              arity: int) -> list[Level]:
    """The levels of several blocks from what the manifest holds of them."""
    sizes = np.array([len(x) for x in leaves], dtype=np.int64)
    flat = b"".join(b"".join(x) for x in leaves)
    level_nodes = [_words(flat, 8)]
    at, at_state = [0] * len(leaves), [0] * len(leaves)
    out = []
    for level in range(int(n_levels.max(initial=0))):
        climbing = n_levels > level
        upper = np.where(climbing, -(-sizes // arity), sizes)
        parts, slots = [], [[] for _ in range(arity)]
        place = _first(sizes)
        for b, (up, m) in enumerate(zip(climbing.tolist(), upper.tolist(), strict=True)):
            if up:
                parts.append(_words(nodes[b][at[b]:at[b] + 32 * m], 8))
                at[b] += 32 * m
            else:   # the block's one node is carried upwards
                parts.append(level_nodes[-1][:, place[b]:place[b] + 1])
            for s in range(1, arity):
                if up:
                    slots[s].append(_words(states[b][at_state[b]:at_state[b] + 32 * m], 8))
                    at_state[b] += 32 * m
                else:
                    slots[s].append(start_state(m))
        above = np.concatenate(parts, axis=1)
        heads = _heads(sizes, place, arity)
        out.append(Level(level_nodes[-1], sizes, place,
                         [start_state(above.shape[1]), *[np.concatenate(s, axis=1) for s in slots[1:]]],
                         np.diff(np.append(heads, level_nodes[-1].shape[1]))))
        level_nodes.append(above)
        sizes = upper
    out.append(Level(level_nodes[-1], sizes, _first(sizes), [], np.zeros(0, np.int64)))
    return out


def resume(state: np.ndarray, replacement: np.ndarray, rights: list[tuple[np.ndarray, np.ndarray]],
           length: np.ndarray) -> np.ndarray:
    """Parents after a child was replaced: ``state`` before its slot, the replacement, then per
    step a mask and the right siblings (blocks, for the masked only)."""
    state = absorb(state, _block_of(replacement))
    for here, block in rights:
        if here.any():
            state = state.copy()
            state[:, here] = absorb(state[:, here], block)
    return _finish(state, length)


def _fold_block(levels: list[Level], replaced: np.ndarray, n_levels: np.ndarray, arity: int) -> np.ndarray:
    """Digests of the blocks' roots, one for every leaf taken alone as replaced."""
    sizes = levels[0].sizes
    block = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(levels[0].first, sizes)
    current = replaced
    for level, low in enumerate(levels[:-1]):
        up = np.flatnonzero(n_levels[block] > level)
        if not len(up):
            break
        b, p = block[up], place[up]
        parent = levels[level + 1].first[b] + p // arity
        slot, length = p % arity, low.length[parent]
        state = np.stack(low.states)[slot, :, parent].T
        hexed = _block_of(low.nodes)
        rights = []
        for j in range(1, arity):
            here = slot + j < length
            rights.append((here, hexed[:, (low.first[b] + p + j)[here]]))
        folded = resume(state, current[:, up], rights, length)
        current = current.copy()
        current[:, up] = folded
        place = place // arity
    return current


def _others(hexed: bytes, place: int, size: int, arity: int) -> tuple[bytes, bytes]:
    """Hex digests left and right of a node in its run."""
    head = place - place % arity
    return hexed[64 * head:64 * place], hexed[64 * (place + 1):64 * min(head + arity, size)]


# --- the tree as tables -----------------------------------------------------------------------

def leaf_digest(*fields: Column) -> Column:
    """Binary digest of a record: each field ``-`` if null, else byte count, colon, value."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in fields]).cast("binary"), 256))


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx (0-based place in grp under ``order``) and n_group: rows are range-partitioned,
    a row's place in its sorted partition is offset by what earlier partitions hold of its group."""
    keys = ["grp", *order, "_tie"]   # rows equal in all of order are split too, wherever they fall
    placed = written(rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
                     .sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    part = F.shiftright("_at", 33)
    runs = written(placed.groupBy("grp", part.alias("_part")).agg(F.min("_at").alias("_low"),
                                                                  F.count(F.lit(1)).alias("_n")))
    group = Window.partitionBy("grp")   # one row per partition that holds any of the group
    offsets = runs.select(
        F.col("grp").alias("_grp"), "_part",
        (F.sum("_n").over(group.orderBy("_part")) - F.col("_n") - F.col("_low")).alias("_shift"),
        F.sum("_n").over(group).alias("n_group"))
    on = (F.col("grp") == F.col("_grp")) & (part == F.col("_part"))
    return placed.join(broadcast_if(offsets, runs.count()), on) \
        .withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_grp", "_part", "_shift")


def _levels_of(n_group: list[int], done: int, levels: int, arity: int) -> np.ndarray:
    return np.array([max(0, min(levels, depth(n, arity) - done)) for n in n_group], dtype=np.int64)


def _steps(batch: pa.RecordBatch):
    for start in range(0, batch.num_rows, STEP):
        yield batch.slice(start, STEP)


def _subtrees(blocks: DataFrame, done: int, levels: int, arity: int) -> DataFrame:
    """Climbs every block (column ``node``: its nodes in order): adds nodes, states and root."""
    names = blocks.columns

    def run(batches):
        for whole in batches:
            for batch in _steps(whole):
                leaves = batch.column(names.index("node")).to_pylist()
                n_levels = _levels_of(batch.column(names.index("n_group")).to_pylist(), done, levels, arity)
                got = climb(_words(b"".join(b"".join(x) for x in leaves), 8),
                            np.array([len(x) for x in leaves], dtype=np.int64), n_levels, arity)
                stored = [_stored(got, b, int(n), arity) for b, n in enumerate(n_levels)]
                roots = _raw(got[-1].nodes)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([s[0] for s in stored], pa.binary()),
                     pa.array([s[1] for s in stored], pa.binary()),
                     pa.array([roots[32 * b:32 * b + 32] for b in range(len(leaves))], pa.binary())],
                    names=[*names, "nodes", "states", "root"])

    schema = T.StructType(list(blocks.schema.fields))
    return blocks.mapInArrow(run, schema.add("nodes", "binary").add("states", "binary").add("root", "binary"))


def build(numbered: DataFrame, extra: list[str], arity: int = ARITY, levels: int = LEVELS) -> list[DataFrame]:
    """The manifest over (grp, idx, n_group, node, extra...): written tables of blocks, leaves first.

    A table has grp, block, n_group, node and each extra (arrays over the block's nodes), nodes,
    states and root; the last table has one block per group, whose root is the group's."""
    span, done, tables = arity ** levels, 0, []
    while True:
        members = F.array_sort(F.collect_list(F.struct("idx", "node", *extra)))
        blocks = numbered.groupBy("grp", F.expr(f"idx div {span}").alias("block")) \
            .agg(F.max("n_group").alias("n_group"), members.alias("_m")) \
            .select("grp", "block", "n_group", *[F.col("_m")[c].alias(c) for c in ("node", *extra)])
        table = written(_subtrees(blocks, done, levels, arity))
        tables.append(table)
        if not table.agg(F.max("block")).first()[0]:
            return tables
        numbered = table.select("grp", F.col("block").alias("idx"), "n_group", F.col("root").alias("node"))
        done, extra = done + levels, []


PATH = "array<struct<state: binary, left: binary, right: binary>>"
_PATH = pa.list_(pa.struct([("state", pa.binary()), ("left", pa.binary()), ("right", pa.binary())]))


def _with_path(table: DataFrame, above: DataFrame | None) -> DataFrame:
    if above is None:
        return table.withColumn("path", F.array().cast(PATH))
    return table.join(broadcast_if(above.drop("node"), table.count(), BROADCAST_PATHS), ["grp", "block"])


def _paths(table: DataFrame, above: DataFrame | None, extra: list[str], carried: list[str], done: int,
           levels: int, arity: int) -> DataFrame:
    """(grp, block, node, extra..., carried..., path) of every node: its retained states and its
    siblings, level by level up to the root.  ``block`` is the node's place, as tables below join it."""
    rows = _with_path(table, above)
    names = rows.columns

    def run(batches):
        for whole in batches:
            for batch in _steps(whole):
                col = {c: batch.column(i).to_pylist() for i, c in enumerate(names)}
                n_levels = _levels_of(col["n_group"], done, levels, arity)
                got = _restored(col["node"], col["nodes"], col["states"], n_levels, arity)
                hexed = [_hex_bytes(x.nodes).tobytes() for x in got]
                out = {c: [] for c in ("grp", "block", "node", *extra, *carried, "path")}
                for b, leaves in enumerate(col["node"]):
                    for p, node in enumerate(leaves):
                        path, place = [], p
                        for level in range(int(n_levels[b])):
                            low = got[level]
                            first, size = int(low.first[b]), int(low.sizes[b])
                            left, right = _others(hexed[level][64 * first:64 * (first + size)], place, size, arity)
                            parent = int(got[level + 1].first[b]) + place // arity
                            state = _raw(low.states[place % arity][:, parent:parent + 1])
                            path.append({"state": state, "left": left, "right": right})
                            place //= arity
                        out["grp"].append(col["grp"][b])
                        out["block"].append(col["block"][b] * arity ** levels + p)
                        out["node"].append(node)
                        for c in extra:
                            out[c].append(col[c][b][p])
                        for c in carried:
                            out[c].append(col[c][b])
                        out["path"].append(path + col["path"][b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, _PATH) if c == "path" else pa.array(v, pa.int64()) if c == "block" else pa.array(v)
                     if any(x is not None for x in v) else pa.array(v, pa.binary()) for c, v in out.items()],
                    names=list(out))

    schema = T.StructType().add("grp", "string").add("block", "long").add("node", "binary")
    for c in extra:
        schema = schema.add(c, table.schema[c].dataType.elementType)
    for c in carried:
        schema = schema.add(c, "binary")
    return rows.mapInArrow(run, schema.add("path", T._parse_datatype_string(PATH)))


def _fold(table: DataFrame, above: DataFrame, key: str, candidate: str, levels: int, arity: int) -> DataFrame:
    """Folds every leaf of the lowest table, with its candidate in its place, up to the root."""
    rows = _with_path(table, above).select("node", key, candidate, "n_group", "nodes", "states", "path",
                                           "subroot", "root_all")
    names = rows.columns
    key_type = table.schema[key].dataType.elementType

    def run(batches):
        for whole in batches:
            kind = whole.schema.field(names.index(key)).type.value_type
            for batch in _steps(whole):
                col = {c: batch.column(i).to_pylist() for i, c in enumerate(names)}
                n_levels = _levels_of(col["n_group"], 0, levels, arity)
                got = _restored(col["node"], col["nodes"], col["states"], n_levels, arity)
                own = [a if b is None else b for x, y in zip(col["node"], col[candidate], strict=True)
                       for a, b in zip(x, y, strict=True)]
                block = np.repeat(np.arange(len(col["node"])), got[0].sizes)
                folded = _fold_block(got, _words(b"".join(own), 8), n_levels, arity)
                folded = _fold_paths(folded, block, col["path"], arity)
                hexed = [_hex_bytes(x.nodes).tobytes() for x in got]
                proofs = []
                for b, leaves in enumerate(col["node"]):
                    ends = [hexed[k][64 * int(x.first[b]):64 * int(x.first[b] + x.sizes[b])]
                            for k, x in enumerate(got[:int(n_levels[b])])]
                    upper = b"".join(e["left"] + e["right"] for e in col["path"][b])
                    for p in range(len(leaves)):
                        parts, place = [], p
                        for digests in ends:
                            parts += _others(digests, place, len(digests) // 64, arity)
                            place //= arity
                        proofs.append(hashlib.sha256(b"".join(parts) + upper).hexdigest())
                keys = [k for x in col[key] for k in x]

                def of_block(name, col=col, block=block):
                    return pa.array([col[name][b].hex() for b in block], pa.string())

                leaf = hexed[0].decode()
                back = _hex_bytes(folded).tobytes().decode()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, kind), pa.array([leaf[i:i + 64] for i in range(0, len(leaf), 64)], pa.string()),
                     of_block("subroot"), of_block("root_all"), pa.array(proofs, pa.string()),
                     pa.array([back[i:i + 64] for i in range(0, len(back), 64)], pa.string())],
                    names=[key, "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    schema = T.StructType().add(key, key_type)
    for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        schema = schema.add(c, "string")
    return rows.mapInArrow(run, schema)


def _fold_paths(current: np.ndarray, block: np.ndarray, paths: list[list[dict]], arity: int) -> np.ndarray:
    """Carries the digests of block roots on along the paths above their blocks."""
    n_steps = np.array([len(p) for p in paths])
    for k in range(int(n_steps.max(initial=0))):
        up = np.flatnonzero(n_steps[block] > k)
        steps = [p[k] if len(p) > k else {"state": bytes(32), "left": b"", "right": b""} for p in paths]
        state = _words(b"".join(s["state"] for s in steps), 8)[:, block[up]]
        n_right = np.array([len(s["right"]) // 64 for s in steps])
        length = n_right + np.array([len(s["left"]) // 64 for s in steps]) + 1
        rights = []
        for j in range(arity - 1):
            here = n_right[block[up]] > j
            sibling = _words(b"".join(s["right"][64 * j:64 * j + 64].ljust(64, b"0") for s in steps), 16)
            rights.append((here, sibling[:, block[up][here]]))
        folded = resume(state, current[:, up], rights, length[block[up]])
        current = current.copy()
        current[:, up] = folded
    return current


def manifest(leaves: DataFrame, key: str, group: str, candidate: str = "candidate", arity: int = ARITY,
             levels: int = LEVELS) -> DataFrame:
    """Trees over (key, group, node, candidate) by group, and one tree over the groups' roots.

    Per leaf: key, leaf, subroot, root, proof_sha256 (digest of all siblings on the way up) and
    folded_root: the root recomputed from the candidate (null: the leaf itself) by resuming the
    retained states; all digests in lowercase hex.
    """
    prepare(leaves.sparkSession)
    grp = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    rows = leaves.select(grp.alias("grp"), F.col(key).alias("_key"), "node", F.col(candidate).alias("_candidate"))
    tables = build(number(rows, ["_key", "node"]), ["_key", "_candidate"], arity, levels)
    tops = tables[-1].select(F.lit("").alias("grp"), F.col("grp").alias("_name"), F.col("root").alias("node"))
    crown = build(number(tops, ["_name"]), ["_name"], arity, levels)
    root = crown[-1].select(F.col("root").alias("root_all"), F.lit("").alias("grp"))
    above = None
    for k in reversed(range(len(crown))):
        above = _paths(crown[k], above, ["_name"] if k == 0 else [], [], k * levels, levels, arity)
    above = above.join(F.broadcast(root), "grp").select(   # one row: the tree over the groups has one root
        F.col("_name").alias("grp"), F.lit(0).cast("long").alias("block"), "path", F.col("node").alias("subroot"),
        "root_all")
    for k in reversed(range(1, len(tables))):
        above = _paths(tables[k], written(above), [], ["subroot", "root_all"], k * levels, levels, arity).drop("node")
    return _fold(tables[0], written(above), "_key", "_candidate", levels, arity).withColumnRenamed("_key", key)


#: The fields of a record, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents, and as candidates those of rows whose n_chars was tampered with."""
    fields = {c: F.col(c) for c in FIELDS}
    own = leaf_digest(*fields.values())
    more = F.col("n_chars").cast("decimal(20,0)") + 1   # wider: the largest long can be tampered with too
    forged = leaf_digest(*(fields | {"n_chars": more}).values())
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return docs.select("doc_id", "lang", own.alias("node"), F.when(tampered, forged).alias("candidate"))


def verify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, per document."""
    found = manifest(document_leaves(docs), "doc_id", "lang")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))
