"""Operators 11 to 13 against brute force, on odd rows and in pieces."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import merkle, negatives, substrings


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- operator 11 ---------------------------------------------------------------------------------

def brute_tree(rows, arity):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more=0):
        n = None if r["n_chars"] is None else r["n_chars"] + more
        return digest("".join(map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"]))))

    def climb(level):
        levels = [level]
        while len(levels[-1]) > 1:
            low = levels[-1]
            levels.append([digest("".join(low[i:i + arity])) for i in range(0, len(low), arity)])
        return levels

    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf(r) for r in groups[g]]) for g in names}
    crown = climb([trees[g][-1][0] for g in names])
    out = []
    for nth, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            forged = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now, siblings = leaf(r, int(forged)), ""
            for levels, place in ((trees[g], i), (crown, nth)):
                for low in levels[:-1]:
                    head = place - place % arity
                    run = low[head:head + arity]
                    siblings += "".join(run[:place - head] + run[place - head + 1:])
                    run[place - head] = now
                    now, place = digest("".join(run)), place // arity
            root = crown[-1][0]
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], root, digest(siblings), now, now == root))
    return sorted(out, key=repr)


def test_midstates_are_those_of_sha256():
    rng = random.Random(3)
    raw = [rng.randbytes(64) for _ in range(5)]
    state = merkle.start_state(5)
    for n in range(1, 4):
        state = merkle.absorb(state, merkle._words(b"".join(raw), 16))
        got = merkle._hex_bytes(merkle._finish(state, np.full(5, n))).tobytes().decode()
        assert [got[64 * i:64 * i + 64] for i in range(5)] == [hashlib.sha256(r * n).hexdigest() for r in raw]


@pytest.mark.parametrize(("arity", "levels"), [(2, 1), (2, 2), (3, 1), (2, 8)])
def test_tree_of_odd_rows(spark, arity, levels):
    rng = random.Random(arity * 10 + levels)
    langs = ["en"] * 23 + ["de"] * 8 + ["", "é"] + [None] * 3 + ["fr"] * 5
    rows = [(None if rng.random() < 0.1 else rng.randrange(40), rng.choice(["a", None, "ü"]), lang,
             rng.choice([None, 0, 7, 2 ** 63 - 1]), rng.choice([None, "", "x y", "\U0001f600" * 9])) for lang in langs]
    rows += rows[:6]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string") \
        .withColumn("grp", F.lit("g")).withColumn("node", F.lit(1)).withColumn("idx", F.lit("i"))
    want = brute_tree([r.asDict() for r in docs.collect()], arity)
    got = merkle.manifest(merkle.document_leaves(docs), "doc_id", "lang", arity=arity, levels=levels)
    got = got.withColumn("verified", F.col("folded_root") == F.col("root")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert merkle.verify_documents(docs.limit(0)).collect() == []


def test_one_record_is_the_root(spark):
    docs = spark.createDataFrame([(5, None, None, None, None)],
                                 "doc_id int, source string, lang string, n_chars long, text string")
    r = merkle.verify_documents(docs).collect()[0]
    assert r.leaf == r.subroot == r.root == digest("1:5----") and r.proof_sha256 == digest("")


# --- operator 12 ---------------------------------------------------------------------------------

def brute_negatives(rows, every=50):
    fit = [(i, v, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [int(np.floor(256 * float(x))) for x in e])
           for i, (v, e, lab) in enumerate(rows) for i, v in [(v, i)] if lab is not None and e is not None
           and all(x is not None and np.isfinite(x) for x in e)]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))  # noqa: B905 (padded with zeros)

    def first(found, k):
        return sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]

    out = []
    for vec, place, lab, e in fit:
        if vec is None or vec % every:
            continue
        others = [(score(e, x), v, la) for v, p, la, x in fit if p != place]
        for ps, pid, _ in first([o for o in others if o[2] == lab], 5):
            hard = [o for o in others if o[2] != lab and 50 * ps <= 100 * o[0] <= 95 * ps]
            out += [(vec, pid, n, nid, ps, ns) for n, (ns, nid, _) in enumerate(first(hard, 3), 1)]
    return sorted(out, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int") \
        .withColumn("row", F.lit("r")).withColumn("v", F.lit(0)).withColumn("slot", F.lit(1))


def test_negatives_with_ties_and_bad_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 12))
    rows = []
    for i in range(700):
        v = np.round(centre[i % 6] + rng.normal(size=12) * 0.7, 1)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 4)))
    rows += [(1000 + i, rows[100][1], i % 3) for i in range(40)]     # a group of copies
    rows += [(None, rows[100][1], 1), (801, None, 1), (802, [], 1), (803, [None] * 12, 1), (804, [float("nan")] * 12, 2),
             (805, [float("inf")] * 12, 2), (806, rows[3][1], None), (807, [1.0] * 5, 2), (850, [0.0] * 12, 1),
             (900, [-1.0] * 12, 3)]
    df = vectors(spark, rows)
    want = brute_negatives(rows)
    assert len(want) > 100
    assert sorted(map(tuple, negatives.mine(df).collect()), key=repr) == want
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)
    assert sorted(map(tuple, negatives.mine(df, anchor_bytes=400).collect()), key=repr) == want
    assert negatives.mine(df.limit(0)).collect() == []


def test_negatives_beyond_doubles(spark):
    rows = [(i, [float(np.float32(2.0 ** (20 + i % 3))), float(i)], i % 3) for i in range(60)]
    assert sorted(map(tuple, negatives.mine(vectors(spark, rows)).collect()), key=repr) == brute_negatives(rows)
    huge = [(i, [1e38, float(i)], i % 3) for i in range(60)]
    assert {r["positive_score"] for r in negatives.mine(vectors(spark, huge)).collect()} <= {2 ** 63 - 1}


def test_index_leaves_out_what_norms_cover():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(50, 32)) * np.linspace(1, 40, 32))
    block = negatives.Block(x[:5], x)
    top = float(block.x_norm[:, -1].max())
    block.lower(0.9 * top)
    assert (block.left_out > 0).all()
    block.lower(0.3 * top)
    some = block.left_out.copy()
    a, r, score = block.reach(np.full(5, 0.3 * top) * block.q_norm[:, -1], np.ones((5, 50), bool))
    full = x[:5] @ x.T
    assert np.array_equal(score, full[a, r]) and (some > 0).any()
    missed = np.ones((5, 50), bool)
    missed[a, r] = False
    assert (full[missed] < (0.3 * top * block.q_norm[:, -1])[:, None].repeat(50, 1)[missed]).all()


# --- operator 13 ---------------------------------------------------------------------------------

def brute_repeats(rows, window):
    words = [((t or "").replace("\xa0", "\0").encode().split()) for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i:i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).replace(b"\0", "\xa0".encode())
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("d")) \
        .withColumn("key", F.lit(1)).withColumn("asked", F.lit(0)).withColumn("path", F.lit("p"))


def woven(seed, n, window):
    """Texts over few words that share passages, with odd blanks, copies and repeats inside."""
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(window - 2, 4 * window))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(6)):
            part = rng.choice(passages)
            if rng.random() < 0.4:
                part = part[rng.randrange(len(part)):]
            if rng.random() < 0.3:
                part = [*part[:5], "changed", *part[6:]]
            w += part + [f"u{rng.randrange(9)}" for _ in range(rng.randrange(4))]
        rows.append((i, rng.choice([" ", "\n ", "\t"]).join(w)))
    rows += [(rng.randrange(n), rows[3][1]), (500, rows[3][1]), (500, rows[4][1]), (None, rows[5][1]), (600, None),
             (601, ""), (602, " \x0b\n"), (603, "\xa0".join(rows[6][1].split())), (604, "x " * 300), (2, "x " * 200)]
    return rows


@pytest.mark.parametrize(("window", "edge"), [(50, 16), (12, 4), (7, 7)])
def test_repeats_against_brute_force(spark, window, edge):
    rows = woven(window, 60, window)
    got = substrings.remove_repeats(documents(spark, rows), window=window, edge=edge)
    want = brute_repeats(rows, window)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(r[2] > 0 for r in want) > 20
    assert substrings.remove_repeats(documents(spark, rows).limit(0)).collect() == []


def test_repeats_in_pieces_and_by_shuffle(spark, monkeypatch):
    """Texts longer than a piece, words longer than the hashed lanes, joins without broadcast."""
    monkeypatch.setattr(substrings, "BROADCAST_REQUESTS", 0)
    rng = random.Random(1)
    long = " ".join(f"t{rng.randrange(5000)}" for _ in range(70_000))
    giant = " ".join(["a" * 300, "b" * 1000, "é" * 200] * 30)
    rows = [(3, long), (1, " ".join(long.split()[20_000:69_000])), (2, giant + " end"), (9, "start " + giant), (4, "z")]
    got = substrings.remove_repeats(documents(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats(rows, 50)


def test_spans_carry_their_source(spark):
    words = [f"a{i}" for i in range(60)]
    spans = substrings.repeated_spans(documents(spark, [(1, " ".join(words)), (2, " ".join(words[5:] + ["x"]))]))
    r = spans.collect()
    assert len(r) == 1 and (r[0]["start"], r[0]["end"], r[0]["s_start"], r[0]["s_doc"]) == (0, 55, 5, 1)
    assert bytes(r[0]["digest"]) == hashlib.blake2b(" ".join(words[5:]).encode(), digest_size=16).digest()
