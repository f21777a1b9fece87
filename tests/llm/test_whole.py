"""The whole job: what a size limit, a cap or a window used to leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import itq, quality, toxicity


@pytest.mark.parametrize("classes", [30_000, 10**6, 10**7, 10**8])
def test_pairs_at_the_limit_are_found_at_every_size(classes):
    """Near pairs in a cluster of a third of the vectors, with the chunks of ``classes`` classes."""
    chunk = int(np.ceil(np.log2(classes))) + 1
    tables = itq.tables_for(chunk, itq.COSINE)
    print(f"{classes} classes: {tables} chunks of {chunk} bits, "
          f"expected recall at {itq.COSINE}: {1 - itq.missed(chunk, tables, itq.COSINE):.5f}")
    assert itq.missed(chunk, tables, itq.COSINE) <= itq.MISS
    rng = np.random.default_rng(classes)

    def pairs(base):
        u = itq._unit(base)
        side = rng.normal(size=u.shape)
        side = itq._unit(side - (side * u).sum(axis=1, keepdims=True) * u)
        return u, itq.COSINE * u + np.sqrt(1 - itq.COSINE ** 2) * side

    centre = rng.normal(size=32)
    near = pairs(centre / np.linalg.norm(centre) + rng.normal(size=(1500, 32)) / np.sqrt(32))
    far = pairs(rng.normal(size=(3000, 32)))
    turn = itq.learn(np.concatenate([*near, *far]), tables * chunk)
    for a, b in (near, far):
        flips = ((a @ turn >= 0) != (b @ turn >= 0)).reshape(len(a), tables, chunk).sum(axis=2)
        assert (flips.min(axis=1) > 1).mean() <= 0.005


def test_a_single_owner_keeps_its_key_in_any_number_of_documents(spark):
    from tabulon.llm import secrets
    rows = [(i, "key Zx9qLm3RtY7uWp2Ks8Vb here", "hot") for i in range(4)]
    rows += [(100 + i, f"text {i} with Qw8eRt5yUi2oPa7sDf4g", "hot") for i in range(2000)]
    rows += [(5000 + i, "two Ab1Cd2Ef3Gh4Ij5Kl6Mn7 x", f"s{i % 2}") for i in range(4)]
    got = {r["doc_id"]: r for r in
           secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["spans"] == "owned:4:24" and got[i]["n_live"] == 1 for i in range(4))
    assert all(got[100 + i]["spans"].startswith("owned:") for i in range(2000))
    assert all(got[5000 + i]["spans"] == "" for i in range(4))


def test_junk_far_behind_the_match_window_counts():
    rng = np.random.default_rng(4)
    words = [[("good", "bad")[c] + "".join(rng.choice(list("abcdefghij"), 8)) for _ in range(600)] for c in (0, 1)]
    text = lambda c, n: " ".join(words[c][i] for i in rng.integers(600, size=n)).encode()
    dictionaries = [quality.train_dictionary([text(c, 300) for _ in range(100)]) for c in (1, 0)]
    tools = quality.Compressors((dictionaries[0], dictionaries[1]))
    opening, junk = text(0, 200_000), text(1, 600_000)   # megabytes of each
    good, bad, mixed = (tools.features(t)[0] for t in (opening, junk, opening + junk))
    assert good > 0 > bad and abs(mixed - (good + 3 * bad) / 4) < 0.1 * (good - bad)
    # length alone does not pull a text towards the middle
    assert tools.features(opening[:20 * quality.BLOCK])[0] == pytest.approx(good, rel=0.1)


@pytest.fixture(scope="module")
def template_texts(spark):
    """A slur that always follows the same word, and a toxic phrase of ordinary words."""
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ola", "enur", "itas", "omen", "ural", "ask")]
    rows = []
    for i in range(600):
        own = rng.choice(words, 40).tolist()
        at = int(rng.integers(1, 38))
        if i % 3 == 0:
            own[at:at + 2] = [words[0], "xqz"]
        elif i % 3 == 1:
            own[at:at + 2] = [words[1], words[2]]
        else:   # the phrase's words stand apart in ordinary text, as often
            own[at], own[at - 1] = words[2], words[3]
        rows.append((i, " ".join(own).replace(f"{words[1]} {words[2]}", f"{words[1]} {words[2]}" if i % 3 == 1
                                              else words[4]), int(i % 3 < 2)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache(), words


def test_a_word_after_one_neighbour_and_a_phrase_of_ordinary_words(spark, template_texts, monkeypatch):
    docs, words = template_texts
    model = toxicity.fit(docs, "toxic", "text")
    new = spark.createDataFrame([(0, f"{words[9]} {words[0]} xqz"), (1, f"{words[9]} {words[1]} {words[2]}"),
                                 (2, f"{words[9]} {words[2]} {words[1]}"), (3, None)], "doc_id long, text string")
    x = {r["doc_id"]: r["_x"] for r in toxicity.differences(new, model, ["doc_id"], "text").collect()}
    assert x[3] == 0 and x[0] > x[2] + 0.3 and x[1] > x[2] + 0.3
    joined = toxicity.differences(docs, model, ["doc_id"], "text", limit=0).collect()
    known = {r["doc_id"]: r["_x"] for r in toxicity.differences(docs, model, ["doc_id"], "text").collect()}
    assert {r["doc_id"]: r["_x"] for r in joined} == pytest.approx(known, abs=1e-9) and len(known) == 600
    monkeypatch.setattr(toxicity, "PIECE", 500)
    parts = toxicity.KneserNey(model.table, model.share, model.running)
    assert parts.bits > 1
    again = {r["doc_id"]: r["_x"] for r in toxicity.differences(docs, parts, ["doc_id"], "text").collect()}
    assert again == pytest.approx(known, abs=1e-9)


def test_left_neighbours_are_counted_exactly_in_both_classes(spark):
    rows = [(f"left{i} common " * 2, int(i < 500)) for i in range(5500)] + [("left1 common", 1)] * 50
    pairs = toxicity.count_pairs(spark.createDataFrame(rows, "text string, toxic int"), "toxic", "text")
    got = {bytes(r["x"]): (r["c_1"], r["c_0"]) for r in toxicity.continuations(pairs).collect()}
    assert got[b"0 common"] == got[b"4 comm"] == (500, 5000) and got[b"0 left1"] == (2, 0)


def test_first_texts_are_the_first_by_hash(spark):
    order = F.xxhash64(F.col("doc_id").cast("string"))
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('text ', id) as text").repartition(40)
    want = [r["text"].encode() for r in docs.orderBy(order, "doc_id").limit(60).collect()]
    assert quality.first_texts(docs, order, "doc_id", "text", 60, 5000) == want
    assert len(quality.first_texts(docs, order, "doc_id", "text", 9000, 5000)) == 5000
    # one id on all rows lies above the bound: taken without it
    same = spark.range(5000).selectExpr("0L as doc_id", "'copy' as text")
    assert quality.first_texts(same, order, "doc_id", "text", 60, 5000) == [b"copy"] * 60
    assert quality.first_texts(docs.limit(0), order, "doc_id", "text", 60, 0) == []
