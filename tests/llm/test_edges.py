"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tabulon.llm import bagminhash, decontam, itq, langid, mixing, quality, secrets, sharding, toxicity, urls


LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(40_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with clashing names."""
    prose = "the river ran past the old mill and the miller heard it all night long in his sleep"
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, "b"), (4, "x", "en", None),
        (5, LONG, "de", "a"), (6, prose, "en", "a"), (7, prose, "en", "b"), (7, prose, "en", "b"),
        (8, prose.upper() + "!", "fr", "b"), (None, prose, None, None), (9, "12 34 !!", "en", "c"),
        (10, "Ünï côdé \u4f60\u597d \U0001f600 " * 5, "fr", "c"), (11, "² ½ ①", "en", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("_rec", F.lit("r")) \
        .withColumn("id", F.lit(5)).withColumn("key", F.lit("k")).withColumn("size", F.lit(-1)) \
        .withColumn("shard", F.lit("s")).withColumn("_text", F.lit("t"))


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 0, 0), (5, 1, None), (6, 1, 1), (6, 1, 1), (8, None, 0), (None, 1, 1)],
                                 "doc_id long, quality int, toxic int")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, "the old mill and the miller"), (2, None), (3, "!!"), (None, "past the old mill")],
                                 "item_id long, text string")


def operators(labels, items):
    return {
        "mix": lambda d: mixing.taken(mixing.mix(d)),
        "secrets": secrets.find_secrets,
        "near": bagminhash.classify,
        "toxic": lambda d: toxicity.score_toxicity(d, labels),
        "shard": sharding.shard_documents,
        "quality": lambda d: quality.score_quality(d, labels),
        "decontam": lambda d: decontam.judge(d, items),
        "language": langid.identify,
    }


@pytest.mark.parametrize("name", ["mix", "secrets", "near", "toxic", "shard", "quality", "decontam", "language"])
def test_one_row_per_document(odd_docs, odd_labels, items, name):
    run = operators(odd_labels, items)[name]
    out = rows(run(odd_docs))
    assert sorted((r["doc_id"] for r in out), key=str) == sorted((r["doc_id"] for r in odd_docs.collect()), key=str)
    assert rows(run(odd_docs.limit(0))) == []


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_no_labels(odd_docs, odd_labels, items, name):
    out = rows(operators(odd_labels.limit(0), items)[name](odd_docs))
    assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)


def test_defined_values(odd_docs, items):
    size = {r["doc_id"]: r for r in rows(mixing.taken(mixing.mix(odd_docs)))}
    assert size[1]["size"] == size[2]["size"] == size[3]["size"] == 0 and size[5]["size"] == 80_000
    assert all(r["taken"] <= 2 * r["size"] for r in size.values())
    near = {r["doc_id"]: r for r in rows(bagminhash.classify(odd_docs))}
    assert near[7]["class_id"] == near[8]["class_id"] == 6 and near[6]["kept"] and not near[8]["kept"]
    assert near[1]["class_id"] == 1 and near[2]["kept"] and near[3]["kept"] and near[None]["kept"]
    lang = {r["doc_id"]: r for r in rows(langid.identify(odd_docs))}
    assert [lang[k]["lang_pred"] for k in (1, 2, 3, 9, 11)] == ["und"] * 5 and lang[1]["score"] == 0
    hit = {r["doc_id"]: r for r in rows(decontam.judge(odd_docs, items))}
    assert hit[6]["n_hit"] == 7 and hit[6]["n_items"] == 2 and hit[6]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert hit[1]["n_words"] == 0 and hit[8]["contaminated"]
    shard = {r["doc_id"]: r for r in rows(sharding.shard_documents(odd_docs))}
    assert shard[1]["size"] == 8 and shard[1]["text_crc32"] == 0


def test_no_items(odd_docs, items):
    out = rows(decontam.judge(odd_docs, items.limit(0)))
    assert not any(r["contaminated"] for r in out) and len(out) == odd_docs.count()


def test_stages_return_the_documents_columns(odd_docs, items):
    for stage in (langid.keep_identified, bagminhash.drop_near_duplicates,
                  lambda d: decontam.remove_spans(d, items),
                  lambda d: mixing.mixed_documents(d, mixing.mix(d))):
        out = stage(odd_docs)
        assert out.columns == odd_docs.columns
        assert out.where(F.col("_rec") != "r").count() == 0
        assert stage(odd_docs.limit(0)).count() == 0
    kept = bagminhash.drop_near_duplicates(odd_docs)
    assert [r["doc_id"] for r in rows(kept) if r["doc_id"] in (6, 7, 8)] == [6]
    cut = {r["doc_id"]: r["text"] for r in rows(decontam.remove_spans(odd_docs, items, max_coverage=0.9))}
    assert cut[6] == "the river ran  heard it all night long in his sleep" and cut[1] is None
    carried = sharding.shard_documents(odd_docs, carry=True)
    assert carried.count() == odd_docs.count() and {"_rec", "id", "key", "_text"} <= set(carried.columns)


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, "h"), (2, "", None), (3, "no scheme", ""), (4, "http://A.COM/x?q#f", "h"), (4, "http://A.COM/x?q#f", "h"),
         (5, "http://www.example.com/en/a", ""), (6, "http://example.com/en/a", ""), (7, "s://x.net/es/" + "a" * 5000, ""),
         (8, "http://org", ""), (None, "http://b.com?x=/en/", ""), (9, "http://xcom/", "")],
        "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(1))
    out = {r["page_id"]: r for r in rows(urls.judge(pages))}
    assert (out[1]["host"], out[1]["path"], out[1]["rule"]) == ("", "", None)
    assert (out[3]["host"], out[4]["host"], out[4]["path"], out[4]["rule"]) == ("", "a.com", "/x", "com/")
    assert out[5]["rule"] == "www.example.com/en/" and out[6]["verdict"] == "block" and out[7]["rule"] == "net/es/"
    assert out[None]["path"] == "" and out[None]["rule"] is None and out[9]["rule"] is None
    assert urls.judge(pages).count() == 11 and urls.judge(pages.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.01]), (4, None), (5, []), (6, [0.0, 0.0]),
         (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [-1.0, 0.0]), (11, [1e300, 0.0]), (12, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")) \
        .withColumn("label", F.lit(None).cast("int"))
    out = rows(itq.link_vectors(df))
    by = {r["vec_id"]: r for r in out}
    assert len(out) == len(v) and {by[k]["n_links"] for k in (1, 2, 3, 11)} == {4}
    assert {by[k]["component_id"] for k in (1, 2, 3, 11)} == {1}
    assert all(by[k]["n_links"] == 0 and by[k]["component_id"] == k and by[k]["kept"] for k in (4, 5, 6, 7, 8, 9, 10, 12))
    assert itq.link_vectors(df.limit(0)).count() == 0
