"""Every text operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import (
    bloom_dedup, decontaminate, gam, label_shards, ngram_lm, packed_ids, pair_bpe, secrets, simhash, toxicity,
)

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = "one two three " * 40_000
#: id, text; 4 twice with one text, 5 twice with different ones, ids and texts null.
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (5, "a"), (5, "b c d e"), (None, "b c d e"), (None, None), (6, LONG), (7, LONG),
    (8, "In spring Maria bought 12 apples for 5 kg of flour."),
]
#: Names that operators use for results or while they work.
CLASHES = ["rec", "id", "row", "fp", "key", "link", "size", "shard", "chunk", "score", "kept", "item", "n", "block", "held_out", "slot"]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame([(i, i, t) for i, (_, t) in enumerate(ROWS)], "k long, k2 long, text string").drop("k2")
    ids = spark.createDataFrame(list(enumerate(r[0] for r in ROWS)), "k long, doc_id long")
    return base.join(ids, "k").select("k", "doc_id", "text", *[F.lit(c).alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 2) for i in range(9)] + [(None, 1, 1), (3, None, None), (4, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "In spring Anna bought 30 apples for 7 kg of flour."), (2, None), (3, ""), (4, "b c d e"), (4, "b c d e")], "item_id long, text string"
    )


def marking(labels, items):
    return {
        "toxicity": lambda d: toxicity.mark_toxic(d, labels),
        "quality": lambda d: gam.mark_quality(d, labels),
        "dedup": bloom_dedup.mark_copies,
        "simhash": simhash.near_groups,
        "lm": ngram_lm.score_texts,
        "shards": label_shards.assign,
        "bpe": lambda d: d.withColumn("ids", pair_bpe.encode(F.col("text"), VOCABULARY)),
        "secrets": lambda d: d.withColumn("s", secrets.summary(F.col("text"))),
    }


OPERATORS = ("toxicity", "quality", "dedup", "simhash", "lm", "shards", "bpe", "secrets")


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_and_columns_stay(docs, labels, items, name):
    out = marking(labels, items)[name](docs)
    assert len(out.columns) == len(set(out.columns)) and set(docs.columns) <= set(out.columns)
    rows = out.collect()
    assert sorted(r["k"] for r in rows) == list(range(len(ROWS)))
    assert all(ROWS[r["k"]] == (r["doc_id"], r["text"]) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, items, name):
    assert marking(labels.limit(0), items)[name](docs.limit(0)).collect() == []


def test_filters_keep_rows_as_they_are(docs, labels, items):
    for kept in (
        bloom_dedup.drop_copies(docs), simhash.keep_one(docs), decontaminate.drop_leaks(docs, items), toxicity.drop_toxic(docs, labels)
    ):
        assert kept.columns == docs.columns
        assert all(ROWS[r["k"]] == (r["doc_id"], r["text"]) for r in kept.collect())


def test_dedup_of_ties(docs):
    rows = {r["k"]: r for r in bloom_dedup.mark_copies(docs).collect()}
    # null and empty text are equal; the largest id stays; of rows equal in id and text exactly one stays.
    assert (rows[0]["kept"], rows[1]["kept"], rows[8]["kept"]) == (False, True, False) and rows[8]["group_size"] == 3
    assert sum(rows[k]["kept"] for k in (3, 4, 5)) == 1 and rows[5]["kept"]
    assert rows[6]["kept"] and not rows[7]["kept"] and rows[7]["keep_id"] == 5
    assert sorted(r["k"] for r in bloom_dedup.drop_copies(docs).collect()) == sorted(k for k, r in rows.items() if r["kept"])
    twice = docs.filter("k = 3").unionByName(docs.filter("k = 3"))
    assert sum(r["kept"] for r in bloom_dedup.mark_copies(twice).collect()) == 1


def test_simhash_of_wordless_texts(docs):
    rows = {r["k"]: r for r in simhash.near_groups(docs).collect()}
    assert {rows[k]["fingerprint"] for k in (0, 1, 2, 8)} == {"0" * 16}
    assert {rows[k]["component_id"] for k in (0, 1, 2, 8)} == {1}
    kept = {r["k"] for r in simhash.keep_one(docs).collect()}
    assert 0 in kept and len(kept & {3, 4, 5}) == 1 and len(kept & {9, 10}) == 1


def test_leaks(docs, items):
    rows = decontaminate.mark_leaks(docs, items).collect()
    assert sorted((r["k"], r["item_id"]) for r in rows) == [(6, 4), (6, 4), (7, 4), (7, 4), (11, 1)]
    assert decontaminate.mark_leaks(docs, items.limit(0)).collect() == []
    assert decontaminate.drop_leaks(docs, items.limit(0)).count() == len(ROWS)
    assert decontaminate.mark_leaks(docs.limit(0), items).collect() == []


def test_packed_ids(spark, docs):
    rows = packed_ids.round_trip(docs, VOCABULARY, 49_408).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in ROWS), key=lambda i: -1 if i is None else i)
    assert rows[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    assert packed_ids.round_trip(docs.limit(0), VOCABULARY, 49_408).collect() == []


def test_shards_are_even(docs):
    rows = label_shards.assign(docs, shards=5).collect()
    counts = [sum(r["shard"] == s for r in rows) for s in range(5)]
    assert max(counts) - min(counts) <= 1
    for s in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_secrets_of_null_stay_null(docs):
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    assert {r["k"]: r["text"] for r in out.collect()} == {k: t for k, (_, t) in enumerate(ROWS)}
