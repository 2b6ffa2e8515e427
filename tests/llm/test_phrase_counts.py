"""Packed phrase counts of the collocations: what they hold, what they take of the disk, and more words than are broadcast."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import collocations
from tidemark.session import shared_folder


def zipf_texts(texts, length, words, seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 3) for i in range(words)]
    return [" ".join(rng.choices(pool, weights, k=length)) for _ in range(texts)]


def often(texts, least):
    found = Counter()
    for text in texts:
        w = text.split()
        found.update(" ".join(w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1))
    return {p: n for p, n in found.items() if n >= least}


def table(spark, texts):
    return spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(4)


def test_rare_phrases_take_little_disk(spark):
    """With more frequent words than are broadcast: fewer bytes than 13 for a word of the texts, about 20 if each phrase has a row."""
    texts = zipf_texts(1500, 100, 4000, 1)
    docs = table(spark, texts)
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = collocations.collocations(docs, least=10, covered=10**9, top=10**6, max_broadcast_rows=200)
    new = set(os.listdir(folder)) - before
    kept = sum(os.path.getsize(f"{d}/{f}") for x in new for d, _, names in os.walk(f"{folder}/{x}") for f in names if f.endswith(".parquet"))
    assert {r["phrase"]: r["a"] for r in found.collect()} == often(texts, 10)
    assert 0 < kept < 13 * 1500 * 100


@pytest.mark.parametrize("most", [1_000_000, 20, 0])
@pytest.mark.parametrize("bits", [16, 1, 0])
def test_filters_that_hold_too_much_change_no_count(spark, monkeypatch, most, bits):
    """Words that a later step activates, numbers for some of them only, and filters that hold nearly everything."""
    monkeypatch.setattr(collocations, "KEY_BITS", bits)
    monkeypatch.setattr(collocations, "PART", 25)
    monkeypatch.setattr(collocations, "BUCKET", 3000)
    texts = zipf_texts(500, 25, 250, 2)
    found = collocations.collocations(table(spark, texts), least=8, covered=10**9, top=10**6, shards=3, max_broadcast_rows=most, run=1500)
    assert {r["phrase"]: r["a"] for r in found.collect()} == often(texts, 8)


def test_packed_columns_come_back():
    rng = np.random.default_rng(4)
    for size in (1, 2, 999):
        columns = [np.sort(rng.integers(0, 10**6, size)), rng.integers(-(1 << 63), 1 << 63, size), np.zeros(size, np.int64), rng.integers(0, 300, size)]
        for order in (columns, columns[1:] + columns[:1]):
            back = collocations.unpacked(collocations.packed(order), 4)
            assert all((a == b).all() for a, b in zip(order, back, strict=True))


def test_filter_holds_its_keys():
    keys = collocations.mixed([np.arange(3000), np.arange(3000)[::-1]])
    parts = collocations.part_of(keys, 3)
    bits = []
    for part in range(3):
        blocks = np.zeros(250, np.uint64)
        own = keys[parts == part]
        np.bitwise_or.at(blocks, collocations.block_of(own, np.uint64(250)), collocations.marks_of(own))
        bits.append(blocks)
    some = collocations.Filter(bits)
    assert some.has(keys).all()
    assert some.has(collocations.mixed([np.arange(10_000, 30_000), np.arange(20_000)])).mean() < 0.05


@pytest.mark.parametrize("high", [1 << 10, 1 << 40])
def test_grouped_rows(high):
    rng = np.random.default_rng(5)
    values = rng.integers(-high if high > 1 << 10 else 0, high, 7)
    parts = [rng.choice(values, 500) for _ in range(3)]
    n = rng.integers(1, 5, 500)
    want, ones = Counter(), Counter()
    for *row, k in zip(*parts, n):
        want[tuple(row)] += k
        ones[tuple(row)] += 1
    for counts, given in ((want, n), (ones, None)):
        rows, sums = collocations.grouped(parts, given)
        assert list(zip(zip(*rows), sums)) == sorted(counts.items())
