"""SimHash near-dedup by the similarity of five-word sets: recall against brute force, crowds, odd input."""

import itertools
import random
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import simhash


def brute_sets(texts, words=5):
    out = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        out[k] = {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()
    return out


def brute_pairs(sets, percent=80):
    """All pairs a < b of keys with 100 * intersection >= percent * union, through an index of all shingles."""
    index, common = defaultdict(list), defaultdict(int)
    for k in sorted(sets):
        for s in sets[k]:
            for other in index[s]:
                common[other, k] += 1
            index[s].append(k)
    return {p for p, n in common.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)}


def brute_kept(texts, percent=80):
    """Keys that are the smallest of their component of linked texts."""
    sets = brute_sets(texts)
    least = {k: k for k in sets}

    def top(k):
        while least[k] != k:
            k = least[k]
        return k

    for a, b in brute_pairs(sets, percent):
        low, high = sorted((top(a), top(b)))
        least[high] = low
    return sorted(k for k in sets if top(k) == k)


def kept(frame):
    return sorted(r["doc_id"] for r in simhash.keep_one_similar(frame).select("doc_id").collect())


def test_every_document_of_the_small_table(spark, folder):
    texts = dict(duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall())
    assert kept(spark.read.parquet(f"{folder}/documents.parquet")) == brute_kept(texts)


def test_recall_on_pairs_of_the_middle_table(spark, middle):
    texts = dict(duckdb.sql(f"select max(doc_id), text from '{middle}/documents.parquet' group by text").fetchall())
    stay = set(kept(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(16)))
    want = set(brute_kept(texts))
    # No text goes without a partner, and at least nine in ten of those with one do.
    assert want <= stay and len(texts) - len(stay) >= 0.9 * (len(texts) - len(want))


def test_planted_copies_with_changed_words(spark):
    rng = random.Random(5)
    texts = {}
    for i in range(0, 600, 2):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 600))]
        texts[i] = " ".join(words)
        for at in rng.sample(range(len(words)), max(1, len(words) // 60)):
            words[at] = "changed"
        texts[i + 1] = " ".join(words)
    linked = {b for _, b in brute_pairs(brute_sets(texts))}
    stay = set(kept(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert len(linked) > 200 and set(texts) - stay <= linked and len(linked & stay) <= 0.1 * len(linked)


def test_crowd_of_near_copies_keeps_one(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(400):
        words = list(base)
        words[rng.randrange(len(words))] = f"own{i}"
        texts[i] = " ".join(words)
    texts[1000] = "quite another text of more than five words"
    assert kept(spark.createDataFrame(list(texts.items()), "doc_id long, text string")) == brute_kept(texts) == [0, 1000]


def test_odd_rows(spark):
    long = "one two three four five six " * 20_000
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "A b"), (4, "a  B"), (5, "a b"), (None, "a b"), (None, "x y"), (6, long), (7, long + "seven"),
        (8, "a b c"), (None, None),
    ]
    names = ["rec", "id", "row", "n", "node", "key", "digest", "root", "size", "signature", "s", "first"]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(c).alias(c) for c in names])
    out = simhash.keep_one_similar(frame)
    assert out.columns == frame.columns and all(r[c] == c for r in out.collect() for c in names)
    # Rows without words all stay; one row of id 4 stands for "a b"; a row without an id stays only alone.
    assert sorted((r["doc_id"] or 0 for r in out.collect())) == [0, 0, 1, 2, 3, 4, 6, 8]
    assert simhash.keep_one_similar(frame.limit(0)).count() == 0


def test_bits_count_the_majority_and_parts_cover_all_bits():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 256, (2, 336), dtype=np.uint8)
    other = prints.copy()
    other[0, 7] ^= 16
    same = simhash.part_keys(prints, 28) == simhash.part_keys(other, 28)
    assert same[1].all() and (~same[0]).sum() == 2  # one bit is in one part of each partition
    three = np.sort(rng.integers(0, 1 << 63, 3, np.uint64))
    single = np.array([np.unpackbits(simhash.wide_fingerprint(three[i : i + 1], 128)) for i in range(3)])
    assert (np.unpackbits(simhash.wide_fingerprint(three, 128)) == (single.sum(axis=0) >= 2)).all()
    many = np.sort(rng.integers(0, 1 << 63, 600, np.uint64))
    single = np.array([np.unpackbits(simhash.wide_fingerprint(many[i : i + 1], 128)) for i in range(599)])
    assert (np.unpackbits(simhash.wide_fingerprint(many[:599], 128)) == (single.sum(axis=0) >= 300)).all()
    assert not simhash.wide_fingerprint(many[:0], 128).any()
    assert len(list(itertools.chain(simhash.part_keys(prints, 28)[0]))) == 192


def test_correlated_bits_of_wide_fingerprints_share_a_part(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (400, 224), dtype=np.uint8)
    # Bits 3, 10, 17, ... of the first 112 repeat one another, spread over the four parts of neighbouring bits.
    tied = np.arange(3, 112, 7)
    x[:, tied] = x[:, [3]]
    rows = [(bytearray(r),) for r in np.packbits(x, axis=1)]
    layout = simhash.wide_layout(spark.createDataFrame(rows, "signature binary").repartition(3), 224, 28)
    assert layout.shape == (16, 28) and all(sorted(half.ravel()) == list(range(224)) for half in (layout[:8], layout[8:]))
    assert sum(set(tied) <= set(part) for part in layout[:8].tolist()) == 1
    empty = simhash.wide_layout(spark.createDataFrame([], "signature binary"), 224, 28)
    assert all(sorted(half.ravel()) == list(range(224)) for half in (empty[:8], empty[8:]))


def test_crowded_parts_give_their_threshold_to_light_ones():
    rng = np.random.default_rng(6)
    assert simhash.wide_thresholds([1000.0] * 16, 1000, 28) == [0] * 16
    thresholds = simhash.wide_thresholds([1e9, *[1000.0] * 15], 1000, 28)
    assert thresholds[0] == -1 and sorted(thresholds[1:8]) == [0] * 6 + [1] and thresholds[8:] == [0] * 8
    # Pairs that differ in fewer bits than a partition has parts always share a key in it.
    layout = simhash.even_layout(224, 28)
    for _ in range(50):
        x = rng.integers(0, 2, (2, 224), dtype=np.uint8)
        x[1] = x[0]
        x[1, rng.choice(224, 7, replace=False)] ^= 1
        a, b = simhash.part_keys(np.packbits(x, axis=1), 28, layout[:8], thresholds[:8])
        assert len(a) == 6 + 28 and (a == b).any()
