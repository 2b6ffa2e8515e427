"""MinHash near duplicates, collocations and centroid clusters against brute force, and on odd input."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids, collocations, minhash

CLASHES = ["rec", "id", "row", "n", "node", "key", "digest", "root", "kept", "q", "v", "best", "cluster", "rank", "phrase", "words", "a"]


def clashing(df, *but):
    return df.select("*", *[F.lit(c).alias(c) for c in CLASHES if c not in but])


# 12: MinHash


def brute_sets(texts, words=5):
    out = {}
    for k, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out[k] = {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()
    return out


def brute_components(sets, percent=85):
    least = {k: k for k in sets}

    def top(k):
        while least[k] != k:
            k = least[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((top(a), top(b)))
            least[high] = low
    return {k: top(k) for k in sets}


def near_rows(spark, texts, **more):
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    return {r["doc_id"]: r for r in minhash.near_duplicates(docs, carry=["doc_id"], **more).collect()}


def test_near_copies_like_brute_force(spark):
    rng = random.Random(5)
    texts = {}
    for base in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 40, 90, 200]))]
        for copy in range(rng.choice([1, 3, 9])):
            text = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = f"x{rng.randrange(100)}"
            texts[len(texts)] = " ".join(text)
    sets = brute_sets(texts)
    for direct in (0, 8):
        rows = near_rows(spark, texts, direct=direct)
        assert {k: r["component_id"] for k, r in rows.items()} == brute_components(sets)
    assert all(r["n_shingles"] == len(sets[k]) and r["kept"] == (r["component_id"] == k) for k, r in rows.items())


def test_a_crowd_around_one_text_is_one_component(spark):
    """Copies are linked with the base, hardly with each other: the base has to lead its band values."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = {100: " ".join(base)}
    for k in range(40):
        text = list(base)
        for i in rng.sample(range(10, 190), 3):
            text[i] = f"x{k}"
        texts[k] = " ".join(text)
    rows = near_rows(spark, texts)
    assert {k: r["component_id"] for k, r in rows.items()} == brute_components(brute_sets(texts))


def test_links_inside_a_crowd_that_its_leader_does_not_reach(spark):
    """Texts with many changes, some shared by a few, and cut ones of other lengths: nothing is lost without all pairs."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(160)]
    texts = {}
    for k in range(90):
        text = list(base[: rng.choice([160, 150, 140, 130])])
        for i in rng.sample(range(len(text)), rng.choice([1, 4, 5, 6])):
            text[i] = f"x{rng.choice([k, k % 7])}"
        texts[k] = " ".join(text)
    want = brute_components(brute_sets(texts))
    rows = near_rows(spark, texts, direct=0)
    assert {k: r["component_id"] for k, r in rows.items()} == want and 1 < len(set(want.values())) < 90


def test_chains_are_followed(spark):
    """Neighbours are linked, ends are not: a sliding text of 40 steps is one component."""
    words = [f"w{i}" for i in range(500)]
    texts = {100 - k: " ".join(words[4 * k : 4 * k + 100]) for k in range(40)}
    rows = near_rows(spark, texts)
    assert {k: r["component_id"] for k, r in rows.items()} == brute_components(brute_sets(texts))
    assert len({r["component_id"] for r in rows.values()}) == 1


def test_near_copies_of_odd_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, " \t\x0b"), (4, "A b"), (5, "a  B"), (5, "a b"), (None, "a b"), (None, None), (6, long), (7, long + " end"), (8, "a b c")]
    base = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "k long, doc_id long, text string")
    docs = clashing(base, "k")
    out = minhash.near_duplicates(docs)
    assert set(docs.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))
    rows = {r["k"]: r for r in out.collect()}
    assert len(rows) == len(texts)
    assert [rows[k]["component_id"] for k in range(len(texts))] == [1, 2, 3, 4, 4, 4, 4, None, 6, 6, 8]
    assert [rows[k]["n_shingles"] for k in (0, 1, 2, 3, 8, 10)] == [0, 0, 0, 1, 59_996, 1]
    assert rows[7]["kept"] and not rows[6]["kept"]
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_alternating_stars(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(5, 5)] + [(1000 + i, 1001 + i) for i in range(30)]
    least = {k: k for e in edges for k in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    found = {r["node"]: r["root"] for r in minhash.alternating_stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: v for k, v in least.items() if k != v}
    assert minhash.alternating_stars(spark.createDataFrame([], "a long, b long")).collect() == []


def test_minima_agree_as_often_as_sets():
    rng = np.random.default_rng(4)
    both = rng.integers(0, 1 << 63, 1700).astype(np.uint64)
    a, b = both[:1500], both[200:]
    share = (minhash.minima(a, 2000, 1) == minhash.minima(b, 2000, 1)).mean()
    assert abs(share - 1300 / 1700) < 0.04
    assert minhash.cutoff(160, 0.85) < 120


# 11: collocations


def brute_collocations(rows, least, covered, top):
    counts, sizes = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            sizes[lang] = sizes.get(lang, 0) + len(w)
            for m in (1, 2, 3):
                for i in range(len(w) - m + 1):
                    key = lang, tuple(w[i : i + m])
                    counts[key] = counts.get(key, 0) + 1
    out = {}
    often = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    for (lang, p), a in often.items():
        if any(lang == o and len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and 100 * n >= covered * a for (o, q), n in often.items()):
            continue
        score, k = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, sizes[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])
    )


def phrases_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("most", [1_000_000, 0])
@pytest.mark.parametrize("shards", [1, 3])
def test_collocations_like_brute_force(spark, shards, most):
    """With broadcast word lists and without, in one shard and in three, in short runs: the same rows."""
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        n = rng.randrange(0, 30)
        words = [rng.choice(["a", "B", "c,", "d", "é.", "New York", "e\t f", "g", "\x1c"]) for _ in range(n)]
        rows.append((rng.choice(["en", "de", None, "und"]), rng.choice([" ", "  "]).join(words)))
    rows += [("en", None), (None, ""), ("en", ",;.\n \t"), ("xx", "rare words here")] + [("en", "hot phrase of many words")] * 150
    docs = clashing(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    found = collocations.collocations(docs, least=10, top=25, shards=shards, max_broadcast_rows=most, run=500)
    assert phrases_of(found) == brute_collocations(rows, 10, 50, 25)


def test_collocations_of_little(spark):
    docs = spark.createDataFrame([("en", "a b"), ("en", "a b")], "lang string, text string")
    assert phrases_of(collocations.collocations(docs, least=3)) == []
    assert phrases_of(collocations.collocations(docs.limit(0))) == []
    assert phrases_of(collocations.collocations(docs, least=2)) == [("en", 1, "a b", 2, 2, 2, 4, 10**6)]


# 13: centroids


def brute_clusters(vectors, clusters, rounds):
    q = {k: [math.floor(1024 * x) for x in v] for k, v in vectors.items()}
    centres = [q[k] for k in sorted(q, key=lambda k: hashlib.sha256(f"3:{k}".encode()).hexdigest())[:clusters]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for v in q.values():
            groups.setdefault(near(v)[1], []).append(v)
        for k, vs in groups.items():
            centres[k] = [sum(c) // len(vs) for c in zip(*vs)]
    return {k: near(v) for k, v in q.items()}, centres


def test_clusters_like_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = {int(k): [float(x) for x in rng.normal(k % 5, 0.7, 6)] for k in range(300)}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    want, centres = brute_clusters(vectors, 8, 10)
    for scale in (1.0, 3e4):
        # Long integers first; components this large go through decimals.
        if scale > 1:
            vectors = {k: [x * scale for x in v] for k, v in vectors.items()}
            rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
            want, centres = brute_clusters(vectors, 8, 10)
        found = centroids.cluster(rows, width=6).collect()
        assert {r["vec_id"]: (r["distance"], r["cluster"]) for r in found} == want
        assert {r["inertia"] for r in found} == {sum(d for d, _ in want.values())}
        for r in found:
            assert r["cluster_inertia"] == sum(d for d, k in want.values() if k == r["cluster"])
            assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


def test_clusters_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (8, [-0.0001, 0.0])]
    base = spark.createDataFrame([(k, *d) for k, d in enumerate(data)], "k long, vec_id long, embedding array<double>")
    docs = clashing(base, "k")
    rows = centroids.cluster(docs, clusters=2, rounds=3, width=2).collect()
    assert sorted(r["k"] for r in rows) == [0, 1, 2, 8]
    assert len({r["cluster"] for r in rows if r["k"] < 2}) == 1
    assert centroids.cluster(docs.limit(0), width=2).collect() == []
    assert len({r["cluster"] for r in centroids.cluster(docs, clusters=50, rounds=1, width=2).collect()}) == 3
