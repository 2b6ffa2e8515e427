"""MinHash near duplicates: universal hash minima, banding, signatures, exact sets, components by alternating stars.

Texts with one shingle set are one node. A node's ``bands * band_rows`` minima are cut into bands; nodes that share a band
meet. A crowd is never paired with itself at once: each band value first compares its best linked member with all
others, and only members that are still apart meet each other. In a crowd they do so only where the parts of their sets
outside the leader's set touch, or where sizes alone leave a link open; no other pair can be linked. Pairs are sifted by how many minima agree and confirmed on
the full sets, so every link is exact; a link at the threshold is missed by all bands with a chance of
(1 - threshold ** band_rows) ** bands, 7e-9 as given.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, record, unpack
from tidemark.session import cut_lineage

CACHE_WORDS = 300_000
_word_hashes: dict[bytes, int] = {}


def _hashes_of(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; those seen before come from a bounded memory."""
    if len(_word_hashes) > CACHE_WORDS:
        _word_hashes.clear()
    known = _word_hashes
    for w in set(tokens).difference(known):
        known[w] = xxhash.xxh64_intdigest(w, 7)
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


@lru_cache(maxsize=8)
def _factors(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit number over each other (a fixed bijection)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``words``-word shingles; with fewer words the whole sequence is one shingle,
    without words the set is empty. Only A-Z change case, only ASCII white space parts words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = _hashes_of(tokens)
    size = min(words, len(tokens))
    factors = _factors(words + 1, 5)
    # The number of words is part of the hash, so a short text is no shingle of another size.
    total = np.full(len(tokens) - size + 1, size * int(factors[words]) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(size):
        total += hashes[i : len(tokens) - size + 1 + i] * factors[i]
    return np.unique(_mix(total))


def minima(shingles: np.ndarray, count: int, seed: int) -> np.ndarray:
    """The least value of each of ``count`` universal hashes (a x + b) >> 32 over 32 bits of the shingles."""
    a, b = _factors(count, seed)[:, None], _factors(count, seed + 1)[:, None]
    least = np.full(count, 0xFFFFFFFF, np.uint64)
    x = shingles >> np.uint64(32)
    for start in range(0, len(x), 512):
        values = a * x[None, start : start + 512]
        values += b
        np.minimum(least, values.min(axis=1) >> np.uint64(32), out=least)
    return least.astype(np.uint32)


def band_keys(signature: np.ndarray, bands: int, seed: int) -> np.ndarray:
    """One 64-bit key for each band; bands have different keys for equal minima."""
    rows = signature.astype(np.uint64).reshape(bands, -1)
    total = rows * _factors(rows.shape[1], seed)[None, :]
    return _mix(total.sum(axis=1, dtype=np.uint64) + _factors(bands, seed + 1)).view(np.int64)


def sketch(text: Column, words: int, bands: int, band_rows: int, seed: int) -> Column:
    """struct(n, digest, signature, keys): set size, 128-bit digest of the set, minima, band keys (none for an empty set)."""

    @F.pandas_udf("n long, digest binary, signature binary, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            s = shingle_set(t, words)
            if len(s):
                m = minima(s, bands * band_rows, seed)
                out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), m.tobytes(), band_keys(m, bands, seed + 2)))
            else:
                out.append((0, b"", b"", np.empty(0, np.int64)))
        return pd.DataFrame(out, columns=["n", "digest", "signature", "keys"])

    return of(text)


def cutoff(count: int, share: float, miss: float = 1e-12) -> int:
    """The most minima out of ``count`` that a pair of similarity ``share`` agrees in less often than with chance ``miss``."""
    tail = 0.0
    for k in range(count + 1):
        tail += comb(count, k) * share**k * (1 - share) ** (count - k)
        if tail > miss:
            return k
    return count


def alternating_stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; root is the least node that it can reach.

    Large-star links every larger neighbour of a node to the least of its neighbourhood, small-star every smaller one
    and the node itself; both repeat until nothing changes, when each component is a star around its least node. Each step
    is stored, so a lost executor repeats one step at most. Loops and repeated edges are allowed.
    """
    stars = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    while True:
        state = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return stars.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = state
        both = stars.unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("v", "m"))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u <> v")
        large = cut_lineage(large.distinct())
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select("u", "m").filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        stars = cut_lineage(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct())


def agreeing_minima(share: float, count: int) -> Callable[[Column, Column], Column]:
    """Whether two signatures of ``count`` minima agree in as many as a pair of similarity ``share`` does, but for a chance of 1e-12."""
    least = cutoff(count, share)

    @F.pandas_udf("boolean")
    def agreeing(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([bool((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum() >= least) for x, y in zip(left, right)], dtype="bool")

    return agreeing


def _confirmed(pairs: DataFrame, nodes: DataFrame, percent: int, sift: Callable[[Column, Column], Column]) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= ``percent`` * union, first sifted by size and signature."""

    @F.pandas_udf("long")
    def common(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)], dtype="int64")

    # Sizes alone bound the similarity; they travel with the candidates.
    pairs = pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).distinct()
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("signature").alias(f"s{side}")), side)
    pairs = cut_lineage(pairs.filter(sift(F.col("sa"), F.col("sb"))).drop("sa", "sb"))
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}")), side)
    both = pairs.select("a", "b", (F.col("na") + F.col("nb")).alias("sum"), common("sa", "sb").alias("same"))
    return cut_lineage(both.filter(F.col("same") * 100 >= (F.col("sum") - F.col("same")) * percent).select("a", "b"))


def _apart(members: DataFrame, links: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(members of band values that still hold more than one component, with ``root``; roots of all linked nodes)"""
    roots = alternating_stars(reduce(DataFrame.unionByName, links))
    rooted = members.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = cut_lineage(rooted)
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    return cut_lineage(rooted.join(split, "key")), roots


def _led(members: DataFrame, among: DataFrame) -> DataFrame:
    """Pairs of each band value's leader, the member of ``among`` that meets most others, with the members of other roots."""
    leader = among.groupBy("key").agg(F.max(F.struct("crowd", "node", "n", "root")).alias("l"))
    pairs = members.join(leader, "key").filter(F.col("root") != F.col("l.root"))
    return pairs.select(F.col("l.node").alias("a"), F.col("node").alias("b"), F.col("l.n").alias("na"), F.col("n").alias("nb"))


def _crowded(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of members with different roots that may be linked, without meeting all pairs of a crowd.

    With L the leader's set, two sets share at most min(|X & L|, |Y & L|) shingles inside L and those of X - L and Y - L that
    are equal outside. So a pair needs an equal shingle outside L, or sizes that leave the bound inside L open: the latter
    takes a set smaller than L, as at least one of the two is not linked with the leader.
    """
    leader = members.groupBy("key").agg(F.max(F.struct("crowd", "node", "n", "root")).alias("l"))
    led = members.join(leader, "key").select(F.col("l.node").alias("lead"), F.col("l.n").alias("nl"), F.col("l.root").alias("rl"), "node", "n", "root")
    led = led.distinct()

    @F.pandas_udf("array<long>")
    def outside(own: pd.Series, led_by: pd.Series) -> pd.Series:
        return pd.Series([np.setdiff1d(x, y, assume_unique=True) for x, y in zip(own, led_by)])

    for side in ("node", "lead"):
        led = led.join(nodes.select(F.col("node").alias(side), F.col("shingles").alias(f"s_{side}")), side)
    led = led.select("lead", "nl", "rl", "node", "n", "root", outside("s_node", "s_lead").alias("extra"))
    led = cut_lineage(led.withColumn("inner", F.col("n") - F.size("extra")))
    lowest = led.groupBy("lead").agg(F.min("n").alias("smallest"))
    # How many equal shingles outside L every link of X needs, whatever the other set is. So a link shows among the rarest
    # |X - L| - need + 1 of them on both sides, and shingles that nobody else has keep most sets apart.
    other_size = F.greatest(F.ceil(F.col("n") * percent / 100), "smallest")
    need = F.greatest(F.lit(1), F.ceil((F.col("n") + other_size) * percent / (100 + percent)) - F.col("inner"))
    apart = led.join(lowest, "lead").select("lead", "node", "n", "root", (F.size("extra") - need + 1).cast("int").alias("first"), F.explode("extra").alias("s"))
    apart = cut_lineage(apart.filter("first > 0"))
    held = apart.groupBy("lead", "s").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
    rarest = apart.join(held, ["lead", "s"]).groupBy("lead", "node", "n", "root", "first").agg(
        F.sort_array(F.collect_list(F.struct("c", "s", (F.col("low") < F.col("high")).alias("met")))).alias("order")
    )
    rarest = rarest.select("lead", "node", "n", "root", F.explode(F.slice("order", F.lit(1), F.col("first"))).alias("o")).filter("o.met")
    rarest = cut_lineage(rarest.select("lead", "node", "n", "root", F.col("o.s").alias("s")))
    sides = [rarest.select("lead", "s", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "root")]) for x in "ab"]
    shared = sides[0].join(sides[1], ["lead", "s"]).filter("node_a < node_b AND root_a <> root_b")
    # Nothing equal outside L: 100 i >= percent (na + nb - i) with i at most |X & L| bounds the other set's size.
    open_to = F.floor(F.col("inner") * (100 + percent) / percent - F.col("n"))
    one = led.filter("root <> rl").select("lead", F.col("node").alias("node_a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"), open_to.alias("most"))
    one = one.join(lowest, "lead").filter("most >= smallest")
    other = led.filter("n < nl").select(
        "lead", F.col("node").alias("node_b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"),
        F.floor(F.col("inner") * (100 + percent) / percent - F.col("n")).alias("most_b"),
    )
    sized = one.join(other, "lead").filter("n_b <= most AND n_a <= most_b AND root_a <> root_b")
    pairs = [p.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("n_a").alias("na"), F.col("n_b").alias("nb")) for p in (shared, sized)]
    return pairs[0].unionByName(pairs[1])


def linked_roots(
    rows: DataFrame, members: DataFrame, words: int, percent: int, sift: Callable[[Column, Column], Column], direct: int = 8
) -> DataFrame:
    """(node, root) for the nodes of ``members`` that are linked, but the roots; root is the least node that they can reach.

    ``members`` (key, size, node, n) says which nodes of ``rows`` (row, text, signature; row is the node) share a key, whose
    crowd has ``size`` nodes, and how many shingles each has. ``sift`` says whether two signatures may belong to a linked pair.
    Links are confirmed on the full sets. Runs its joins while it builds the result.
    """
    crowds = members.groupBy("node").agg(F.sum("size").alias("crowd"))
    members = cut_lineage(members.join(crowds, "node").select("key", "node", "n", "crowd", F.col("node").alias("root")))

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words).view(np.int64) for t in texts])

    nodes = rows.join(crowds.select(F.col("node").alias("row")), "row", "left_semi")
    nodes = cut_lineage(nodes.select(F.col("row").alias("node"), "signature", shingles("text").alias("shingles")))

    links = [_confirmed(_led(members, members), nodes, percent, sift)]
    # A second leader from outside the first one's component takes in what the first could not reach.
    apart, roots = _apart(members, links)
    first = apart.groupBy("key").agg(F.max(F.struct("crowd", "node", "n", "root")).alias("l")).select("key", F.col("l.root").alias("done"))
    others = apart.join(first, "key").filter("root <> done").drop("done")
    links.append(_confirmed(_led(apart, others), nodes, percent, sift))
    apart, roots = _apart(apart, links)
    # Few members meet each other directly; both ways find the same links.
    fill = apart.groupBy("key").agg(F.count("*").alias("fill"))
    apart = cut_lineage(apart.join(fill, "key"))
    few = apart.filter(F.col("fill") <= direct)
    left = few.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    right = few.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    pairs = left.join(right, "key").filter("a < b AND ra <> rb").select("a", "b", "na", "nb")
    pairs = pairs.unionByName(_crowded(apart.filter(F.col("fill") > direct).drop("fill"), nodes, percent))
    links.append(_confirmed(pairs, nodes, percent, sift))
    return alternating_stars(reduce(DataFrame.unionByName, links))


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    carry: list[str] | None = None,
    words: int = 5,
    percent: int = 85,
    bands: int = 32,
    band_rows: int = 5,
    seed: int = 11,
    direct: int = 8,
) -> DataFrame:
    """Every row with ``n_shingles``, ``component_id`` (the smallest id reachable over links) and ``kept`` (it is the own id).

    Two texts are linked when their sets of distinct ``words``-word shingles have 100 * intersection >= ``percent`` * union.
    Null and wordless texts have an empty set and are linked with nothing, not even each other. Rows with equal sets are one
    node. A null id is a component id only where a component has no other. Rows of equal ids and linked texts are all
    ``kept`` where that id is the smallest. An empty table gives no rows. ``carry`` names the input columns that are kept
    (all if not given); results replace columns of their names. Runs its joins while it builds the result.
    """
    columns = docs.columns if carry is None else carry
    rows = docs.select(record(docs, columns), col(id_col).alias("id"), col(text).alias("text"))
    rows = rows.withColumn("s", sketch(col("text"), words, bands, band_rows, seed)).withColumn("row", F.monotonically_increasing_id())
    rows = cut_lineage(rows.select("rec", "id", "row", "text", "s.n", "s.digest", "s.signature", "s.keys"))
    owners = cut_lineage(rows.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("id").alias("least")))

    keyed = rows.select(F.col("row").alias("node"), "n", "keys").join(owners.select("node"), "node", "left_semi")
    keyed = cut_lineage(keyed.select("node", "n", F.explode("keys").alias("key")))
    met = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = cut_lineage(keyed.join(met, "key"))
    sift = agreeing_minima(percent / 100, bands * band_rows)
    roots = linked_roots(rows, members, words, percent, sift, direct)

    owned = owners.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = owned.groupBy("root").agg(F.min("least").alias("component"))
    owned = owned.join(smallest, "root").select("digest", "component")
    out = rows.select("rec", "id", "n", "digest").join(owned, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return unpack(out, columns, n_shingles=F.col("n"), component_id=component, kept=component.eqNullSafe(F.col("id")))
