"""SimHash near duplicates found by the generalised pigeonhole principle.

A pair within ``distance`` bits agrees within t_i bits on at least one part i, for any thresholds that sum to
distance - parts + 1 (a threshold of -1 leaves a part out). Correlated bits go to one part, so that the crowded
values meet in few parts, and a dynamic programme gives each part the threshold that makes the estimated candidates
and probes fewest. Candidates are verified on all 64 bits.

:func:`keep_one_similar` decides by the similarity of shingle sets instead. Texts that share 0.8 of their shingles differ in 15 %
of the bits, more than 64 bits can tell by parts. So it takes several fingerprints a text, 2688 bits as given, in two
partitions, each planned in the same way: bits grouped by correlation, thresholds by the dynamic programme for a distance of one bit
less than it has parts. Within that distance every pair is met, beyond it by chance; candidates are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, record, unpack
from tidemark.llm.components import components
from tidemark.llm.minhash import linked_roots, shingle_set
from tidemark.session import cut_lineage

BITS = 64


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the ``words``-word shingles of one text, as a signed integer; null and wordless texts give 0.

    Only A-Z are lower-cased and only ASCII white space parts words, which is what bytes methods do.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*[tokens[i:] for i in range(words)]))
    counts = np.zeros(BITS, np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def add_fingerprint(docs: DataFrame, text: Column, words: int = 3, seed: int = 42, name: str = "fp") -> DataFrame:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words, seed) for t in texts], dtype="int64")

    return docs.withColumn(name, of(text))


def bit_correlation(prints: DataFrame) -> np.ndarray:
    """Absolute correlations of the 64 bits over all rows of ``prints`` (column fp); sums of 64x64 counts per task."""

    def count(batches):
        both, ones, n = np.zeros((BITS, BITS), np.int64), np.zeros(BITS, np.int64), 0
        for batch in batches:
            x = np.unpackbits(batch["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            x = x.astype(np.float32)
            both += np.rint(x.T @ x).astype(np.int64)
            ones += x.sum(axis=0, dtype=np.float64).astype(np.int64)
            n += len(x)
        yield pd.DataFrame({"cell": np.arange(BITS * BITS + 1), "n": np.append(both.ravel(), n)})

    rows = prints.select("fp").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return _correlation(cells[:-1].reshape(BITS, BITS), cells[-1])


def _correlation(ones: np.ndarray, rows: float) -> np.ndarray:
    """Absolute correlations of bits, of which two are both set ``ones[i, j]`` times in ``rows`` rows."""
    joint = ones / max(rows, 1)
    mean = joint.diagonal()
    spread = np.sqrt(mean * (1 - mean))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.abs((joint - np.outer(mean, mean)) / np.outer(spread, spread))
    return np.nan_to_num(corr)


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bits into ``parts`` groups of nearly equal size, each grown around its most correlated free bit."""
    free = list(range(len(corr)))
    groups = []
    for k in range(parts):
        size = len(free) // (parts - k)
        weight = corr[np.ix_(free, free)].sum(axis=1)
        group = [free.pop(int(weight.argmax()))]
        while len(group) < size:
            tie = corr[np.ix_(free, group)].sum(axis=1)
            group.append(free.pop(int(tie.argmax())))
        groups.append(sorted(group))
    return groups


def ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def allocate(costs: Sequence[Sequence[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum ``total`` and the least summed cost; ``costs[i][t]`` is the cost of t >= 0, -1 costs
    nothing. Dynamic programme over parts and the sum so far."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, len(row)):
                c = cost + (row[t] if t >= 0 else 0.0)
                if spent + t not in step or c < step[spent + t][0]:
                    step[spent + t] = (c, [*chosen, t])
        best = step
    return best[total]


def _part_value(fp: Column, bits: Sequence[int]) -> Column:
    """The masked fingerprint names the value of a part; a mask keeps its bits in place."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _flips(bits: Sequence[int], radius: int) -> list[int]:
    masks = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(bits, r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def plan(prints: DataFrame, distance: int, part_counts: Sequence[int]) -> list[tuple[list[int], int]]:
    """The parts (bits, threshold) for self-joining ``prints`` (distinct fp).

    Estimates cover all rows: with n_v fingerprints of value v in a part, sum(n_v^2) bounds the pairs that meet under any
    one flip mask (Cauchy-Schwarz), so a threshold t costs at most ball(width, t) * (rows + sum(n_v^2)).
    """
    corr = bit_correlation(prints)
    layouts = {m: group_bits(corr, m) for m in part_counts}
    keys = [(m, i) for m in part_counts for i in range(m)]
    values = F.array(*[F.struct(F.lit(k).alias("k"), _part_value(col("fp"), layouts[m][i]).alias("v")) for k, (m, i) in enumerate(keys)])
    sizes = prints.select(F.inline(values)).groupBy("k", "v").agg(F.count("*").cast("double").alias("n"))
    load = {r["k"]: (r["rows"], r["pairs"]) for r in sizes.groupBy("k").agg(F.sum("n").alias("rows"), F.sum(col("n") * col("n")).alias("pairs")).collect()}
    options = []
    for m in part_counts:
        costs = [
            [ball(len(layouts[m][i]), t) * sum(load.get(keys.index((m, i)), (0.0, 0.0))) for t in range(distance + 1)]
            for i in range(m)
        ]
        cost, chosen = allocate(costs, distance - m + 1)
        options.append((cost, [(bits, t) for bits, t in zip(layouts[m], chosen)]))
    return min(options, key=lambda o: o[0])[1]


def links(prints: DataFrame, distance: int = 3, part_counts: Sequence[int] = (2, 3, 4)) -> DataFrame:
    """All pairs a < b of ``prints`` (distinct fp) that differ in at most ``distance`` bits; a pair may repeat."""
    found = None
    for bits, t in plan(prints, distance, part_counts):
        if t < 0:
            continue
        index = prints.select(_part_value(col("fp"), bits).alias("v"), col("fp").alias("a"))
        flips = F.explode(F.array(*[F.lit(m).cast("long") for m in _flips(bits, t)]))
        probe = prints.select("fp", flips.alias("flip")).select(
            _part_value(col("fp"), bits).bitwiseXOR(col("flip")).alias("v"), col("fp").alias("b")
        )
        near = F.bit_count(col("a").bitwiseXOR(col("b"))) <= distance
        pairs = probe.join(index.hint("shuffle_hash"), "v").filter((col("a") < col("b")) & near).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def _grouped(docs, text, id_col, columns, words, seed, distance, part_counts) -> tuple[DataFrame, DataFrame]:
    """(stored rows: rec, id, fp, row; owner: one row fp, root, component for each fingerprint)"""
    rows = docs.select(record(docs, columns), col(id_col).alias("id"), col(text).alias("text"))
    rows = add_fingerprint(rows, col("text"), words, seed).drop("text").withColumn("row", F.monotonically_increasing_id())
    rows = cut_lineage(rows)
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(prints.select("fp"), distance, part_counts))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rows, rooted.join(smallest, "root").select("fp", "root", "component")


def near_groups(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    carry: list[str] | None = None,
    words: int = 3,
    seed: int = 42,
    distance: int = 3,
    part_counts: Sequence[int] = (2, 3, 4),
) -> DataFrame:
    """Every row with ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links of at most
    ``distance`` differing bits.

    Null counts as empty; texts without words have fingerprint zero and link like any other. Rows with one fingerprint
    are one node, so copies are never paired. A null id is a component id only where a component has no other.
    An empty table gives no rows. ``carry`` names the input columns that are kept (all if not given); results replace
    columns of their names.
    """
    columns = docs.columns if carry is None else carry
    rows, owner = _grouped(docs, text, id_col, columns, words, seed, distance, part_counts)
    return unpack(
        rows.join(owner, "fp"), columns, fingerprint=F.lpad(F.lower(F.hex("fp")), 16, "0"), component_id=col("component")
    )


def keep_one(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    words: int = 3,
    seed: int = 42,
    distance: int = 3,
    part_counts: Sequence[int] = (2, 3, 4),
) -> DataFrame:
    """The row of the smallest id of each group of :func:`near_groups`, unchanged; of rows with equal ids exactly one stays,
    and a row without an id stays only where its group has no other."""
    rows, owner = _grouped(docs, text, id_col, docs.columns, words, seed, distance, part_counts)
    order = F.struct(F.col("id").isNull(), "id", "row")
    firsts = rows.groupBy("fp").agg(F.min(order).alias("first"))
    stay = firsts.join(owner, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return unpack(rows.join(stay, "row", "left_semi"), docs.columns)


def wide_fingerprint(shingles: np.ndarray, bits: int, seed: int = 42) -> np.ndarray:
    """SimHash of ``bits`` bits (a multiple of 64) of a sorted set of 64-bit shingle hashes, as packed bytes. A bit is 1 if set in over
    half the shingles; where exactly half have it, a hash of the least shingle decides. An empty set gives zeros."""
    words = bits // 64
    a, b = np.random.default_rng(seed).integers(0, 1 << 63, (2, words + 1), np.uint64) * np.uint64(2) + np.uint64(1)

    def spread(x: np.ndarray) -> np.ndarray:
        x = x[:, None] * a[None, :words] + b[None, :words]
        for factor in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15):
            x ^= x >> np.uint64(32)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(32)
        return np.unpackbits(x.view(np.uint8), axis=1)

    twice = np.zeros(bits, np.int64)
    for start in range(0, len(shingles), 255):  # a block's sums fit a byte
        twice += 2 * spread(shingles[start : start + 255]).sum(axis=0, dtype=np.uint8).astype(np.int64)
    over = twice > len(shingles)
    if len(shingles) and len(shingles) % 2 == 0:
        over |= (twice == len(shingles)) & spread(shingles[:1] ^ a[words])[0].astype(bool)
    return np.packbits(over)


def even_layout(bits: int, part_bits: int) -> np.ndarray:
    """The bits of each part, (parts, part_bits): a partition in parts of neighbouring bits and one in parts of bits far apart."""
    order = np.arange(bits)
    return np.concatenate([order.reshape(-1, part_bits), order.reshape(part_bits, -1).T])


def wide_layout(prints: DataFrame, bits: int, part_bits: int, block_parts: int = 4) -> np.ndarray:
    """:func:`even_layout` with the bits of every ``block_parts`` parts of a partition dealt anew by :func:`group_bits`, so that correlated
    bits share a part. Correlations are those of all rows of ``prints`` (column signature); what chance alone explains (up to five times
    1 / sqrt(rows)) counts as none, and bits without any stay in their order."""
    even = even_layout(bits, part_bits)
    parts = len(even) // 2
    runs = [range(start, min(start + block_parts, end)) for base, end in ((0, parts), (parts, 2 * parts)) for start in range(base, end, block_parts)]
    blocks = [even[run.start : run.stop].ravel() for run in runs]
    upper = [np.triu_indices(len(block)) for block in blocks]
    cells = sum(len(u[0]) for u in upper)

    def count(batches):
        both, n = [np.zeros((len(block), len(block)), np.int64) for block in blocks], 0
        for batch in batches:
            for start in range(0, len(batch), 256):
                some = batch["signature"].iloc[start : start + 256]
                x = np.unpackbits(np.frombuffer(b"".join(some), np.uint8).reshape(len(some), bits // 8), axis=1)
                for sums, block in zip(both, blocks):
                    y = x[:, block].astype(np.float32)
                    sums += (y.T @ y).astype(np.int64)
                n += len(x)
        flat = np.concatenate([sums[u] for sums, u in zip(both, upper)] + [np.array([n])])
        yield pd.DataFrame({"cell": np.arange(cells + 1), "n": flat})

    found = prints.select("signature").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    ones = np.zeros(cells + 1)
    ones[found["cell"].to_numpy()] = found["n"].to_numpy()
    layout, at = [], 0
    for run, block, u in zip(runs, blocks, upper):
        joint = np.zeros((len(block), len(block)))
        joint[u] = joint.T[u] = ones[at : at + len(u[0])]
        at += len(u[0])
        corr = _correlation(joint, ones[-1])
        corr[corr * ones[-1] ** 0.5 <= 5] = 0
        layout += [block[group] for group in group_bits(corr, len(run))]
    return np.array(layout)


def wide_thresholds(pairs: Sequence[float], rows: int, part_bits: int, most: int = 1) -> list[int]:
    """Thresholds of the parts of two partitions, each for a distance of one less than its parts. ``pairs`` is sum(n_v^2) of each part.

    A threshold t hides t bits in turn, where at most 2^t values fall together, so it costs at most
    comb(part_bits, t) * (rows + 2^t * pairs). Thresholds are at most ``most``.
    """
    costs = [[comb(part_bits, t) * (rows + 2**t * n) for t in range(most + 1)] for n in pairs]
    parts = len(costs) // 2
    distance = parts - 1
    return [t for side in (costs[:parts], costs[parts:]) for t in allocate(side, distance - parts + 1)[1]]


def part_keys(prints: np.ndarray, part_bits: int, layout: np.ndarray | None = None, thresholds: Sequence[int] | None = None) -> np.ndarray:
    """Keys (rows, keys) of packed fingerprints: the values of all parts of ``layout`` (:func:`even_layout` if not given), with the part's
    number above the value. ``part_bits`` is at most 32.

    A part of threshold t > 0 has a key for each choice of t bits, in which these are hidden, so values within t bits share one; a part of
    threshold -1 has none. All are 0 if not given.
    """
    x = np.unpackbits(prints, axis=1)
    layout = even_layout(x.shape[1], part_bits) if layout is None else layout
    filled = np.zeros((len(x), len(layout), 32), np.uint8)
    filled[:, :, 32 - part_bits :] = x[:, layout]
    value = np.packbits(filled, axis=2).view(">u4")[:, :, 0].astype(np.int64)
    part, shown, above = [], [], []
    for i, t in enumerate([0] * len(layout) if thresholds is None else thresholds):
        for number, hidden in enumerate(combinations(range(part_bits), t) if t >= 0 else ()):
            part.append(i)
            shown.append(0xFFFFFFFF - sum(1 << b for b in hidden))
            above.append((number << 48) + (i << 32))
    return (value[:, part] & np.array(shown, np.int64)) + np.array(above, np.int64)


def keep_one_similar(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    words: int = 5,
    percent: int = 80,
    bits: int = 2688,
    part_bits: int = 28,
    seed: int = 42,
    direct: int = 8,
) -> DataFrame:
    """The row of the smallest id of each group of similar texts, unchanged.

    Two texts are linked when 100 * intersection >= ``percent`` * union of their sets of distinct ``words``-word shingles (fewer words:
    the whole sequence is one) and a part of their fingerprints agrees within its threshold; groups are what links reach. Links are exact,
    so no text leaves for a dissimilar one. Fingerprints that differ in fewer bits than a partition has parts always meet. With an angle of p half turns between two sets, a pair is met with a chance of about
    1 - (1 - (1 - p) ** part_bits) ** (2 * bits / part_bits): 0.87 at a similarity of 0.80, 0.98 at 0.85, 0.999 at 0.90.

    Null and wordless texts have an empty set: they are linked with nothing and all stay. Rows with equal sets are one node; of
    rows with equal ids in a group exactly one stays, and a row without an id stays only where its group has no other. An
    empty table gives no rows. Runs its joins while it builds the result.
    """
    size = bits // 8

    @F.pandas_udf("n long, digest binary, signature binary")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            s = shingle_set(t, words)
            out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"", wide_fingerprint(s, bits, seed).tobytes() if len(s) else b""))
        return pd.DataFrame(out, columns=["n", "digest", "signature"])

    def crowds(prints: DataFrame, layout: np.ndarray, thresholds: list[int]) -> tuple[DataFrame, DataFrame]:
        """(node, n, key) of all parts, and the keys that several nodes share, with their number."""

        @F.pandas_udf("array<long>")
        def keys(prints: pd.Series) -> pd.Series:
            x = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), size)
            # Unpacked bits take 14 kB a row, so few rows are open at a time.
            return pd.Series([row for start in range(0, len(x), 128) for row in part_keys(x[start : start + 128], part_bits, layout, thresholds)])

        keyed = prints.select("node", "n", F.explode(keys("signature")).alias("key"))
        return keyed, cut_lineage(keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))

    @F.pandas_udf("boolean")
    def sift(left: pd.Series, right: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(side), np.uint8).reshape(len(side), size) for side in (left, right))
        return pd.Series(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most)

    # Small sets differ by steps, so the sift is wide: half as many bits again as sets at the limit differ in.
    cosine = 2 * percent / (100 + percent)
    most = int(1.5 * bits * np.arccos(cosine) / np.pi)

    rows = docs.select(record(docs), col(id_col).alias("id"), col(text).alias("text"))
    rows = rows.withColumn("s", sketch(col("text"))).withColumn("row", F.monotonically_increasing_id())
    rows = cut_lineage(rows.select("rec", "id", "row", "s.n", "s.digest", "s.signature"))
    owners = cut_lineage(rows.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node")))

    prints = rows.select(F.col("row").alias("node"), "n", "signature").join(owners.select("node"), "node", "left_semi")
    prints = cut_lineage(prints)
    layout = wide_layout(prints, bits, part_bits)
    thresholds = [0] * len(layout)
    keyed, met = crowds(prints, layout, thresholds)
    # A value that one node has adds one pair, that with itself.
    part = F.shiftright("key", 32).cast("int").alias("part")
    shared = {r["part"]: r["more"] for r in met.groupBy(part).agg(F.sum((col("size") * col("size") - col("size")).cast("double")).alias("more")).collect()}
    total = prints.count()
    planned = wide_thresholds([total + shared.get(i, 0.0) for i in range(len(layout))], total, part_bits)
    if planned != thresholds:
        keyed, met = crowds(prints, layout, planned)
    members = cut_lineage(keyed.join(met, "key"))
    texts = rows.select("row", col("rec").getField(text).alias("text"), "signature")
    roots = linked_roots(texts, members, words, percent, sift, direct)

    # Rows of one set meet by its digest, others stand alone.
    owned = owners.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("id").isNull(), "id", "row")
    firsts = rows.filter("n > 0").groupBy("digest").agg(F.min(order).alias("first"))
    stay = firsts.join(owned, "digest").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    stay = stay.unionByName(rows.filter("n = 0").select("row"))
    return unpack(rows.join(stay, "row", "left_semi"), docs.columns)
