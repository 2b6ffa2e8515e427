"""Phrase collocations by dynamic itemset counting.

The texts are dealt to shards, which are scanned in a cycle; one scan counts words and longer phrases together. A longer
phrase is activated once both subphrases (all but its last word, all but its first) have reached the threshold: it is
counted from the next shard on until it has seen each shard once, however the cycle wraps. Phrases that cannot be
frequent are hardly ever counted.

A scan splits texts into words in Arrow batches and counts numbered words with numpy, a bounded run of words at a time.
Its counts of longer phrases are packed into a few bytes a phrase and dealt to buckets, and each bucket is summed up as a
whole, so that the many phrases that are not frequent never become rows. The most frequent words are numbered for that;
the others are known by the 64-bit hashes of their words, which are checked to be different for all words. Should two
words ever share one, the count starts again with another seed.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import col
from tidemark.session import cut_lineage

#: Characters that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Stands for the end of a piece; no UTF-8 text holds this byte.
END = b"\xff"
PLAIN = bytes.maketrans(bytes(range(65, 91)) + ENDS, bytes(range(97, 123)) + END * len(ENDS))
ROW = "length int, lang string, word string, h1 long, n long, numbered boolean, bucket int, packed binary"
SCANNED = pa.schema(
    [
        ("length", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("h1", pa.int64()), ("n", pa.int64()),
        ("numbered", pa.bool_()), ("bucket", pa.int32()), ("packed", pa.binary()),
    ]
)
NEVER = np.iinfo(np.int32).max
#: Words of the texts for each bucket of phrases, which one call sums up.
BUCKET = 2_000_000
#: Bits of a filter for each key, keys in one part, bits of all parts at most.
KEY_BITS, PART, MOST_BITS = 16, 500_000, 1 << 30


class Filter:
    """A Bloom filter of 64-bit keys in parts, each as large as its keys need; four bits of one 64-bit block stand for a key.

    A key that was entered is always found; others are found now and then, but always the same ones.
    """

    def __init__(self, parts: list[np.ndarray]):
        self.sizes = np.array([len(p) for p in parts], np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bits = np.concatenate(parts)

    def has(self, keys: np.ndarray) -> np.ndarray:
        part = part_of(keys, len(self.sizes))
        marks = marks_of(keys)
        return self.bits[self.starts[part] + block_of(keys, self.sizes[part])] & marks == marks


def mixed(parts: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of the parts."""
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out ^= part.astype(np.int64, copy=False).view(np.uint64)
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            out *= np.uint64(factor)
            out ^= out >> np.uint64(31)
    return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def block_of(keys: np.ndarray, blocks: np.ndarray | np.uint64) -> np.ndarray:
    # The high bits choose the part, so that the block and its bits come from the low ones, stirred once more.
    return ((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * blocks) >> np.uint64(32)


def marks_of(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), np.uint64)
    for shift in (0, 6, 12, 18):
        out |= np.uint64(1) << (keys >> np.uint64(shift) & np.uint64(63))
    return out


class Frequent:
    """Frequent words and pairs with the step that activated them.

    Up to a bound, words are numbered in the order of their coming and searched as sorted hashes. The other words and
    all pairs are in filters, one for each step that activated some. What a filter holds by mistake is counted like the
    rest, from the same step on in every scan, so that counts are whole; it falls to the threshold in the end.
    """

    def __init__(self):
        self.keys, self.numbers, self.acts = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.more: list[tuple[int, Filter]] = []
        self.pairs: list[tuple[int, Filter]] = []

    def number(self, hashes: np.ndarray, step: int, most: int) -> None:
        """Gives numbers to new words, ``most`` in all; those that a filter already holds keep to it."""
        new = np.sort(hashes[self.find(hashes)[1] == NEVER])[: max(0, most - len(self.keys))]
        keys = np.concatenate([self.keys, new])
        order = np.argsort(keys)
        added = np.arange(len(self.keys), len(keys), dtype=np.int32)
        self.keys, self.numbers = keys[order], np.concatenate([self.numbers, added])[order]
        self.acts = np.concatenate([self.acts, np.full(len(new), step, np.int32)])[order]

    def hashes(self) -> np.ndarray:
        """The hash of each number."""
        out = np.empty(len(self.keys), np.int64)
        out[self.numbers] = self.keys
        return out

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, activating step) of each word, NEVER as the step of those that are not frequent."""
        numbers, acts = np.full(len(hashes), -1), np.full(len(hashes), NEVER, np.int32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[at] == hashes
            numbers[hit], acts[hit] = self.numbers[at[hit]], self.acts[at[hit]]
        if self.more:
            keys = mixed([hashes])
            for step, some in reversed(self.more):
                acts[(numbers < 0) & some.has(keys)] = step
        return numbers, acts

    def pair_acts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The activating step of pairs of word hashes, NEVER of those that are not frequent."""
        keys, acts = mixed([first, second]), np.full(len(first), NEVER, np.int32)
        for step, some in reversed(self.pairs):
            acts[some.has(keys)] = step
        return acts


def grouped(parts: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """(the distinct rows of the parts in order, the sum of ``n`` or the count of each)."""
    if not len(parts[0]):
        return parts, np.zeros(0, np.int64)
    width = 64 if min(p.min() for p in parts) < 0 else int(max(p.max() for p in parts)).bit_length()
    if width * len(parts) < 64:
        key = reduce(lambda a, b: a << width | b, [p.astype(np.int64) for p in parts])
        if n is None:
            key, n = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key)
            key, n = key[order], n[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, n = key[starts], np.add.reduceat(n, starts)
        return [key >> width * i & (1 << width) - 1 for i in reversed(range(len(parts)))], n
    order = np.lexsort(parts[::-1])
    parts = [p[order] for p in parts]
    changes = reduce(np.logical_or, [p[1:] != p[:-1] for p in parts])
    starts = np.flatnonzero(np.concatenate([[True], changes]))
    n = np.diff(starts, append=len(order)) if n is None else np.add.reduceat(n[order], starts)
    return [p[starts] for p in parts], n


def packed(columns: list[np.ndarray]) -> bytes:
    """Long columns as compressed planes of bytes, the first one by its steps."""
    columns = [np.diff(columns[0], prepend=np.int64(0)), *columns[1:]]
    widths = [8 if c.min() < 0 else (int(c.max()).bit_length() + 7) // 8 for c in columns]
    planes = [np.ascontiguousarray(c).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in zip(columns, widths)]
    return len(columns[0]).to_bytes(4, "little") + bytes(widths) + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    size, widths, at = int.from_bytes(data[:4], "little"), data[4 : 4 + columns], 0
    planes = np.frombuffer(pa.decompress(data[4 + columns :], size * sum(widths), codec="zstd"), np.uint8)
    out = []
    for width in widths:
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = planes[at : at + size * width].reshape(width, size).T
        out.append(wide.reshape(-1).view("<i8"))
        at += size * width
    return [np.cumsum(out[0]), *out[1:]]


def words(text: str | None) -> list[bytes]:
    """The words of a text in order, A-Z in lower case; END stands wherever a piece ends."""
    plain = (text or "").encode("utf-8", "surrogatepass").translate(PLAIN)
    out = plain.replace(END, b" \xff ").split()
    out.append(END)
    return out


def numbers() -> defaultdict[bytes, int]:
    """Numbers of the words of one language in the order of their coming; the end of a piece is 0."""
    return defaultdict(itertools.count(1).__next__, {END: 0})


def joined(by_lang: dict[str, tuple[dict[bytes, int], list[np.ndarray]]], seed: int) -> tuple[np.ndarray, list, np.ndarray]:
    """(ids of all texts in one numbering, language and name of each number, hashes); number 0 is the end of a piece."""
    ids, names, digests = [], [("", b"")], [0]
    for lang, (known, texts) in by_lang.items():
        of_lang = np.concatenate(texts)
        ids.append(np.where(of_lang > 0, of_lang + np.int32(len(names) - 1), np.int32(0)))
        prefix = lang.encode("utf-8", "surrogatepass") + b"\t"
        for word in itertools.islice(known, 1, None):
            names.append((lang, word))
            digests.append(xxhash.xxh64_intdigest(prefix + word, seed) - (1 << 63))
    return np.concatenate(ids), names, np.array(digests, np.int64)


def scan(lengths: list[int], step: int, shards: int, frequent, buckets: int, seed: int, run: int):
    """A function over Arrow batches (lang, text) that gives rows of ROW: counts of the active phrases of ``lengths``.

    Words have a row each. Longer phrases are dealt to buckets, packed as word numbers, or as hashes where a word has none.
    """

    def start_in_window(acts: np.ndarray) -> np.ndarray:
        return (acts < step) & (step <= acts.astype(np.int64) + shards)

    def count(ids: np.ndarray, names: list, hashes: np.ndarray):
        if 1 in lengths:
            n = np.bincount(ids, minlength=len(names))
            n[0] = 0
            hit = np.flatnonzero(n)
            for at in range(0, len(hit), 100_000):
                part = hit[at : at + 100_000]
                columns = {"length": np.ones(len(part), np.int32), "h1": hashes[part], "n": n[part].astype(np.int64)}
                columns |= {"lang": [names[i][0] for i in part], "word": [names[i][1].decode("utf-8", "replace") for i in part]}
                yield _batch(columns, len(part))
        if frequent is None:
            return
        known = frequent.value
        numbers, acts = known.find(hashes)
        acts[0] = NEVER
        # Words without a number come after all numbers, in the order of this run.
        numbered = len(known.keys)
        codes, acts = np.where(numbers >= 0, numbers, numbered + np.arange(len(names))), acts[ids]
        for length in sorted(set(lengths) - {1}):
            late = np.maximum(acts[:-1], acts[1:])
            if length == 3:
                at = np.flatnonzero(late != NEVER)
                late[at] = known.pair_acts(hashes[ids[at]], hashes[ids[at + 1]])
                late = np.maximum(late[:-1], late[1:])
            at = np.flatnonzero(start_in_window(late))
            parts, n = grouped([codes[ids[at + i]] for i in range(length)])
            plain = reduce(np.logical_and, [p < numbered for p in parts])
            yield from phrases(length, True, [p[plain] for p in parts], n[plain])
            if not plain.all():
                of_code = np.concatenate([known.hashes(), hashes])
                yield from phrases(length, False, [of_code[p[~plain]] for p in parts], n[~plain])

    def phrases(length: int, numbered: bool, parts: list[np.ndarray], n: np.ndarray):
        if not len(n):
            return
        bucket = part_of(mixed(parts), buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
        columns = [c[order] for c in (*parts, n)]
        used, starts = np.unique(bucket[order], return_index=True)
        data = [packed([c[a:b] for c in columns]) for a, b in itertools.pairwise([*starts, len(n)])]
        size = len(used)
        yield _batch({"length": np.full(size, length, np.int32), "numbered": np.full(size, numbered), "bucket": used.astype(np.int32), "packed": data}, size)

    def work(batches):
        by_lang, held = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in by_lang:
                    by_lang[lang] = numbers(), []
                known, texts = by_lang[lang]
                tokens = words(text)
                texts.append(np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens)))
                held += len(tokens)
                if held >= run:
                    yield from count(*joined(by_lang, seed))
                    by_lang, held = {}, 0
        if held:
            yield from count(*joined(by_lang, seed))

    return work


def _batch(columns: dict, size: int) -> pa.RecordBatch:
    """Rows of ROW, null in the columns that are not given."""
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in SCANNED]
    return pa.RecordBatch.from_arrays(arrays, schema=SCANNED)


def _total(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).groupBy(*keys).agg(F.sum("n").alias("n"))


def _reached(tables: list[DataFrame], length: int, least: int, known: Frequent) -> DataFrame:
    """h1, ..., n of the phrases of ``length`` that reach ``least`` in the packed counts of all tables."""
    spark = tables[0].sparkSession
    shared = spark.sparkContext.broadcast(known.hashes())

    def sums(table: pa.Table) -> pa.Table:
        found = []
        for kind in (True, False):
            data = table.filter(pc.equal(table["numbered"], kind))["packed"].to_pylist()
            if data:
                *parts, n = map(np.concatenate, zip(*(unpacked(d, length + 1) for d in data)))
                parts, n = grouped(parts, n)
                often = n >= least
                found.append([shared.value[p[often]] if kind else p[often] for p in parts] + [n[often]])
        return pa.table([np.concatenate(c) for c in zip(*found)], names=names)

    names = [*(f"h{i}" for i in range(1, length + 1)), "n"]
    rows = reduce(DataFrame.unionByName, tables).select("bucket", "numbered", "packed")
    out = cut_lineage(rows.groupBy("bucket").applyInArrow(sums, ", ".join(f"{c} long" for c in names)))
    shared.unpersist()
    return out


def _filter(rows: DataFrame, count: int, known: Frequent | None = None) -> Filter:
    """A filter of about ``count`` keys of long columns; of word hashes, only those that ``known`` does not hold enter."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(known)
    parts = -(-max(1, count) // PART)
    bits = min(KEY_BITS, MOST_BITS / max(1, count))

    def keyed(batches):
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if shared.value is not None:
                new = shared.value.find(columns[0])[1] == NEVER
                columns = [c[new] for c in columns]
            keys = mixed(columns)
            yield pa.RecordBatch.from_arrays([pa.array(part_of(keys, parts).astype(np.int32)), pa.array(keys.view(np.int64))], ["part", "key"])

    def build(table: pa.Table) -> pa.Table:
        keys = table["key"].to_numpy().view(np.uint64)
        blocks = np.zeros(1 + int(len(keys) * bits) // 64, np.uint64)
        np.bitwise_or.at(blocks, block_of(keys, np.uint64(len(blocks))), marks_of(keys))
        return pa.table({"part": table["part"][:1], "bits": pa.array([blocks.tobytes()], pa.binary())})

    built = rows.mapInArrow(keyed, "part int, key long").groupBy("part").applyInArrow(build, "part int, bits binary").toArrow()
    shared.unpersist()
    found = dict(zip(built["part"].to_pylist(), built["bits"]))
    return Filter([np.frombuffer(found[i].as_buffer(), np.uint64) if i in found else np.zeros(1, np.uint64) for i in range(parts)])


def _add_words(known: Frequent, reached: DataFrame, count: int, step: int, most: int) -> None:
    """Numbers the words (h1, n) that have come to the threshold, the most frequent ``most``; the others go into a filter."""
    often = reached
    if count > most:
        n = reached.groupBy("n").agg(F.count("*").alias("words")).toArrow().sort_by([("n", "descending")])
        fits = int((np.cumsum(n["words"].to_numpy()) <= most).sum())
        often = reached.filter(F.col("n") >= n["n"][fits - 1].as_py()) if fits else reached.limit(0)
    known.number(often.select("h1").toArrow()["h1"].to_numpy().astype(np.int64), step, most)
    if count > len(known.keys):
        known.more.append((step, _filter(reached.select("h1"), count - len(known.keys), known)))


def _count(docs: DataFrame, longest: int, least: int, shards: int, max_broadcast_rows: int, run: int, seed: int):
    """[words, pairs, triples] with n >= ``least``, and all words; None if two words share a hash."""
    spark = docs.sparkSession
    scans: dict[int, list[DataFrame]] = {2: [], 3: []}
    frequent: dict[int, DataFrame] = {}
    sizes = {1: 0, 2: 0, 3: 0}
    known = Frequent()
    buckets = 0
    everything = None

    for step in range(longest * shards):
        # Words run in the first cycle; a longer phrase may start behind the first test of the next shorter ones.
        lengths = [1] if step < shards else []
        lengths += [k for k in range(2, longest + 1) if sizes[k - 1] and step < k * shards]
        if not lengths:
            continue
        if lengths != [1] and not buckets:
            heard = everything.agg(F.sum("n")).first()[0] * shards // step
            buckets = max(1, heard // BUCKET)
        shared = spark.sparkContext.broadcast(known) if lengths != [1] else None
        shard = docs.filter(F.pmod(F.xxhash64("lang", "text"), F.lit(shards)) == step % shards)
        rows = cut_lineage(shard.mapInArrow(scan(lengths, step, shards, shared, buckets, seed, run), ROW))
        if shared is not None:
            shared.unpersist()
        for length in lengths:
            if length > 1:
                scans[length].append(rows.filter(F.col("length") == length))
        if step < shards:
            found = rows.filter("length = 1").select("lang", "word", "h1", "n")
            everything = cut_lineage(_total([found] if everything is None else [everything, found], ["lang", "word", "h1"]))
            reached = everything.filter(F.col("n") >= least)
            sizes[1] = reached.count()
            _add_words(known, reached.select("h1", "n"), sizes[1], step, max_broadcast_rows)
        # Pairs are tested at the end of each cycle: a later test only starts triples later.
        if longest > 2 and step % shards == shards - 1 and step < 2 * shards and scans[2]:
            frequent[2] = _reached(scans[2], 2, least, known)
            sizes[2] = frequent[2].count()
            known.pairs.append((step, _filter(frequent[2].select("h1", "h2"), sizes[2])))
        if step == shards - 1 and not everything.groupBy("h1").count().filter("count > 1").isEmpty():
            return None
    if scans[longest]:
        frequent[longest] = _reached(scans[longest], longest, least, known)
    return [cut_lineage(everything.filter(F.col("n") >= least)), *(frequent[k] for k in sorted(frequent))], everything


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = 3,
    least: int = 10,
    covered: int = 50,
    top: int = 2000,
    shards: int = 2,
    max_broadcast_rows: int = 1_000_000,
    run: int = 2_000_000,
) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` (2 or 3) words for each language: lang, rank, phrase, a, l, r, n, score.

    a, l, r are the occurrences of the phrase, of its first part and of its rest at the cut with the lowest score
    floor(1000000 a a / (l r)), of equal ones the first; n counts all words of the language. Phrases with fewer than
    ``least`` occurrences do not count, and one that lies inside a longer phrase with at least ``covered`` percent of its
    occurrences goes. Texts split into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs; only A-Z
    change case. Null texts count as empty, a null language is ``und``, repeated rows count each time; no texts, no rows.
    Arithmetic is exact for counts below 10**15. Other columns are not read.

    Runs one job a shard scan (at most ``longest * shards``) while it builds the result. Up to ``max_broadcast_rows``
    frequent words are broadcast to the scans with their numbers; more of them, and frequent pairs, as filters of at most
    16 bits a word or pair and 128 MB a step, with the same result.
    """
    docs = docs.select(F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(col(text), F.lit("")).alias("text"))
    seed = 42
    while (counted := _count(docs, longest, least, shards, max_broadcast_rows, run, seed)) is None:
        seed += 1
    (singles, *longer), everything = counted
    sizes = everything.groupBy("lang").agg(F.sum("n").alias("n"))
    singles = singles.withColumnRenamed("n", "n1")
    scored = []
    for table in longer:
        scored.append(_scored(table, len(table.columns) - 1, singles, longer, covered))
    if not scored:
        scored = [_scored(everything.limit(0).select("h1", F.col("h1").alias("h2"), "n"), 2, singles, [], covered)]
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = reduce(DataFrame.unionByName, scored).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score")
    )


def _score(a: Column, left: Column, right: Column, k: int) -> Column:
    """struct(score, k, l, r) of one cut, exact."""
    wide = [c.cast("decimal(15,0)") for c in (a, left, right)]
    above = F.lit(1_000_000).cast("decimal(7,0)") * (wide[0] * wide[0])
    score = F.call_function("div", above, wide[1] * wide[2])
    return F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))


def _scored(table: DataFrame, length: int, singles: DataFrame, longer: list[DataFrame], covered: int) -> DataFrame:
    """(lang, phrase, a, cut) of the frequent phrases of one length that no longer phrase covers."""
    rows = table.withColumnRenamed("n", "a")
    for more in longer:
        size = len(more.columns) - 1
        if size > length:
            starts = [F.struct(*[F.col(f"h{s + i}").alias(f"h{i}") for i in range(1, length + 1)]) for s in range(size - length + 1)]
            inside = more.select("n", F.inline(F.array(*starts)))
            most = inside.groupBy(*[f"h{i}" for i in range(1, length + 1)]).agg(F.max("n").alias("most"))
            rows = rows.join(most, [f"h{i}" for i in range(1, length + 1)], "left")
            rows = rows.filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * covered)).drop("most")
    for i in range(1, length + 1):
        keep = [F.col("word").alias(f"w{i}"), F.col("n1").alias(f"n{i}"), *(["lang"] if i == 1 else [])]
        rows = rows.join(singles.select(F.col("h1").alias(f"h{i}"), *keep), f"h{i}")
    cuts = []
    if length == 2:
        cuts = [_score(F.col("a"), F.col("n1"), F.col("n2"), 1)]
    else:
        pairs = longer[0]
        rows = rows.join(pairs.select("h1", "h2", F.col("n").alias("n12")), ["h1", "h2"])
        rows = rows.join(pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("n").alias("n23")), ["h2", "h3"])
        cuts = [_score(F.col("a"), F.col("n1"), F.col("n23"), 1), _score(F.col("a"), F.col("n12"), F.col("n3"), 2)]
    phrase = F.concat_ws(" ", *[f"w{i}" for i in range(1, length + 1)])
    return rows.select("lang", phrase.alias("phrase"), "a", F.array_min(F.array(*cuts)).alias("cut"))
