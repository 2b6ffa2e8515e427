"""Bigram scores from a log-frequency Bloom filter, and exact unigram scores.

The filter holds quantised counts: an n-gram of level j is entered j times, as (n-gram, 1) to (n-gram, j), and its level is read
back by probing 1, 2, ... until a probe fails. False positives can only raise a level. Words and bigrams share the filter.
It is built in shards, each from all the counts of its n-grams and as large as they need, so it grows with the corpus. Up to a
size that is checked it is broadcast; above it the n-grams of a run of texts travel to the shards and their levels back. The
bits, the probes and the scores are the same.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, fold, record, unpack
from tidemark.session import cut_lineage

#: The end of a text; no word holds a blank.
END = b" "
PROBES = 6
#: Levels that are probed at most: counts up to 2**40 times the least.
LEVELS = 40
#: Words that are probed together.
PROBED = 500_000
_START = np.uint64(0x51ED270B9F3D5A17)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def tokens(text: str | None) -> list[bytes]:
    """Words of a text (A-Z lowered, ASCII white space) and its end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def bigram_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _ODD[0] + ((right << np.uint64(29)) | (right >> np.uint64(35))))


def with_start(words: np.ndarray) -> np.ndarray:
    """The word in front of each word; a fixed number stands in front of the first."""
    return np.concatenate([[_START], words[:-1]])


@dataclass(frozen=True)
class Filter:
    """The bytes of all shards in one array; shard s has those from ``starts[s]`` to ``starts[s + 1]``."""

    data: np.ndarray
    starts: np.ndarray

    @property
    def shard_bits(self) -> int:
        return int(len(self.starts) - 1).bit_length() - 1

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram."""
        shard = shard_of(hashes, self.shard_bits)
        start = self.starts[shard]
        return probed(self.data, key_of(hashes, self.shard_bits), start, (self.starts[shard + 1] - start) * 8)


def probed(data: np.ndarray, keys: np.ndarray, start: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Levels of keys whose shards begin at byte ``start`` and have ``bits`` bits: probes go on for those that have passed all before."""
    out = np.zeros(len(keys), np.int8)
    alive = np.flatnonzero(bits > 0)
    for level in range(1, LEVELS + 1):
        for probe in range(PROBES):
            if not len(alive):
                return out
            at = positions(keys[alive], level, probe, bits[alive])
            alive = alive[(data[start[alive] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out[alive] = level
    return out


def middles(levels: np.ndarray) -> np.ndarray:
    """Expected counts: the geometric middle of the least and the largest count of a level, 0 below level 1."""
    low = np.exp2(levels - 1.0)
    return np.where(levels > 0, np.sqrt(low * (2 * low - 1)), 0.0)


def shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def key_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits that follow those of the shard."""
    return ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def positions(keys: np.ndarray, level: int, probe: int, bits: int | np.ndarray) -> np.ndarray:
    seed = np.uint64((level * 64 + probe + 1) * int(_ODD[1]) % (1 << 64))
    return (mix(keys.astype(np.uint64) * _ODD[0] + seed) % np.asarray(bits, np.uint64)).astype(np.int64)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Level of each count: 1 for a single one, then one more for each doubling."""
    return np.minimum(np.floor(np.log2(np.maximum(counts, 1)) + 1e-9).astype(np.int64) + 1, LEVELS) * (counts > 0)


def build_block(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bytes of one shard, half full: its size follows the number of entries."""
    level = quantised(counts)
    size = max(8, math.ceil(int(level.sum()) * PROBES / math.log(2) / 8))
    bits = np.zeros(size * 8, np.uint8)
    for j in range(1, int(level.max(initial=0)) + 1):
        entered = keys[level >= j]
        for probe in range(PROBES):
            bits[positions(entered, j, probe, size * 8)] = 1
    return np.packbits(bits, bitorder="little")


def runs_of(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal values."""
    begins = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    yield from zip(sorted_[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(sorted_)])


def _hashed(words: list[bytes], memory: dict[bytes, int]) -> np.ndarray:
    for w in set(words):
        if w not in memory:
            memory[w] = word_hash(w)
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


def shard_bits_for(total_bytes: int) -> int:
    """Shards grow in number with the text: one has the n-grams of 3 MB of it, about a million."""
    return max(0, math.ceil(math.log2(max(total_bytes, 1) / 3e6)))


def train_filter(texts: DataFrame, shard_bits: int, chunk_bytes: int) -> DataFrame:
    """(shard, block): all words and bigrams of ``texts`` (column text), counted and entered.

    A task sends, for each shard, the sorted keys of a chunk of text with their counts, single ones without; a shard is
    merged by one task. Shards without n-grams have no row.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held, memory = [], 0, {}

        def flush():
            every = np.concatenate(found)
            found.clear()
            grams, n = np.unique(every, return_counts=True)
            del every
            shard, key = shard_of(grams, shard_bits), key_of(grams, shard_bits)
            rows = []
            for s, begin, end in runs_of(shard):
                k, c = key[begin:end], n[begin:end]
                rows.append((s, k[c == 1].tobytes(), k[c > 1].tobytes(), c[c > 1].astype(np.uint32).tobytes()))
            return pd.DataFrame(rows, columns=["shard", "singles", "keys", "counts"])

        for batch in batches:
            for text in batch["text"]:
                words = _hashed(tokens(text), memory)
                found += [mix(words), bigram_hash(with_start(words), words)]
                held += len(text or "")
                if held >= chunk_bytes:
                    yield flush()
                    found, held, memory = [], 0, {}
        if found:
            yield flush()

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        singles = [np.frombuffer(b, np.uint32) for b in group["singles"]]
        several = [np.frombuffer(b, np.uint32) for b in group["keys"]]
        weights = [np.frombuffer(b, np.uint32) for b in group["counts"]]
        every = np.concatenate([*singles, *several])
        weight = np.concatenate([np.ones(sum(map(len, singles)), np.int64), *weights])
        order = np.argsort(every, kind="stable")
        every, weight = every[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        block = build_block(every[first], np.add.reduceat(weight, first))
        return pd.DataFrame({"shard": [key[0]], "block": [block.tobytes()]})

    sent = texts.select("text").mapInPandas(count, "shard long, singles binary, keys binary, counts binary")
    return cut_lineage(sent.groupBy("shard").applyInPandas(merge, "shard long, block binary"))


def gathered(blocks: DataFrame, shard_bits: int) -> Filter:
    """The whole filter in memory; the caller has checked its size."""
    sizes = np.zeros((1 << shard_bits) + 1, np.int64)
    for row in blocks.select("shard", F.octet_length("block").alias("size")).collect():
        sizes[row["shard"] + 1] = row["size"]
    starts = np.cumsum(sizes)
    data = np.zeros(int(starts[-1]), np.uint8)
    for row in blocks.toLocalIterator():
        data[starts[row["shard"]] : starts[row["shard"] + 1]] = np.frombuffer(row["block"], np.uint8)
    return Filter(data, starts)


def _lookups(rows: DataFrame, shard_bits: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(docs: chunk, row, n, payload; words: shard, chunk, first, payload, counts) for rows (row, learn, text).

    A chunk is a run of rows of about ``chunk_bytes``. Its distinct words get places by shard, then by falling count; a document is
    kept as its sorted places, as compressed differences. The words of a chunk and a shard are one row: the words, which hold no
    line feed, from place ``first`` on, and how often they occur in the rows that are learnt from.
    """
    schema = "kind string, chunk long, row long, n long, payload binary, shard long, first long, counts binary"
    names_of_columns = ["kind", "chunk", "row", "n", "payload", "shard", "first", "counts"]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, seq, run, held = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush() -> pd.DataFrame:
            sizes = np.array([len(ids) for _, _, ids in run])
            flat = np.concatenate([ids for _, _, ids in run])
            learnt = np.repeat(np.array([learn for _, learn, _ in run]), sizes)
            names = list(seen)
            shard = shard_of(np.fromiter(map(word_hash, names), np.uint64, len(names)), shard_bits)
            order = np.lexsort((-np.bincount(flat, minlength=len(names)), shard))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            taught = np.bincount(flat[learnt], minlength=len(names))[order].astype("<i8")
            out = [
                ("docs", base + seq, row, len(ids), packed(np.diff(np.sort(place[ids]), prepend=0).astype("<u4").tobytes()), -1, -1, None)
                for row, _, ids in run
            ]
            for s, begin, end in runs_of(shard[order]):
                text = b"\n".join([names[i] for i in order[begin:end].tolist()])
                out.append(("words", base + seq, -1, end - begin, packed(text), s, begin, packed(taught[begin:end].tobytes())))
            return pd.DataFrame(out, columns=names_of_columns)

        def fresh() -> defaultdict:
            """Numbers words in the order in which they come."""
            found: defaultdict = defaultdict()
            found.default_factory = found.__len__
            return found

        seen = fresh()
        for batch in batches:
            for row, learn, text in zip(batch["row"], batch["learn"], batch["text"]):
                words = tokens(text)
                run.append((row, learn, np.fromiter(map(seen.__getitem__, words), np.int64, len(words))))
                held += len(text or "")
                if held >= chunk_bytes:
                    yield flush()
                    run, held, seq, seen = [], 0, seq + 1, fresh()
        if run:
            yield flush()

    stored = cut_lineage(rows.select("row", "learn", "text").mapInPandas(split, schema))
    docs = stored.filter("kind = 'docs'").select("chunk", "row", "n", "payload")
    return docs, stored.filter("kind = 'words'").select("shard", "chunk", "first", "payload", "counts")


def packed(data: bytes) -> bytes:
    return zlib.compress(data, 1)


def base_scores(rows: DataFrame, shard_bits: int, chunk_bytes: int) -> tuple[DataFrame, int, int]:
    """((row, n_tokens, n_known, base_score), N, V) for rows (row, learn, text): exact counts of all learnt tokens.

    Words meet once for each chunk, not for each document, so a frequent word is sent a few times. They are counted by shards of
    words that grow in number with the text, and the counts come back to the chunk's documents by a cogroup of bounded size.
    """
    docs, words = _lookups(rows, shard_bits, chunk_bytes)

    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total: dict[bytes, int] = defaultdict(int)
        for names, counts in zip(group["payload"], group["counts"]):
            for word, c in zip(zlib.decompress(names).split(b"\n"), np.frombuffer(zlib.decompress(counts), "<i8").tolist()):
                total[word] += c
        back = []
        for names in group["payload"]:
            each = [total[word] for word in zlib.decompress(names).split(b"\n")]
            back.append(packed(np.array(each, "<i8").tobytes()))
        out = pd.DataFrame({"part": group["chunk"], "first": group["first"], "counts": back, "n": 0, "v": 0})
        out.loc[out.index[0], ["n", "v"]] = sum(total.values()), sum(c > 0 for c in total.values())
        return out

    counted = cut_lineage(words.groupBy("shard").applyInPandas(count, "part long, first long, counts binary, n long, v long"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n, v = total["n"], total["v"]
    bottom = np.log10(n + 0.1 * (v + 1))

    def add(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c = np.concatenate([np.frombuffer(zlib.decompress(x), "<i8") for x in right.sort_values("first")["counts"]])
        logs = np.log10(c + 0.1) - bottom
        out = []
        for payload in left["payload"]:
            at = np.cumsum(np.frombuffer(zlib.decompress(payload), "<u4").astype(np.int64))
            out.append((int((c[at] > 0).sum()), float(logs[at].sum())))
        return pd.DataFrame({"row": left["row"], "n_tokens": left["n"], "n_known": [o[0] for o in out], "base_score": [o[1] for o in out]})

    known = counted.select("part", "first", "counts")
    scored = docs.groupBy("chunk").cogroup(known.groupBy("part")).applyInPandas(add, "row long, n_tokens long, n_known long, base_score double")
    return scored, n, v


@dataclass(frozen=True)
class Smoothing:
    """P(w | u) = (c(u w) + kappa * P1(w)) / (c(u) + kappa), P1(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)); counts are those of the filter,
    and a bigram never counts for more than its first word. The start of a text counts as often as texts were read."""

    n: int
    v: int
    kappa: float

    def log_sums(self, single: np.ndarray, pair: np.ndarray, starts: np.ndarray, opening: float) -> np.ndarray:
        """log10 probabilities of the texts that begin at ``starts``, from the counts of their words and bigrams."""
        before = np.concatenate([[0.0], single[:-1]])
        before[starts] = opening
        alone = np.minimum((single + 0.1) / (self.n + 0.1 * (self.v + 1)), 1.0)
        return np.add.reduceat(np.log10((np.minimum(pair, before) + self.kappa * alone) / (before + self.kappa)), starts)


def grams(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, bigrams, starts) of texts from their word hashes, the end included, as the filter knows them."""
    words = np.concatenate(runs)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in runs])[:-1]]).astype(np.int64)
    left = with_start(words)
    left[starts] = _START
    return mix(words), bigram_hash(left, words), starts


def text_scores(runs: list[np.ndarray], model: Filter, smoothing: Smoothing) -> np.ndarray:
    """Scores of texts from their word hashes; the distinct n-grams of all texts are probed together."""
    words, pairs, starts = grams(runs)
    distinct, place = np.unique(words, return_inverse=True)
    single = middles(model.levels(distinct))[place]
    # Every text ends with the end token, which counts the texts.
    return smoothing.log_sums(single, middles(model.levels(pairs)), starts, single[-1])


def broadcast_scores(rows: DataFrame, model: Filter, smoothing: Smoothing) -> DataFrame:
    """``rows`` with ``model``, the score of the text, by a filter that every worker holds."""
    shared = rows.sparkSession.sparkContext.broadcast((model.data, model.starts))

    @F.pandas_udf("double")
    def modelled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        filter_ = Filter(*shared.value)
        memory: dict[bytes, int] = {}
        for texts in batches:
            out, runs, held = [], [], 0
            for k, text in enumerate(texts, 1):
                runs.append(_hashed(tokens(text), memory))
                held += len(runs[-1])
                if held >= PROBED or k == len(texts):
                    out.append(text_scores(runs, filter_, smoothing))
                    runs, held = [], 0
            if len(memory) > 150_000:
                memory.clear()
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return rows.select("rec", "row", "learn", modelled(col("text")).alias("model"))


def shard_scores(rows: DataFrame, blocks: DataFrame, shard_bits: int, smoothing: Smoothing, chunk_bytes: int) -> DataFrame:
    """(row, model) by a filter of any size, whose blocks stay where they are stored.

    The distinct n-grams of a chunk of texts are numbered by hash, so those of one shard follow each other. Each such run is
    probed next to its block, and the levels of a chunk meet its texts again. A shard sees a few n-grams of every chunk,
    in all about as many as it holds itself times the chunks that repeat them.
    """
    schema = "kind string, chunk long, row long, payload binary, shard long, first long"

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, seq, ids, runs, held, memory = TaskContext.get().partitionId() << 32, 0, [], [], 0, {}

        def flush() -> pd.DataFrame:
            words, pairs, starts = grams(runs)
            distinct, place = np.unique(np.concatenate([words, pairs]), return_inverse=True)
            single, pair = np.split(place.astype("<u4"), 2)
            ends = [*starts[1:].tolist(), len(words)]
            docs = [
                ("docs", base + seq, row, zlib.compress(single[b:e].tobytes() + pair[b:e].tobytes(), 1), -1, -1)
                for row, b, e in zip(ids, starts.tolist(), ends)
            ]
            key = key_of(distinct, shard_bits)
            probes = [
                ("probes", base + seq, -1, key[b:e].tobytes(), s, b) for s, b, e in runs_of(shard_of(distinct, shard_bits))
            ]
            return pd.DataFrame(docs + probes, columns=["kind", "chunk", "row", "payload", "shard", "first"])

        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                ids.append(row)
                runs.append(_hashed(tokens(text), memory))
                held += len(text or "")
                if held >= chunk_bytes:
                    yield flush()
                    seq, ids, runs, held, memory = seq + 1, [], [], 0, {}
        if runs:
            yield flush()

    def probe(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        data = np.frombuffer(block["block"][0], np.uint8) if len(block) else np.zeros(0, np.uint8)
        levels = []
        for keys in asked["payload"]:
            k = np.frombuffer(keys, np.uint32)
            levels.append(probed(data, k, np.zeros(len(k), np.int64), np.full(len(k), len(data) * 8)).tobytes())
        return pd.DataFrame({"part": asked["chunk"], "first": asked["first"], "levels": levels})

    def add(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        levels = np.concatenate([np.frombuffer(b, np.int8) for b in found.sort_values("first")["levels"]])
        count, out = middles(levels), []
        for payload in docs["payload"]:
            single, pair = np.split(count[np.frombuffer(zlib.decompress(payload), "<u4")], 2)
            out.append(float(smoothing.log_sums(single, pair, np.zeros(1, np.int64), single[-1])[0]))
        return pd.DataFrame({"row": docs["row"], "model": out})

    stored = cut_lineage(rows.select("row", "text").mapInPandas(split, schema))
    asked = stored.filter("kind = 'probes'").select("shard", "chunk", "first", "payload")
    found = asked.groupBy("shard").cogroup(blocks.groupBy("shard")).applyInPandas(probe, "part long, first long, levels binary")
    docs = stored.filter("kind = 'docs'").select("chunk", "row", "payload")
    return docs.groupBy("chunk").cogroup(found.groupBy("part")).applyInPandas(add, "row long, model double")


def score_texts(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", carry: list[str] | None = None, folds: int = 10,
    kappa: float = 20.0, max_broadcast_mb: int = 256, chunk_mb: int = 6,
) -> DataFrame:
    """Every row with ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Rows whose crc32 of the id as text is not divisible by ``folds`` are learnt from, with all their words and bigrams. Null
    counts as empty (one token, the end); a null id as an empty id. Repeated rows count as often as they occur. An empty
    table gives no rows; if nothing is learnt from, all counts are 0 and the scores use the smoothing alone. Input
    columns stay (``carry`` names fewer), but results replace columns of their names.

    The filter has room for all n-grams at any size of the corpus. It is broadcast if its blocks take at most
    ``max_broadcast_mb``; a larger one is probed shard by shard, with the same scores.
    """
    columns = docs.columns if carry is None else carry
    rows = docs.select(
        record(docs, columns), F.coalesce(col(text), F.lit("")).alias("text"),
        (fold(col(id_col), folds) != 0).alias("learn"),
    )
    # Row numbers must not change between the passes, so rows with their numbers are kept while texts are needed.
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    chunk = chunk_mb << 20
    shard_bits = shard_bits_for(size)
    based, n, v = base_scores(rows, shard_bits, chunk)
    based, smoothing = cut_lineage(based), Smoothing(n, v, kappa)
    blocks = train_filter(rows.filter("learn"), shard_bits, chunk)
    held = blocks.agg(F.sum(F.octet_length("block")).alias("b")).first()["b"] or 0
    if held <= max_broadcast_mb << 20:
        scored = broadcast_scores(rows, gathered(blocks, shard_bits), smoothing)
    else:
        scored = rows.select("rec", "row", "learn").join(shard_scores(rows, blocks, shard_bits, smoothing, chunk), "row")
    scored = scored.join(based, "row")
    return unpack(
        scored, columns, held_out=~col("learn"), n_tokens=col("n_tokens"), n_known=col("n_known"),
        train_tokens=F.lit(n).cast("long"), base_score=col("base_score"), score=col("model"),
    )
