"""Token ids as fixed-width bit-packed blocks, written in document order and read back by block or by document.

A file set is a folder with
* ``blocks``: one row per block. ``payload`` holds the ids of whole documents, ``width`` bits each, lowest bit first; ``docs`` and
  ``lengths`` give the documents of the block and so the offset of each in the payload;
* rows stand in ascending order of (part, seq), which is that of the ids of documents, so a reader finds a document by the
  statistics of first_doc and last_doc in the files and unpacks its ids alone.
Widths are the fewest bits that hold the largest id of the vocabulary.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import col, unsigned_crc
from tidemark.llm.pair_bpe import SEPARATORS, vocabulary
from tidemark.session import shared_folder

BLOCK_SCHEMA = (
    "part int, seq int, first_doc long, last_doc long, docs array<long>, nulls array<boolean>, lengths array<long>, n_tokens long, width int, payload binary"
)


def bit_width(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits for each id, lowest bit first; the last byte is filled with zeros."""
    ids = np.asarray(ids, np.uint64)
    if ids.size and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ids(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """The ids number ``start`` to ``start + count`` of a payload; only their bytes are read."""
    first_bit = start * width
    raw = np.frombuffer(payload, np.uint8, offset=0)[first_bit // 8 : -(-(first_bit + count * width) // 8)]
    if width == 16:
        return np.frombuffer(raw.tobytes(), "<u2").astype(np.uint32)
    bits = np.unpackbits(raw, bitorder="little")[first_bit % 8 : first_bit % 8 + count * width].reshape(count, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


def write(
    docs: DataFrame,
    path: str,
    tokenize: Callable[[], Callable[[pd.Series], list[np.ndarray]]],
    vocabulary_size: int,
    text: str = "text",
    id_col: str = "doc_id",
    end_id: int | None = 1,
    block_tokens: int = 65_536,
    partition_mb: int = 16,
) -> None:
    """Write the ids of ``docs`` in ascending order of ``id_col`` (null first; ties in any order).

    ``tokenize()`` is called once per task and gives a function from texts to arrays of ids; null counts as empty.
    ``end_id`` follows each document. A block takes whole documents until it holds ``block_tokens`` ids, so a longer
    document is a block of its own. One range shuffle of the texts sorts them; tokens are made and packed behind it and are
    never shuffled. The sort key holds a hash of the text, so that equal ids spread over ranges.
    """
    width = bit_width(vocabulary_size)
    rows = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // (partition_mb << 20)))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, part, seq = tokenize(), TaskContext.get().partitionId(), 0
        ids, arrays, held = [], [], 0

        def flush():
            nonlocal seq, ids, arrays, held
            flat = np.concatenate(arrays)
            known = [i for i in ids if i is not None]
            row = {
                "part": part, "seq": seq, "first_doc": min(known, default=None), "last_doc": max(known, default=None), "docs": [0 if i is None else i for i in ids], "nulls": [i is None for i in ids],
                "lengths": [len(a) for a in arrays], "n_tokens": len(flat), "width": width, "payload": pack(flat, width),
            }
            seq, ids, arrays, held = seq + 1, [], [], 0
            return pd.DataFrame([row]).astype({"first_doc": "Int64", "last_doc": "Int64"})

        for batch in batches:
            for start in range(0, len(batch), 512):
                piece = batch.iloc[start : start + 512]
                for doc, found in zip(piece["id"], encode(piece["text"])):
                    if end_id is not None:
                        found = np.append(found, end_id)
                    ids.append(None if pd.isna(doc) else int(doc))
                    arrays.append(found.astype(np.uint32))
                    held += len(found)
                    if held >= block_tokens:
                        yield flush()
        if ids:
            yield flush()

    ordered = rows.repartitionByRange(int(parts), F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first())
    packed = ordered.mapInPandas(blocks, BLOCK_SCHEMA)
    packed.write.mode("error").parquet(f"{path}/blocks")


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, first_token): the ids in front of each block.

    The running sum goes over the blocks of one part by a window and over the parts by one more, so it sees numbers only.
    """
    counts = spark.read.parquet(f"{path}/blocks").select("part", "seq", "n_tokens")
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.selectExpr("part", "sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base")
    inside = counts.selectExpr(
        "part", "seq", "sum(n_tokens) OVER (PARTITION BY part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inner"
    )
    return inside.join(before, "part").select("part", "seq", (F.coalesce("base", F.lit(0)) + F.coalesce("inner", F.lit(0))).alias("first_token"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: ``start`` counts all ids in front of it and the
    checksum is that of its ids as little-endian unsigned 32-bit integers."""
    stored = spark.read.parquet(f"{path}/blocks").join(offsets(spark, path), ["part", "seq"])

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                lengths = np.asarray(row.lengths, np.int64)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
                flat = unpack_ids(row.payload, row.width, 0, int(lengths.sum())).astype("<u4")
                yield pd.DataFrame({
                    "doc_id": pd.array([None if n else d for d, n in zip(row.docs, row.nulls)], dtype="Int64"),
                    "start": row.first_token + starts,
                    "n_tokens": lengths,
                    "ids_crc32": [unsigned_crc(flat[s : s + n].tobytes()) for s, n in zip(starts, lengths)],
                })

    wanted = stored.select("docs", "nulls", "lengths", "width", "payload", "first_token")
    return wanted.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Random access: the ids of each document ``doc_id``, unpacked from its place in its block and from nowhere else."""
    found = spark.read.parquet(f"{path}/blocks").filter((col("first_doc") <= doc_id) & (col("last_doc") >= doc_id))
    out = []
    for row in found.orderBy("part", "seq").collect():
        starts = np.concatenate([[0], np.cumsum(row["lengths"])])
        for k, (doc, null) in enumerate(zip(row["docs"], row["nulls"])):
            if doc == doc_id and not null:
                out.append(unpack_ids(row["payload"], row["width"], int(starts[k]), int(row["lengths"][k])).tolist())
    return out


def library_tokenizer(path: str, remembered: int = 1_000_000) -> Callable[[], Callable[[pd.Series], list[np.ndarray]]]:
    """A factory for :func:`write`: the tokenizers library on the file ``path``, each distinct piece of text encoded once.

    The vocabulary parts text at white space and then into pieces whose ids do not depend on their neighbours. So a word's
    ids are those of its pieces, and a worker remembers up to ``remembered`` words and pieces for all its tasks. New words are
    parted together; those with special tokens or with marks that are put in order go to the library alone. Control characters
    that Python counts as blanks and the vocabulary does not are left to the library with the whole text.
    """

    def make() -> Callable[[pd.Series], list[np.ndarray]]:
        return _library(path, remembered)

    return make


@functools.lru_cache(maxsize=2)
def _library(path: str, remembered: int, run_chars: int = 2_000_000) -> Callable[[pd.Series], list[np.ndarray]]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    known = vocabulary(path)
    parts_and_ends = regex.compile(f"{known.pattern.pattern}|\n")
    end = b"\xff" * 4  # no id has these bytes
    pieces: dict[str, bytes] = {}
    # Words by number; word k has the ids flat[starts[k] : starts[k + 1]].
    numbers: defaultdict[str, int] = defaultdict()
    flat, starts = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def ids_of(text: str) -> bytes:
        return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_pieces(fresh: list[str]) -> None:
        """One call for many pieces between blanks. Where the library does not find as many pieces, each is encoded alone."""
        for start in range(0, len(fresh), 1000):
            part = fresh[start : start + 1000]
            coded = tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, places = np.asarray(coded.ids, "<u4"), np.asarray(coded.word_ids, np.float64)
            found = np.flatnonzero(np.diff(places)) + 1
            if len(ids) and len(found) + 1 == len(part) and not np.isnan(places).any():
                raw, cuts = ids.tobytes(), [0, *(4 * found).tolist(), 4 * len(ids)]
                pieces.update(zip(part, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:
                pieces.update((p, ids_of(p)) for p in part)

    def coded_words(new: list[str]) -> list[bytes]:
        """The ids of each word. All plain words are parted by one search; an end stands behind each."""
        text = "\n".join(new)
        odd = {}
        if not text.isascii() or any(special in text for special in known.special):
            marks = set(filter(unicodedata.combining, set(text)))
            odd = {w: ids_of(w) for w in new if not marks.isdisjoint(w) or any(special in w for special in known.special)}
        plain = [w for w in new if w not in odd] if odd else new
        if not plain:
            return list(odd.values())
        found = parts_and_ends.findall(known.lowered("\n".join(plain)))
        learn_pieces(list(set(found).difference(pieces, "\n")))
        coded = b"".join([end if p == "\n" else pieces[p] for p in found]).split(end)
        if not odd:
            return coded
        odd.update(zip(plain, coded))
        return [odd[w] for w in new]

    def encode(texts: pd.Series) -> list[np.ndarray]:
        """Runs of texts are learnt together, so that a call of the library takes many new pieces."""
        nonlocal flat, starts
        out, run, held = [], [], 0
        for k, text in enumerate(texts, 1):
            run.append(text)
            held += len(text)
            if held < run_chars and k < len(texts):
                continue
            if len(pieces) > remembered:
                pieces.clear()
            if not numbers or len(numbers) > remembered:
                numbers.clear()
                numbers.default_factory = itertools.count().__next__
                flat, starts = np.empty(0, "<u4"), np.zeros(1, np.int64)
            numbered = []
            for t in run:
                found = None if SEPARATORS.search(t) else t.split()
                numbered.append(None if found is None else np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
            new = list(itertools.islice(numbers, len(starts) - 1, None))
            if new:
                coded = coded_words(new)
                ends = starts[-1] + np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))) // 4
                flat, starts = np.concatenate([flat, np.frombuffer(b"".join(coded), "<u4")]), np.concatenate([starts, ends])
            for t, of_text in zip(run, numbered):
                if of_text is None:
                    out.append(np.frombuffer(ids_of(t), "<u4"))
                    continue
                first = starts[of_text]
                lengths = starts[of_text + 1] - first
                before = np.cumsum(lengths) - lengths
                out.append(flat[np.repeat(first - before, lengths) + np.arange(lengths.sum())])
            run, held = [], 0
        return out

    return encode


def round_trip(docs: DataFrame, tokenizer_path: str, vocabulary_size: int, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """Write ``docs`` to a new folder beside ``spark.checkpoint.dir``'s other tables and read all documents back from it.

    An empty table gives no rows; repeated rows are written and read as often as they come.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, path, library_tokenizer(tokenizer_path), vocabulary_size, text, id_col, **options)
    return read_documents(spark, path)
