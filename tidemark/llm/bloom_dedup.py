"""Exact deduplication behind a two-pass blocked Bloom filter, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, record, unpack
from tidemark.session import cut_lineage

#: Bits of one block: the width of Spark's bitmap aggregate (4 KB).
BLOCK_BITS = 32768
PROBES = 3


def _block(digest: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(blocks)).cast("int")


def _bits(digest: Column) -> list[Column]:
    mixed = F.xxhash64(digest, F.lit("bit"))
    return [F.shiftrightunsigned(mixed, 16 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]


def filter_blocks(rows: int, bits_per_row: int, max_filter_mb: int) -> int:
    """Blocks of the filter: ``bits_per_row`` for each row, never more than ``max_filter_mb``."""
    wanted = -(-max(rows, 1) * bits_per_row // BLOCK_BITS)
    return max(1, min(wanted, max_filter_mb * 1024 * 1024 * 8 // BLOCK_BITS))


def repeat_filter(digests: DataFrame, digest: str, blocks: int) -> DataFrame:
    """First pass: one row (block, bitmap) for each block; a bit is set if two rows or more fall on it.

    Every digest sets PROBES bits of one block. Counting the rows on a bit instead of only setting it gives the
    filter of repeated digests in one aggregation; counts are combined before the shuffle, which carries
    (block, bit, count) and no text.
    """
    d = col(digest)
    cells = digests.select(_block(d, blocks).alias("block"), F.explode(F.array_distinct(F.array(*_bits(d)))).alias("bit"))
    twice = cells.groupBy("block", "bit").agg(F.count("*").alias("n")).filter("n >= 2")
    return twice.groupBy("block").agg(F.bitmap_construct_agg(col("bit")).alias("bitmap"))


def _bit_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.lit(1).bitwiseAND(F.call_function("shiftright", byte, (bit % 8).cast("int"))) == 1


def split_by_filter(rows: DataFrame, digest: str, bits_per_row: int, max_filter_mb: int) -> tuple[DataFrame, DataFrame]:
    """Second pass: (rows whose digest is certainly unique, rows whose digest may repeat)."""
    blocks = filter_blocks(rows.count(), bits_per_row, max_filter_mb)
    bitmaps = cut_lineage(repeat_filter(rows, digest, blocks))
    d = col(digest)
    probed = rows.withColumn("block", _block(d, blocks)).join(F.broadcast(bitmaps), "block", "left")
    hit = F.coalesce(reduce(and_, [_bit_set(col("bitmap"), bit) for bit in _bits(d)]), F.lit(False))
    back = rows.columns
    return probed.filter(~hit).select(*back), probed.filter(hit).select(*back)


def mark_copies(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    carry: list[str] | None = None,
    bits_per_row: int = 16,
    max_filter_mb: int = 64,
) -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are identical; null counts as empty. Of equal texts the row with the largest id
    stays; a null id is smaller than any other, and of rows that agree in text and id exactly one stays. An
    empty table gives no rows. Columns of the same names as results are replaced, all others are carried
    along (``carry`` names fewer). Texts of any length are read as a whole and compared by SHA-256.

    The filter is broadcast and holds at most ``max_filter_mb``. A fuller filter sends more unique rows through the
    shuffle and changes no result. Only rows that may repeat are written and shuffled.
    """
    columns = docs.columns if carry is None else carry
    rows = docs.select(
        record(docs, columns), col(id_col).alias("id"), F.sha2(F.coalesce(col(text), F.lit("")).cast("binary"), 256).alias("sha")
    )
    once, maybe = split_by_filter(rows, "sha", bits_per_row, max_filter_mb)
    maybe = cut_lineage(maybe.withColumn("row", F.monotonically_increasing_id()))
    # Stored, so that both sides of the join are plain shuffles and a group of any size can be split among tasks.
    groups = cut_lineage(maybe.groupBy("sha").agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("top")))
    marked = maybe.join(groups, "sha")
    return unpack(
        once, columns, keep_id=col("id"), group_size=F.lit(1).cast("long"), kept=F.lit(True), text_sha256=col("sha")
    ).unionByName(
        unpack(
            marked, columns, keep_id=F.col("top.id"), group_size=col("n"), kept=col("row") == F.col("top.row"),
            text_sha256=col("sha"),
        )
    )


def drop_copies(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", bits_per_row: int = 16, max_filter_mb: int = 64
) -> DataFrame:
    """The rows of ``docs`` that :func:`mark_copies` keeps, unchanged.

    A group shrinks to its best row number before the shuffle, and rows meet the numbers that stay by a join on
    that unique number, so a group of any size spreads over all tasks.
    """
    rows = docs.select(
        record(docs), col(id_col).alias("id"), F.sha2(F.coalesce(col(text), F.lit("")).cast("binary"), 256).alias("sha")
    )
    once, maybe = split_by_filter(rows, "sha", bits_per_row, max_filter_mb)
    maybe = cut_lineage(maybe.withColumn("row", F.monotonically_increasing_id()))
    stay = maybe.groupBy("sha").agg(F.max(F.struct("id", "row")).alias("top")).select(F.col("top.row").alias("row"))
    kept = maybe.join(stay, "row", "left_semi")
    return unpack(once, docs.columns).unionByName(unpack(kept, docs.columns))
