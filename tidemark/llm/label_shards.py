"""Sharding by balanced label propagation, in DataFrame functions alone.

Groups that exceed every shard are laid over as few shards as they need. The other groups move as a whole to the shard in
which most of their members are, or to the next best with room, until none that is left fits anywhere; those are cut, and
documents without links fill the gaps. No group and no shard is ever held by one task: ranks come from counts of small
buckets and row numbers inside a bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import col, record, unpack
from tidemark.session import cut_lineage

#: Buckets in which the members of a group, or the rows of a shard, are ranked for themselves.
SPREAD = 64


def _bucket(id_col: Column, key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_col, key, F.lit("bucket")), F.lit(buckets)).cast("int")


def ranked(rows: DataFrame, keys: list[str], buckets: int, name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 within ``keys``, in the order (bucket, id, link, size).

    A window numbers the rows of one (keys, bucket); the numbers of the buckets in front come from a count for each
    bucket, so a key that holds a third of all rows is spread over ``buckets`` tasks.
    """
    spread = rows.withColumn("_b", _bucket(col("id"), col("link"), buckets))
    counts = spread.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(W.partitionBy(*keys, "_b").orderBy("id", "link", "size"))
    return (
        spread.withColumn("_i", inside).join(bases, [*keys, "_b"]).withColumn(name, col("_base") + col("_i") - 1).drop("_b", "_i", "_base")
    )


def _at(values: list[int], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), index)


def _interval(room: list[int], place: Column) -> Column:
    """The shard whose share of the line of free places, ``room`` places for each shard in order, holds ``place``."""
    ends = [sum(room[: k + 1]) for k in range(len(room))]
    return reduce(lambda rest, k: F.when(place < ends[k], F.lit(k)).otherwise(rest), reversed(range(len(room) - 1)), F.lit(len(room) - 1))


def _rest(room: list[int], taken: int) -> list[int]:
    """What is left of ``room`` when ``taken`` places are used from the first shard on."""
    left = []
    for r in room:
        used = min(r, taken)
        taken -= used
        left.append(r - used)
    return left


def propagate(groups: DataFrame, room: list[int]) -> tuple[DataFrame, list[int]]:
    """((link, to), room left) for groups (link, members, held: rows in each shard): the shard of each whole group, -1 if it fits nowhere.

    In a round each open group wants the shard that holds most of it among those whose room takes it whole. Of those that want
    a shard the largest are admitted, as many as fit, so the room that a refused group leaves behind at least halves from round to
    round. Room never grows, so a group that fits nowhere stays cut; rounds end when no group is open.
    """
    done = None
    while True:
        choices = [
            F.when(col("members") <= r, F.struct(F.get("held", F.lit(k)).alias("n"), F.xxhash64("link", F.lit(k)).alias("tie"), F.lit(k).alias("k")))
            for k, r in enumerate(room)
        ]
        wish = cut_lineage(
            groups.withColumn("to", F.coalesce(F.array_max(F.array(*choices))["k"], F.lit(-1)))
            .withColumn("_g", F.pmod(F.xxhash64("link"), F.lit(SPREAD * 16)))
        )
        sums = wish.groupBy("to", "members", "_g").agg(F.sum("members").alias("_n"))
        before = W.partitionBy("to").orderBy(F.desc("members"), "_g").rowsBetween(W.unboundedPreceding, -1)
        bases = sums.select("to", "members", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        inside = F.row_number().over(W.partitionBy("to", "members", "_g").orderBy("link"))
        end = col("_base") + col("members") * col("_i")
        judged = wish.withColumn("_i", inside).join(bases, ["to", "members", "_g"])
        judged = judged.withColumn("settled", (col("to") < 0) | (end <= _at(room, F.greatest("to", F.lit(0)))))
        judged = cut_lineage(judged.select("link", "members", "held", "to", "settled"))
        settled = judged.filter("settled").select("link", "to")
        done = settled if done is None else done.unionByName(settled)
        filled = {r["to"]: r["n"] for r in judged.filter("settled").groupBy("to").agg(F.sum("members").alias("n")).collect()}
        room = [r - filled.get(k, 0) for k, r in enumerate(room)]
        groups = judged.filter("not settled").select("link", "members", "held")
        if groups.isEmpty():
            return done, room


def in_line(linked: DataFrame) -> DataFrame:
    """``linked`` with ``place``: groups one after the other, members of a group one after the other."""
    parts = linked.groupBy("link").agg(F.count("*").alias("n")).withColumn("_g", F.pmod(F.xxhash64("link"), F.lit(SPREAD * 16)))
    sums = parts.groupBy("_g").agg(F.sum("n").alias("_n"))
    before = W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = W.partitionBy("_g").orderBy("link").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.withColumn("_s", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(bases, "_g")
    starts = starts.select("link", (col("_base") + col("_s")).alias("start"))
    return ranked(linked, ["link"], SPREAD, "_k").join(starts, "link").withColumn("place", col("start") + col("_k")).drop("start", "_k")


def assign(
    docs: DataFrame,
    shards: int = 8,
    text: str = "text",
    id_col: str = "doc_id",
    carry: list[str] | None = None,
    link: Column | None = None,
) -> DataFrame:
    """Every row with ``size``, ``text_crc32``, ``law`` ('rows'), ``shard``, ``slot`` and ``grown_shard`` (null).

    Law ``rows``: the counts of any two shards differ by one at most, ties and repeated rows included. Rows with equal
    ``link`` (the text if not given) are linked; a group is cut only if no shard has room for all of it. ``slot`` numbers the rows of a
    shard from 0 without gaps. ``size`` is the number of UTF-8 bytes of the text plus 1, that of a null text 1; a null text
    is linked with the empty one. An empty table gives no rows; null ids are ranked like any other. Input columns stay
    (``carry`` names fewer), but results replace columns of their names.
    """
    columns = docs.columns if carry is None else carry
    filled = F.coalesce(col(text), F.lit("")).cast("binary")
    rows = docs.select(
        record(docs, columns),
        col(id_col).alias("id"),
        (F.octet_length(filled) + 1).cast("long").alias("size"),
        F.crc32(filled).alias("crc"),
        (F.md5(filled) if link is None else F.md5(F.coalesce(link.cast("string"), F.lit("")).cast("binary"))).alias("link"),
    )
    rows = cut_lineage(rows.withColumn("shard", F.pmod(F.xxhash64("id", "link"), F.lit(shards)).cast("int")))
    total = rows.count()
    quotas = [total // shards + (k < total % shards) for k in range(shards)]
    held = F.array(*[F.count(F.when(col("shard") == k, 1)) for k in range(shards)]).alias("held")
    groups = cut_lineage(rows.groupBy("link").agg(F.count("*").alias("members"), held).filter("members > 1"))
    rows = rows.select("id", "link", "size", "crc", "rec")

    # A group above every quota fits nowhere as a whole. There are fewer such groups than shards; they fill shards from the first on.
    large = groups.filter(col("members") > max(quotas)).select("link", "members").orderBy("link").collect()
    names = [r["link"] for r in large]
    start = reduce(lambda rest, k: F.when(col("link") == names[k], F.lit(sum(r["members"] for r in large[:k]))).otherwise(rest), range(len(large)), F.lit(0))
    split = ranked(rows.filter(col("link").isin(names)), ["link"], SPREAD * 16, "_k")
    split = split.withColumn("shard", _interval(quotas, start + col("_k")).cast("int")).drop("_k")
    taken = sum(r["members"] for r in large)
    homes, room = propagate(groups.filter(col("members") <= max(quotas)), _rest(quotas, taken))

    homed = cut_lineage(rows.filter(~col("link").isin(names)).join(homes, "link", "left"))
    whole = homed.filter("to >= 0").withColumn("shard", col("to").cast("int")).drop("to")
    # Groups that fit nowhere take the free places from the first on, and rows without links those that are left.
    cut = cut_lineage(in_line(homed.filter("to < 0").drop("to")))
    left = _rest(room, cut.count())
    cut = cut.withColumn("shard", _interval(room, col("place")).cast("int")).drop("place")
    settled = split.unionByName(whole).unionByName(cut)
    single = homed.filter("to is null").drop("to")
    filled_up = ranked(single, [], SPREAD * 16, "_k")
    filled_up = filled_up.withColumn("shard", _interval(left, col("_k")).cast("int")).drop("_k")
    everything = cut_lineage(settled.unionByName(filled_up))
    numbered = ranked(everything, ["shard"], SPREAD * 16, "slot")
    return unpack(
        numbered, columns, size=col("size"), text_crc32=col("crc"), law=F.lit("rows"), shard=col("shard"),
        slot=col("slot"), grown_shard=F.lit(None).cast("int"),
    )
