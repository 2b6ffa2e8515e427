"""The label log as a stream: new files are curated as they arrive and counted as they grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import labels as L
from tidemark.functions import geo as G
from tidemark.sources.labels import curate, parse_lines


def stream_labels(spark: SparkSession, folder: str, *, max_files: int = 1000) -> DataFrame:
    """Curated label rows from every new file of a folder, old and undated ones included.

    Review times stay as they are and no watermark is set, so a back-fill loses no row. An id may repeat; what is kept of
    it is decided where rows are saved. Malformed lines are left out, as in a batch read.
    """
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    lines = raw.select(F.trim("value").alias("line")).filter("line <> ''")
    return curate(parse_lines(lines)).filter(F.col("id").isNotNull())


def _saved(spark: SparkSession, table: str, number: int) -> DataFrame | None:
    """Ids of all batches but ``number``; None before the first batch."""
    try:
        rows = spark.read.parquet(table)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return rows.filter(F.col("batch") != number).select("id")


def run_curation(
    spark: SparkSession, folder: str, table: str, checkpoint: str, *, max_files: int = 1000, once: bool = True
) -> StreamingQuery:
    """Keep a curated Parquet table up to date with the log folder; each id is kept once, as it came first.

    A batch is joined against the ids already saved, however old, so neither age nor a missing time drops a row and no state
    grows in the stream. Inside a batch the row with the earliest review time stays, undated ones last, then by content.
    The open ``extra`` map is kept as JSON text. Each batch goes to its own ``batch`` folder and replaces it when a failed
    batch is run again, so a retry after a lost executor adds no row twice. ``table`` and ``checkpoint`` must lie on shared storage.
    """

    def save(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("extra", F.to_json("extra"))
        order = F.struct(F.col("reviewed_ts").isNull(), "reviewed_ts", F.to_json(F.struct(*rows.columns)))
        first = rows.groupBy("id").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        known = _saved(batch.sparkSession, table, number)
        if known is not None:
            first = first.join(known, "id", "left_anti")
        first.write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={number}")

    writer = stream_labels(spark, folder, max_files=max_files).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def running_counts(rows: DataFrame) -> DataFrame:
    """Usable labels so far, by vessel and negative; for ``update`` or ``complete`` output."""
    y = L.binary_label("record_type", "review_category", "is_vessel")
    return rows.withColumn("y", y).groupBy().agg(
        F.count("y").alias("total"), F.count_if(F.col("y") == 1).alias("n_vessel"), F.count_if(F.col("y") == 0).alias("n_negative")
    )


def running_static_cells(rows: DataFrame, decimals: int = 4) -> DataFrame:
    """Sightings so far per lon/lat cell."""
    seen = rows.filter((F.col("record_type") == L.STATIC_WITNESS) & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    return seen.withColumn("_c", G.cell_key("lon", "lat", decimals)).groupBy(
        F.col("_c.cell_lon").alias("cell_lon"), F.col("_c.cell_lat").alias("cell_lat")
    ).agg(F.count("*").alias("hits"))


def run_counts(
    spark: SparkSession, table: str, target: str, checkpoint: str, counts: Callable[[DataFrame], DataFrame], *, max_files: int = 1000, once: bool = True
) -> StreamingQuery:
    """Keep ``counts`` (:func:`running_counts`, :func:`running_static_cells`) of the curated ``table`` up to date in ``target``.

    Reads only files that :func:`run_curation` has added since the last run; the counts themselves are the stream's state. Each batch
    writes the rows that changed to its own ``batch`` folder, so a retry after a lost executor replaces what it wrote; :func:`latest`
    gives the current rows. Run it after a curation has ended: a curation batch that fails and runs again writes new files.
    """
    saved = spark.read.parquet(table).schema
    rows = spark.readStream.schema(saved).option("maxFilesPerTrigger", max_files).parquet(table)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    writer = counts(rows).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The current row of each key of a table of changes, that of its last ``batch``; without keys the one current row."""
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*keys, "r.*")
