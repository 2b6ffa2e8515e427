"""Scene files and chips on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.labels import basename, col
from tidemark.functions.names import BANDS, SPECTRUM_BANDS

RASTER_SUFFIXES = ("jp2", "tif", "tiff", "img", "vrt")


def list_scenes(spark: SparkSession, folder: str, pattern: str = "*TCI*") -> DataFrame:
    """Distinct raster files below a folder whose name fits ``pattern``, in case-insensitive order.

    Only names, sizes and times are read; the content column is pruned from the scan.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .load(folder).select("path", "length", "modificationTime")
    )
    suffix = F.lower(F.regexp_extract(basename("path"), r"\.([^.]*)$", 1))
    return files.filter(suffix.isin(*RASTER_SUFFIXES)).distinct().orderBy(F.lower("path"))


def scene_key(path) -> "F.Column":
    """Stable folder name of a scene: file stem and 12 hex digits of the path's hash."""
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    return F.concat_ws("_", stem, F.substring(F.sha2(col(path), 256), 1, 12))


def chip_key(x, y, side: int, half: int) -> "F.Column":
    """16 hex digits over centre (two decimals), chip side and half size."""
    at = [F.format_string("%.2f", F.bround(col(c), 2)) for c in (x, y)]
    return F.substring(F.sha2(F.concat_ws("|", *at, F.lit(str(side)), F.lit(str(half))), 256), 1, 16)


def with_chip_keys(df: DataFrame, side: int = 48, half: int = 64, path="tci_path", x="cx_full", y="cy_full") -> DataFrame:
    return df.withColumns({"scene_key": scene_key(path), "chip_key": chip_key(x, y, side, half)})


def write_chips(df: DataFrame, path: str) -> None:
    """Append chips, one folder per scene, so a scene's chips are read without scanning the rest."""
    df.write.mode("append").partitionBy("scene_key").parquet(path)


def missing_chips(want: DataFrame, have: DataFrame) -> DataFrame:
    """Wanted chips the store does not hold yet; a wanted chip named twice is made once."""
    return want.dropDuplicates(["scene_key", "chip_key"]).join(
        have.select("scene_key", "chip_key"), ["scene_key", "chip_key"], "left_anti"
    )


#: Position of each channel in a 13-band spectrum file (band 10 is no channel).
LIBRARY_ORDER = tuple(SPECTRUM_BANDS.index(band) for _, band, *_ in BANDS)
LIBRARY_DELETED = -1e30


# Sample ids of published spectra and the material each stands for.
SAMPLE_MATERIALS = {
    "Steel_Metal_GDS476": "bare steel/iron",
    "Aluminum_Metal_GDS500": "bare aluminium",
    "Rubber_Black_GDS482": "black rubber/carbon",
    "Concrete_GDS375": "concrete/cement",
    "Hematite_HS45.3": "rust (hematite-type)",
    "Goethite_WS222": "rust (goethite-type)",
    "Seawater_Open_Ocean_SW2": "clear open ocean",
    "Oil_Slick_DWH_May2010": "crude oil slick",
}
# Materials that are no part of a vessel.
BACKGROUND_CATEGORIES = {"clear open ocean": "water", "crude oil slick": "oil"}


def build_spectral_library(
    spark: SparkSession, folder: str, names: dict[str, str] | None = None, pattern: str = "s07SNTL2_*.txt"
) -> DataFrame:
    """Spectra from text files: the first number of each line, 13 bands put into the 12-channel order.

    Comment lines and lines without a leading number are skipped, files with fewer than 13 numbers are
    left out, and a deleted value becomes null. ``names`` maps sample ids to materials; ``pos`` is the place of the sample
    in it and ``category`` is that of the material, so the table serves the matching operators as it is.
    """
    names = SAMPLE_MATERIALS if names is None else names
    files = (
        spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .text(folder, wholetext=True).select("value", basename(F.col("_metadata.file_path")).alias("name"))
    )
    lines = F.filter(F.split("value", "\r?\n"), lambda s: ~F.trim(s).startswith("#"))
    first = lambda s: F.get(F.split(F.trim(s), r"\s+"), 0).try_cast("double")
    spec = files.withColumn("v", F.filter(F.transform(lines, first), lambda n: n.isNotNull())).filter(F.size("v") >= 13)
    pick = lambda i: F.when(F.get("v", i) >= LIBRARY_DELETED, F.get("v", i))
    known = [(i, s, m, BACKGROUND_CATEGORIES.get(m, "vessel")) for i, (s, m) in enumerate(names.items())]
    table = spark.createDataFrame(known, "pos int, sample string, material string, category string")
    hit = F.lower(F.col("name")).contains(F.lower("sample"))
    # The names are a literal of the caller, a few rows.
    return spec.join(F.broadcast(table), hit).select(
        "pos", "sample", "material", "category", F.array(*[pick(i) for i in LIBRARY_ORDER]).alias("spec")
    )
