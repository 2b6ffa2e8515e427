"""Log round trips, file listings, spectra files, chip stores, the stream."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import labels as LB
from tidemark.operators import spectral as SP
from tidemark.sources import labels as SL
from tidemark.sources import scenes as SS
from tidemark.streaming import labels as ST


def write(path, *lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def review(i, category, **more):
    return {"id": f"r{i}", "tci_path": "/d/s.jp2", "cx_full": 1.0 * i, "cy_full": 2.0, "review_category": category,
            "reviewed_at": f"2024-01-0{i}T00:00:00+00:00", **more}


def test_reads_tolerantly(spark, tmp_path):
    p = write(
        tmp_path / "a.jsonl", review(1, "vessel", extra={"wake_present": True, "estimated_length_m": 120.5}), "", "{broken",
        review(2, "not_vessel", extra=None), review(3, "not_a_ship"), review(4, "ambiguous"), "[1]",
        {"id": "t", "record_type": "overview_grid_tile", "grid_row": 1, "grid_col": 2, "cx_full": -1.0, "cy_full": -1.0},
        {"id": "x", "cx_full": "no number", "review_category": "land"},
    )
    rows = {r.id: r for r in SL.read_labels(spark, p).collect()}
    assert set(rows) == {"r1", "r2", "r3", "r4", "t", "x"}
    assert rows["r1"].wake_present is True and rows["r1"].estimated_length_m == 120.5
    assert rows["r2"].review_category == rows["r3"].review_category == "water"
    assert rows["x"].cx_full is None and rows["t"].grid_col == 2
    assert sorted(r.line for r in SL.corrupt_lines(spark, p).collect()) == ["[1]", "{broken"]
    assert SL.ingest_counts(spark, p).first().asDict() == {"n_lines": 8, "n_parsed": 6, "n_corrupt": 2}
    assert LB.verified_counts(SL.read_labels(spark, p)).first().asDict() == {"total": 4, "n_vessel": 1, "n_negative": 3}


def test_counts_and_folder(spark, tmp_path):
    write(tmp_path / "a.jsonl", review(1, "vessel"), review(2, "cloud"))
    write(tmp_path / "b.jsonl", review(3, "ambiguous"))
    df = SL.read_labels(spark, str(tmp_path / "*.jsonl"))
    assert LB.verified_counts(df).first().asDict() == {"total": 2, "n_vessel": 1, "n_negative": 1}
    assert df.select("file").distinct().count() == 2


def test_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    new = spark.createDataFrame([("/d/s.jp2", 5.0, 6.0, "vessel"), ("/d/s.jp2", 7.0, 8.0, "land")],
                                "tci_path string, cx_full double, cy_full double, review_category string")
    SL.append_reviews(new, path)
    size = spark.createDataFrame([("/d/s.jp2", 5.0, 6.0, 100.0, 20.0, "markers", None, True)],
                                 "tci_path string, cx_full double, cy_full double, estimated_length_m double, estimated_width_m double,"
                                 "footprint_source string, human_length_m double, transhipment_side_by_side boolean")
    SL.append_size_feedback(size, path)
    tile = spark.createDataFrame([("/d/s.jp2", 1, 2, 10, "land_empty", 0.01, 0, " x ")],
                                 "tci_path string, grid_row int, grid_col int, grid_divisions int, feedback_kind string,"
                                 "tile_water_fraction double, tile_detector_count int, notes string")
    SL.append_grid_feedback(tile, path)
    scenes = spark.createDataFrame([("s.jp2", 4326, 0.001, -0.001, 100.0, 2.0, 10, 10)],
                                   "scene string, epsg int, a double, e double, x0 double, y0 double, width int, height int")
    seen = spark.createDataFrame([("/d/s.jp2", 1.0, 1.0, "water"), ("/d/gone.jp2", 1.0, 1.0, "water")],
                                 "tci_path string, cx_full double, cy_full double, review_category string")
    SL.append_witness(seen, scenes, path)
    rows = SL.read_labels(spark, path).collect()
    kinds = sorted(str(r.record_type) for r in rows)
    assert kinds == ["None", "None", "overview_grid_tile", "static_sea_witness", "vessel_size_feedback"]
    assert len({r.id for r in rows}) == 5
    text = spark.read.text(path).filter(F.col("value").contains("vessel_size_feedback")).first().value
    assert "human_length_m" not in text and "transhipment_side_by_side" in text
    tile_row = next(r for r in rows if r.record_type == "overview_grid_tile")
    assert (tile_row.cx_full, tile_row.review_category) == (-1.0, None)
    assert next(r for r in rows if r.record_type == "static_sea_witness").lon == pytest.approx(100.0015)
    bad = new.withColumn("review_category", F.lit("boat"))
    with pytest.raises(Exception, match="unknown review_category"):
        SL.append_reviews(bad, path)


def test_pseudo_chips(spark, tmp_path):
    p = write(tmp_path / "p.jsonl", {"tci_path": "a", "cx_full": 1, "cy_full": 2, "extra": {"af_export_uncertainty": 7}},
              {"tci_path": "a", "cx_full": 1, "cy_full": 2, "id": "k"}, {"tci_path": "", "cx_full": 1, "cy_full": 2}, {"cx_full": 1})
    rows = SL.read_pseudo_chips(spark, p).collect()
    assert sorted(r.export_uncertainty for r in rows) == [0.0, 1.0]
    assert any(r.id == "k" for r in rows) and any(r.id.startswith("pseudo_") for r in rows)


def test_scene_listing(spark, tmp_path):
    for n in ("B_TCI_10m.jp2", "a_TCI_10m.jp2", "a_SCL_20m.jp2", "a_TCI_10m.txt"):
        (tmp_path / n).write_bytes(b"x")
    names = [r.path.rsplit("/", 1)[1] for r in SS.list_scenes(spark, str(tmp_path)).collect()]
    assert names == ["a_TCI_10m.jp2", "B_TCI_10m.jp2"]


def test_spectral_library(spark, tmp_path):
    write(tmp_path / "s07SNTL2_Concrete_GDS375_x.txt", "title", "# note", *[f"{i / 100} rest" for i in range(13)])
    write(tmp_path / "s07SNTL2_Hematite_HS45.3.txt", "title", "-1.23e34", *[f"{i / 100}" for i in range(1, 13)])
    write(tmp_path / "s07SNTL2_Steel_Metal_GDS476.txt", "0.1", "0.2")
    got = {r.material: list(r.spec) for r in SS.build_spectral_library(spark, str(tmp_path)).collect()}
    assert got["concrete/cement"] == [0.03, 0.02, 0.01, 0.07, 0.04, 0.05, 0.06, 0.08, 0.11, 0.12, 0.0, 0.09]
    assert got["rust (hematite-type)"][10] is None and len(got) == 2
    library = SS.build_spectral_library(spark, str(tmp_path))
    best = SP.best_two(library.filter("material = 'concrete/cement'").select("sample", "spec"), library).first()["match"]
    assert (best.material, best.category) == ("concrete/cement", "vessel") and best.angle == pytest.approx(0, abs=1e-6)


def test_chip_store(spark, tmp_path):
    want = SS.with_chip_keys(spark.createDataFrame([("/d/a.jp2", 1.0, 2.0), ("/d/a.jp2", 1.0, 2.0), ("/d/b.jp2", 1.0, 2.0)],
                                                   "tci_path string, cx_full double, cy_full double"))
    SS.write_chips(want.filter("tci_path = '/d/b.jp2'"), str(tmp_path / "chips"))
    left = SS.missing_chips(want, spark.read.parquet(str(tmp_path / "chips"))).collect()
    assert [r.tci_path for r in left] == ["/d/a.jp2"]


def test_stream(spark, tmp_path):
    log, table = tmp_path / "log", str(tmp_path / "table")
    log.mkdir()
    undated = {k: v for k, v in review(4, "cloud", extra={"note": "x"}).items() if k != "reviewed_at"}
    run = lambda: ST.run_curation(spark, str(log), table, str(tmp_path / "cp")).awaitTermination(120)
    write(log / "1.json", review(1, "vessel"), "{broken", review(2, "not_vessel"))
    run()
    old = review(3, "land") | {"reviewed_at": "2001-05-01T00:00:00+00:00"}
    write(log / "2.json", review(2, "land"), old, undated, undated)
    run()
    write(log / "3.json", review(5, "vessel"), review(1, "cloud"), review(6, "water") | {"reviewed_at": "no time"})
    run()
    rows = spark.read.parquet(table).collect()
    assert sorted((r.id, r.review_category) for r in rows) == [
        ("r1", "vessel"), ("r2", "water"), ("r3", "land"), ("r4", "cloud"), ("r5", "vessel"), ("r6", "water")]
    assert json.loads(next(r.extra for r in rows if r.id == "r4")) == {"note": "x"}
    q = ST.running_counts(ST.stream_labels(spark, str(log))).writeStream.format("memory").queryName("running").outputMode("update")
    q = q.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert max(r.total for r in spark.table("running").collect()) == 9


def test_versions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "id string, v int")
    path = SL.write_version(df, str(tmp_path), 1)
    with pytest.raises(Exception):
        SL.write_version(df, str(tmp_path), 1)
    assert spark.read.parquet(path).count() == 1


def test_latest_takes_the_last_batch_of_each_key(spark):
    rows = [("a", 1, 0), ("b", 5, 0), ("a", 2, 1), ("a", 3, 10), (None, 1, 2), (None, 4, 3)]
    changes = spark.createDataFrame(rows, "k string, hits long, batch int")
    assert {tuple(r) for r in ST.latest(changes, ["k"]).collect()} == {("a", 3), ("b", 5), (None, 4)}
    assert [tuple(r) for r in ST.latest(changes.drop("k"), []).collect()] == [(3,)]
