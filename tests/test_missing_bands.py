"""The last chip of the pixel table may hold only its first bands."""

import pytest

from tidemark.plans import catalogue, check


@pytest.fixture(scope="module")
def odd(folder, tmp_path_factory):
    """Vectors of three whole chips and one band more."""
    import duckdb

    path = tmp_path_factory.mktemp("odd")
    duckdb.sql(f"COPY (SELECT * FROM '{folder}/embeddings.parquet' WHERE vec_id < 37) TO '{path}/embeddings.parquet' (FORMAT parquet)")
    return str(path)


def test_hull_spectrum_of_a_chip_with_one_band(spark, odd):
    name = "h11_hull_spectrum"
    assert check.compare(catalogue.QUERIES[name](spark, odd), catalogue.ORACLES[name], odd) is None


@pytest.mark.parametrize("name", ["k2_landmarks", "l6_heatmap_entropy"])
def test_missing_heatmap_planes_have_no_peak(spark, odd, name):
    assert check.compare(catalogue.QUERIES[name](spark, odd), catalogue.ORACLES[name], odd) is None
