"""What Python workers keep after a stage of the pipeline."""

import gc
import shutil

import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import pair_bpe


def test_round_trip_leaves_no_words_behind(spark, tmp_path):
    # A path of its own tells this test's encoders from those of others in the same workers.
    path = shutil.copy(public_tokenizers.path("word_bpe_49k.json"), tmp_path / "vocabulary.json")
    docs = spark.createDataFrame([(f"some words, and number {i}",) for i in range(64)], "text string").repartition(8)
    rows = docs.select(pair_bpe.round_trip(F.col("text"), str(path)).alias("d")).select("d.n_tokens").collect()
    assert len(rows) == 64 and all(r["n_tokens"] > 4 for r in rows)

    def kept(batches):
        for batch in batches:
            own = pair_bpe.vocabulary(str(path))
            yield pd.DataFrame({"n": [sum(isinstance(x, pair_bpe.Encoder) and x.vocabulary is own for x in gc.get_objects())] * len(batch)})

    assert [r["n"] for r in docs.mapInPandas(kept, "n long").distinct().collect()] == [0]
