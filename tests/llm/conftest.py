import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """A frame of documents from (doc_id, text[, lang, source])."""

    def make(rows):
        full = [(r[0], r[1], (r + ("en", "s0"))[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1]) if r[1] is not None else None) for r in map(tuple, rows)]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def table_dir(spark, tmp_path_factory):
    """Writes frames as ``name.parquet`` in a new folder and returns the folder."""

    def write(**frames):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in frames.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write


def invented(seed: int, words: int, vocabulary: int = 3000) -> list[str]:
    """Words of an invented language; a seed gives the same words again."""
    import random

    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary):x}" for _ in range(words)]
