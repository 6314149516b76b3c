import pytest
from pyspark.sql import Row

EXTRA = {"id": 7, "key": "k", "row": "r", "_key": 1, "sha": "s", "n": 2, "lines": "l", "node": 3, "rows": 4, "kept": True, "ids": "i", "p": 1.0, "place": 5, "size": 6, "copies": 8, "found": "f", "run": 9}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from (id, text) pairs; ``extra`` adds columns whose names might clash."""

    def build(rows, extra=False):
        df = spark.createDataFrame(
            [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], SCHEMA
        )
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({name: F.lit(value) for name, value in EXTRA.items()})
        return df

    return build


@pytest.fixture
def got():
    def collect(df, *columns):
        rows = df.select(*columns).collect() if columns else df.collect()
        return sorted((tuple(r) for r in rows), key=repr)

    return collect


@pytest.fixture
def label(spark):
    def build(rows):
        return spark.createDataFrame([Row(*r) for r in rows], "doc_id long, quality int, toxic int")

    return build
