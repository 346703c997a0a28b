"""Small tables as files, as the operators read them."""

from __future__ import annotations

import itertools

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def written(spark, tmp_path):
    """Writes rows as a table and reads it back, in a few files."""
    number = itertools.count()

    def write(rows, schema=DOCUMENTS, files=3):
        path = str(tmp_path / f"table{next(number)}")
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    return write


@pytest.fixture
def documents(written):
    """Documents from (doc_id, text) pairs."""

    def make(pairs, files=3):
        return written([(i, t, "en", "s", len(t or "")) for i, t in pairs], files=files)

    return make
