import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(__file__))


def order(row):
    return tuple((x is None, str(type(x)), x) if not isinstance(x, bool) else (False, "", x) for x in row)


@pytest.fixture(scope="session")
def rows_of():
    """All rows of a frame in a fixed order."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=order)


@pytest.fixture(scope="session")
def in_order():
    return lambda rows: sorted(rows, key=order)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """(doc_id, text) of the given documents."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def docs_frame(spark):
    """A documents table of (doc_id, text) rows; extra columns are named like the operators' own."""
    schema = T._parse_datatype_string("doc_id long, text string, lang string, source string, n_chars long, score string, row int, fp string, held_out int, spans int, kept string, key int")

    def make(rows, parts=3):
        return spark.createDataFrame([(d, t, None, "s", None if t is None else len(t), "x", 1, None, 0, 2, None, None) for d, t in rows], schema).repartition(parts)

    return make


ODD = [(None, None), (None, "a null id"), (1, None), (2, ""), (3, "\n"), (4, " \t\r\n "), (5, "née 日本 𝄞 \x1c x\n\n"), (6, "same"), (6, "same"), (6, "other"), (7, "word " * 9000), (8, "x" * 30000)]


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, ties and repeated rows."""
    return ODD
