"""Fixtures of the corpus operators: small tables, whole tables, plain rows."""
import os

import pytest

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not mounted")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]
