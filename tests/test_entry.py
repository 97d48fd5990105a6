"""Every oracle is held against its query on a small scale; queries without one must run."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def _rows(df, cols):
    return sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_oracle(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and _rows(got, cols) == _rows(want, cols)


@pytest.mark.parametrize("name", ["html_extract", "text_extract", "chunk_document", "hungarian", "dedup_docs", "dedup_corpus", "apply_fetched", "retrieve_context", "page_images", "chunk_profiles"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 1


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_hungarian_takes_all_rows_and_components(spark):
    import numpy as np

    from siftwood.functions.model_text import assign

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = entry.queries()["hungarian"](spark, SF).toPandas()
    for label, of_label in rows.groupby("label"):
        s = np.array(of_label["embedding"].tolist(), float)
        mine = got[got["label"] == label]
        assert len(mine) == min(s.shape) and mine["slot"].nunique() == len(mine) == mine["vec_id"].nunique()
        assert abs(mine["similarity"].sum() - sum(s[r][c] for r, c in assign(s))) < 1e-6
