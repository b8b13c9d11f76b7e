"""The expressible queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tellurion.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    tidy = lambda d: d[cols].apply(lambda s: s.map(lambda v: "~" if not isinstance(v, str) and pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v))).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string"
ODD = [
    (1, None, "en", None, 0, 9, "x"), (2, "", "en", "b", 0, 9, "x"), (3, " \t\n", None, "b", 3, None, "x"), (4, "One two three.", "en", "a", 14, 1, None), (4, "One two three.", "en", "a", 14, 1, None),
    (None, "word " * 30000, "en", "a", 150000, 1, "y"), (6, "Released under the MIT\nLicense. Then more words", "en", "ü", 47, 1, "y"), (7, "é à %%% ### " * 40, "fr", "c", 1, 1, "z")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, blanks, repeats, a very long text and columns with clashing names, as a folder of tables."""
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ODD, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "word word word word word word word word word word"), (2, None), (3, "three"), (None, "x")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1), (4, 0), (None, 1), (4, None)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, 1, [0.5]), (100, None, [0.5]), (200, 2, None), (7, 1, [None]), (None, 1, [0.25, 0.5]), (3, 2, [0.45]), (3, 2, [0.45])], "vec_id long, label int, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(1, "u", None), (2, None, "a" * 2000), (2, None, "a" * 2000), (3, "v", "a" * 2000), (None, "w", "short")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd).collect()
    assert len(rows) == {"op7_warc": 5, "op12_hard_negatives": 0}.get(name, len(ODD))


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").where("false").write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0
