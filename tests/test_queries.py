"""Queries against their SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, sf, name):
    db = duckdb.connect()
    for t in os.listdir(sf):
        db.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    want = db.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def _same_as_sql(spark, folder, name, tables):
    """The query and its SQL over small tables of their own."""
    db = duckdb.connect()
    for table, made in tables.items():
        db.execute(f"COPY ({made}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = db.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, str(folder)).toPandas()[list(want.columns)]
    rows = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))
    assert rows(got) == rows(want)
    return got


#: Products with the first vector that are halves at three places, one side or the other of them in binary, and negative ones that round to zero.
_HALVES = "SELECT i AS vec_id, [x::FLOAT, (CASE WHEN i = 0 THEN 0 ELSE 1 END)::FLOAT] AS embedding, 0::INTEGER AS label FROM (SELECT unnest([{values}]) AS x, unnest(range({n})) AS i)"


def _halves(*values):
    return {"embeddings": _HALVES.format(values=", ".join(map(str, (1.0, *values))), n=len(values) + 1)}


@pytest.mark.parametrize("name", ["answer_with_sources", "build_context", "build_context_search", "build_context_sources"])
def test_scores_at_three_places_round_as_in_sql(spark, tmp_path, name):
    got = _same_as_sql(spark, tmp_path, name, _halves(0.5105, 0.9125, 0.2555, 0.1005))
    assert "0.5100" in got.iloc[0, 1]  # 0.5110 by the shortest decimal
    low = tmp_path / "low"
    low.mkdir()
    got = _same_as_sql(spark, low, name, _halves(-0.0000001, -0.0003, -0.0005, -0.0015))
    assert "-0.0000" in got.iloc[0, 1]


@pytest.mark.parametrize("name", ["knn_topk", "knn_topk_batch", "knn_cells"])
def test_scores_at_six_places_round_as_in_sql(spark, tmp_path, name):
    """Products that are halves in binary: 0.0078125 is 0.007813, not the even 0.007812."""
    got = _same_as_sql(spark, tmp_path, name, _halves(0.0078125, 0.0234375, -0.0078125, 0.0000004))
    assert 0.007813 in got.score.tolist() and -0.007813 in got.score.tolist()


#: Pages by their ids: titles that end within a reference, and titles without a character of ASCII where only those stay in the crawl's bodies.
_TITLES = {12: "token = &quot", 24: "it&#x2", 36: "it&#x27", 48: "a &lt", 60: "b &gt", 72: "A&am", 84: "A&amp", 9: "É É", 25: "Ç È", 28: "Über &quot; und &#x27;"}


def _titled():
    page = "'<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>' || t || '</title></head><body><article><h1>' || t || '</h1><p>Page ' || n || repeat(' has words', 40) || '</p><a href=\"/x\">' || t || '</a></article></body></html>'"
    values = ", ".join(f"({n}::BIGINT, '{t}')" for n, t in _TITLES.items())
    return {"pages": f"SELECT n AS page_id, 'http://h.example/' || n AS url, {page} AS html FROM (VALUES {values}) v(n, t)"}


@pytest.mark.parametrize("name", ["crawl_questions"])
def test_cut_off_references_and_empty_titles_as_in_sql(spark, tmp_path, name):
    got = _same_as_sql(spark, tmp_path, name, _titled())
    assert " - chunk 1" in got.source_title.tolist() and "token = &quot - chunk 1" in got.source_title.tolist()


@pytest.mark.parametrize("name", ["crawl_records", "page_titles", "html_extract", "html_extract_base", "extract_links", "decode_bodies"])
def test_pages_with_cut_off_references_as_in_sql(spark, tmp_path, name):
    _same_as_sql(spark, tmp_path, name, _titled())
