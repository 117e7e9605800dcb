"""Queries against their DuckDB twins on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return f"{float(v):.9g}" if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    r = duck.execute(registry.oracles()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
    assert found == want


@pytest.mark.parametrize("name", ["paragraph_chunks", "legal_chunks", "qa_chunks", "section_split", "context_pack", "entity_link", "page_text", "ann_topk", "section_table_chunks", "chunk_similarity", "heading_scores", "random_sample", "marked_blocks", "tfidf_kmeans"])
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
