"""Every registered query that has SQL, against DuckDB on the small tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v) -> str:
    if isinstance(v, list | tuple | np.ndarray):
        return "[" + ",".join(map(text, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float | np.floating) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float | np.floating) else str(v)


def rows(df: pd.DataFrame) -> list[str]:
    return sorted("|".join(map(text, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def blank(tmp_path_factory):
    """Tables with texts that are empty, blank or null, some of which are revised in the second batch."""
    folder = tmp_path_factory.mktemp("blank")
    texts = {1: "''", 2: "' ' || chr(10) || '  '", 3: "NULL", 4: "''", 5: "'one' || chr(10) || 'one' || chr(10) || 'two'", 6: "'one' || chr(10) || 'two'", 7: "chr(10)", 8: "'six' || chr(10) || chr(10) || 'six'"}
    docs = " UNION ALL ".join(f"SELECT {n}::BIGINT AS doc_id, {t}::VARCHAR AS text, 'en' AS lang, 'src{n}' AS source, 0::BIGINT AS n_chars" for n, t in texts.items())
    duckdb.sql(f"COPY ({docs}) TO '{folder}/documents.parquet'")
    duckdb.sql(f"COPY (SELECT 1::BIGINT AS conv_id, 0 AS turn, 'user' AS role, '' AS text UNION ALL SELECT 2, 0, 'user', 'hello') TO '{folder}/conversations.parquet'")
    duckdb.sql(f"COPY (SELECT * FROM '{DATA}/embeddings.parquet' LIMIT 5) TO '{folder}/embeddings.parquet'")
    return folder


@pytest.mark.parametrize("name", ["chunk_dedup", "stats_by_domain", "version_history_counts"])
def test_blank_texts(spark, blank, name):
    """a version without lines is a version."""
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{blank}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(blank)).toPandas(), con.sql(ORACLES[name]).df()
    assert rows(got) == rows(want)
