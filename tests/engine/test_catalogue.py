"""A few queries of each kind against their SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from siteloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()
FOLDER = "/root/testdata/sf0.001"
SOME = ("SRC1", "SRC2", "SRC5", "SRC6", "SRC8", "SRC9", "SRC10", "SRC11", "SRC13", "SRC16", "SRC19", "SNK1", "SNK2", "SNK3", "SNK6", "CMP4", "CMP5", "CMP9", "FN21", "FN25", "FN38", "JN22", "JN23", "STAT13", "STAT14", "STAT18", "CMP10", "UDF1", "UDF5")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else int(value) if value == int(value) else value
    return [plain(v) for v in value] if isinstance(value, list | tuple) else value


def test_every_query_has_sql():
    assert catalogue.queries().keys() == catalogue.oracle_sql().keys() and set(SOME) <= catalogue.queries().keys()


@pytest.fixture(scope="module")
def peer():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, peer, name):
    rows = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(rows.columns)
    found = peer.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((plain([r[names.index(c)] for c in columns]) for r in found.fetchall()), key=repr)
    assert sorted((plain([r[c] for c in columns]) for r in rows.collect()), key=repr) == want


def test_the_sweep_is_whole(spark, peer):
    """STAT15 takes the reference's 200 seeds and 2,000 draws of each, and ends in their verdicts."""
    test_equals_sql(spark, peer, "STAT15")
    (row,) = catalogue.queries()["STAT15"](spark, FOLDER).collect()
    sql = catalogue.oracle_sql()["STAT15"]
    assert "range(2000)" in sql and str(list(range(200))) in sql
    assert row.n_seeds == 200 == row.n_equivalent + row.n_beyond_margin + row.n_directional + row.n_inconclusive
