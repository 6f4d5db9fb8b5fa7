"""incremental_ingest agrees with its SQL where sessions' numbers have more digits than the smallest tables' have."""

import duckdb
import pytest
from test_queries import SF, value

from lapwing.plans import catalogue

NAME = "incremental_ingest"


@pytest.fixture
def agrees(spark, tmp_path):
    def compare(sql):
        duckdb.sql(f"COPY ({sql.format(f"'{SF}/events.parquet'")}) TO '{tmp_path}/events.parquet'")
        con = duckdb.connect()
        con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
        rel = con.sql(catalogue.ORACLES[NAME])
        want = sorted(tuple(map(value, r)) for r in rel.fetchall())
        got = catalogue.QUERIES[NAME](spark, str(tmp_path)).select(*rel.columns)
        assert sorted(tuple(map(value, r)) for r in got.collect()) == want
        return want

    return compare


def test_numbers_of_more_than_four_and_six_digits(agrees):
    far = "CASE WHEN user_id % 3 = 0 THEN user_id + 9990 WHEN user_id % 3 = 1 THEN user_id + 3000000 WHEN user_id <> 2 THEN user_id - 15 END"
    got = agrees(f"SELECT * REPLACE ({far} AS user_id) FROM {{}} WHERE user_id < 9")
    assert len(got) == 8
