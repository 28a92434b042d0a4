"""Every registered query of the analytics part against its SQL on DuckDB."""

import decimal

import duckdb
import pytest

from fastbreak.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return v


def rows(columns, data):
    return sorted(tuple(str(plain(r[c])) for c in columns) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.sql(ORACLE_SQL[name])
    columns = sorted(ours.columns)
    assert sorted(theirs.columns) == columns
    assert rows(columns, [r.asDict() for r in ours.collect()]) == rows(columns, [dict(zip(theirs.columns, r)) for r in theirs.fetchall()])


@pytest.mark.parametrize("name", ["k02_actions_clean", "k02_first_of_repeated", "k02_landed_actions", "k05_possessions"])
def test_children_of_action_zero(spark, tmp_path, name):
    """A parent id of 0 means none, also where the first action of a game has this id and a rebound follows."""
    con = duckdb.connect()
    kinds = "CASE WHEN event_id = 0 THEN 'view' WHEN event_id <= 30 THEN 'click' ELSE event_type END AS event_type"
    con.sql(f"COPY (SELECT * REPLACE ({kinds}) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    ours, theirs = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLE_SQL[name])
    columns = sorted(ours.columns)
    assert rows(columns, [r.asDict() for r in ours.collect()]) == rows(columns, [dict(zip(theirs.columns, r)) for r in theirs.fetchall()])


REPEATS = {
    "again later": "SELECT * REPLACE (ts + INTERVAL 1 SECOND AS ts, '{\"k\": ' || (event_id * 7) % 100 || '}' AS props) FROM e WHERE event_id % 7 = 0 AND event_type <> 'error'",
    "at one time by another player": "SELECT * REPLACE (user_id + 4 AS user_id) FROM e WHERE event_id % 5 = 0",
    "twice, and without a time": "SELECT * FROM e WHERE event_id % 13 = 0 UNION ALL SELECT * REPLACE (NULL::TIMESTAMP AS ts) FROM e WHERE event_id % 11 = 0",
}


def repeated(spark, tmp_path, name, more):
    """A query's rows and those of its SQL, on events and more of them with the same ids."""
    con = duckdb.connect()
    con.sql(f"COPY (WITH e AS (FROM '{SF}/events.parquet') SELECT * FROM e UNION ALL {more}) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    ours, theirs = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLE_SQL[name])
    columns = sorted(ours.columns)
    return rows(columns, [r.asDict() for r in ours.collect()]), rows(columns, [dict(zip(theirs.columns, r)) for r in theirs.fetchall()])


@pytest.mark.parametrize("more", REPEATS.values(), ids=REPEATS)
def test_first_of_repeated(spark, tmp_path, more):
    """Of actions with one game, team and id the first counts, on both sides."""
    ours, theirs = repeated(spark, tmp_path, "k02_first_of_repeated", more)
    assert ours == theirs


def test_parents_of_repeated_in_documents(spark, tmp_path):
    """Where actions of several types have one id in a document, their parent doesn't depend on their order."""
    mixed = "SELECT * REPLACE ('click' AS event_type) FROM e WHERE event_id % 3 = 0 UNION ALL SELECT * REPLACE ('view' AS event_type, ts + INTERVAL 2 SECOND AS ts) FROM e WHERE event_id % 4 = 0"
    ours, theirs = repeated(spark, tmp_path, "k02_landed_actions", " UNION ALL ".join([*REPEATS.values(), mixed]))
    assert ours == theirs
