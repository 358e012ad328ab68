"""Every query that SQL can express against that SQL in DuckDB, on the same files."""

import datetime
import decimal

import duckdb
import pytest

from sparkkv.plans import queries as kv

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1 << 50 else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(kv.queries()))
def test_query(spark, duck, data, name):
    df = kv.queries()[name](spark, data)
    got = table(df.columns, df.collect())
    if name not in kv.oracle_sql():
        assert got[1]
        return
    cur = duck.execute(kv.oracle_sql()[name])
    want = table([c[0] for c in cur.description], cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["epoch_stamps", "rate_limit"])
def test_every_millisecond(spark, duck, data, name):
    """As test_query, but to the last digit, which ``plain`` leaves out of large numbers."""
    df = kv.queries()[name](spark, data)
    cur = duck.execute(kv.oracle_sql()[name])
    assert sorted(map(tuple, df.select(*[c[0] for c in cur.description]).collect())) == sorted(cur.fetchall())


@pytest.mark.parametrize("name", ["epoch_stamps", "rate_limit"])
def test_odd_times(spark, tmp_path, name):
    """Nulls, halves of a millisecond, times before 1970, equal times and bursts."""
    con = duckdb.connect()
    micros = "CASE WHEN i % 11 = 3 OR i % 7 = 6 THEN NULL ELSE (i // 9) * 700000500 - 5000000000 + i % 5 * 250 END"
    con.execute(f"COPY (SELECT i AS event_id, make_timestamp(CAST({micros} AS BIGINT)) AS ts, i % 7 - 2 AS user_id FROM range(1500) t(i)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    cur = con.execute(kv.oracle_sql()[name])
    got, want = kv.queries()[name](spark, str(tmp_path)).select(*[c[0] for c in cur.description]).collect(), cur.fetchall()
    assert len(want) == 1500 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
@pytest.mark.parametrize("kind", ["TIMESTAMP", "TIMESTAMPTZ"])
@pytest.mark.parametrize("name", ["epoch_stamps", "rate_limit"])
def test_times_in_any_zone(spark, tmp_path, name, kind, zone):
    """The session's zone changes nothing, where clocks change and at the ends of time too; infinite times are null."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    ends = "CASE i WHEN 0 THEN TIMESTAMP 'infinity' WHEN 1 THEN TIMESTAMP '-infinity' WHEN 2 THEN make_timestamp(9223372036854775306) WHEN 3 THEN make_timestamp(-9223372022400000000)"
    shifts = "make_timestamp(CAST(CASE WHEN i % 2 = 0 THEN 1710032400000000 ELSE 1730592000000000 END + i * 120000500 AS BIGINT))"  # over New York's of 2024, as times with and without a zone
    con.execute(f"COPY (SELECT i AS event_id, CAST({ends} ELSE {shifts} END AS {kind}) AS ts, i % 7 AS user_id FROM range(300) t(i)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    cur = con.execute(kv.oracle_sql()[name])
    want = cur.fetchall()
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = kv.queries()[name](spark, str(tmp_path)).select(*[c[0] for c in cur.description]).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(want) == 300 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
