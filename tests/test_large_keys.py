"""Queries whose keys have more digits than those of the small tables agree with their SQL."""

import datetime

import duckdb

from ledgerloom.plans.catalog import ORACLES, QUERIES


def differs(spark, at, name, **tables):
    """Rows that only the query has, and those that only its SQL has."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(at))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in got.collect()]
    assert got
    return [r for r in got if r not in want], [r for r in want if r not in got]


def test_name_forms_of_long_numbers(spark, tmp_path):
    parts = [(k, "large ring") for k in (0, 12, 999_999, 1_000_002, 1_000_003, 12_000_000)]
    assert differs(spark, tmp_path, "name_forms", part=("p_partkey long, p_name string", parts)) == ([], [])


def test_orders_alike_in_their_last_digits_have_their_own_accession(spark, tmp_path):
    """Of two orders of a customer in a year, 3,000,000 apart, the one without a registrant shares nothing with the other."""
    day = datetime.datetime(1996, 5, 1)
    orders = [(k, 500, day, "1-URGENT") for k in (13 * 7, 13 * 7 + 3_000_000)] + [(k, 501, day, "5-LOW") for k in (8, 3_000_008, 14_000_008)] + [(9, None, day, "5-LOW")]
    found = differs(spark, tmp_path, "eligibility", orders=("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string", orders), customer=("c_custkey long", [(1,), (500,), (501,)]))
    assert found == ([], [])
