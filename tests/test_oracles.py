"""Every registered query against its SQL on the smallest given tables."""

from __future__ import annotations

import os

import pytest
from compare import differences, engine

import __spark_entry__ as entry
import oracles
from lanewise.plans.registry import registered

DIRECTORY = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, STATEMENTS = registered(), oracles.statements()


@pytest.fixture(scope="module")
def con():
    return engine(DIRECTORY)


#: Depends on the order of all rows, which SQL can only follow row by row; held against a replay below.
WITHOUT_SQL = {"a3_append_under_all_keys"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(STATEMENTS) | WITHOUT_SQL and not set(STATEMENTS) & WITHOUT_SQL
    assert set(QUERIES) <= set(entry.queries()) and set(STATEMENTS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, DIRECTORY), con, STATEMENTS[name]) == []


def test_append_under_all_keys_equals_a_replay(spark, con):
    given = con.execute(oracles.BASE + " SELECT id, carrier_id, CAST(departure_date AS DATE) FROM shipments").fetchall()
    keys = lambda i, carrier, day: (("number", i // 3), ("bill", (i + 1) // 3), ("carrier", carrier, day) if i % 5 else ("none", i))
    used = {k for i, c, d in given if i % 7 == 0 for k in keys(i, c, d)}
    want = []
    for i, carrier, day in sorted((r for r in given if r[0] % 7), key=lambda r: (r[2], r[0])):
        own = keys(i, carrier, day)
        if not used.intersection(own):
            used.update(own)
            want.append(i)
    assert sorted(r["id"] for r in QUERIES["a3_append_under_all_keys"](spark, DIRECTORY).collect()) == sorted(want)


def test_entry(spark):
    first = entry.entry(spark)
    assert first.count() > 0 and "volume_rank" in first.columns


def test_c19_gives_every_shipment_with_both_codes(spark, con):
    """In the binding that is every shipment."""
    found = QUERIES["c19_json_and_codes"](spark, DIRECTORY).filter("test = 'codes'").collect()
    assert sorted(r["id"] for r in found) == sorted(k for (k,) in con.execute(oracles.BASE + " SELECT id FROM shipments").fetchall())
