from datetime import date

import duckdb
import pytest

from orderlens.llm import queries, url_filter
from tests.llm.helpers import collected

FOLDER = "/root/testdata/sf0.01"


def day(n):
    return date(2024, 1, n)


@pytest.fixture
def changes(spark):
    rows = [
        ("bad", "host evil.com", "add", day(5)), ("bad", "host evil.com", "remove", day(10)),
        ("bad", "host evil.com", "add", day(20)), ("bad", "host evil.com", "add", day(22)),
        ("spam", "path shop.org/a/b", "add", day(3)), ("spam", "address shop.org/x", "add", day(3)),
        ("spam", "address shop.org/x", "remove", day(3)), ("bad", "host never.com", "remove", day(1)),
        (None, "host evil.com", "add", day(1)), ("bad", None, "add", day(1)), ("bad", "host a.com", "?", day(1)),
        ("bad", "host a.com", "add", None), ("bad", "host evil.com", "remove", day(5)),
    ]
    return spark.createDataFrame(rows, "list string, key string, action string, day date")


def test_intervals(changes):
    found = collected(url_filter.validity_intervals(changes), "list", "key", "valid_from")
    assert found == [
        ("bad", "host evil.com", day(5)), ("bad", "host evil.com", day(20)),
        ("spam", "address shop.org/x", day(3)), ("spam", "path shop.org/a/b", day(3)),
    ]
    ends = {r.valid_from: r.valid_to for r in url_filter.validity_intervals(changes).collect()}
    assert ends[day(5)] == day(10) and ends[day(20)] is None


def test_captures(spark, changes):
    cases = [
        ("http://evil.com/", day(4), 0, "evil.com"), ("http://evil.com/", day(5), 1, "evil.com"),
        ("HTTPS://User:pw@WWW.Evil.com.:8080/p?q#f", day(9), 1, "www.evil.com"),
        ("http://evil.com", day(10), 0, "evil.com"), ("http://notevil.com", day(25), 0, "notevil.com"),
        ("http://evil.com", day(31), 1, "evil.com"), ("http://shop.org/a/b/c", day(3), 1, "shop.org"),
        ("http://shop.org//a/bc", day(4), 0, "shop.org"), ("http://shop.org/x?y", day(4), 1, "shop.org"),
        ("http://shop.org/x/y", day(4), 0, "shop.org"), (None, day(4), 0, None), ("", day(4), 0, None),
        ("no address", day(4), 0, None), ("http:///p", day(4), 0, None), ("http://evil.com", None, 0, "evil.com"),
        ("http://com/", day(6), 0, "com"), ("http://evil.com/", day(5), 1, "evil.com"),
    ]
    rows = [(i, url, when, "x", "y") for i, (url, when, _, _) in enumerate(cases)]
    captures = spark.createDataFrame(rows, "id int, url string, fetched date, host string, path string")
    found = url_filter.filter_urls(captures, changes)
    expected = [(i, n, n == 0, host) for i, (_, _, n, host) in enumerate(cases)]
    got = [(r.row.id, r.n_entries, r.kept, r.host) for r in found.collect()]
    assert sorted(got, key=lambda x: x[0]) == expected
    assert "Python" not in found._jdf.queryExecution().toString()
    assert url_filter.filter_urls(captures.limit(0), changes).count() == 0
    assert url_filter.filter_urls(captures, changes.limit(0)).where("kept").count() == len(cases)


def test_two_lists(spark):
    changes = spark.createDataFrame(
        [(name, key, "add", day(1)) for name in ("b", "a") for key in ("host x.com", "host y.x.com")],
        "list string, key string, action string, day date")
    captures = spark.createDataFrame([("http://y.x.com/", day(2))], "url string, fetched date")
    row = url_filter.filter_urls(captures, changes).first()
    assert (row.n_entries, row.lists, row.kept) == (4, "a,b", False)


def test_registered_query_against_sql(spark):
    found = queries.QUERIES["op1_url_filters"](spark, FOLDER)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    cursor = connection.execute(queries.ORACLES["op1_url_filters"])
    columns = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    key = repr
    assert sorted((tuple(r) for r in found.select(columns).collect()), key=key) == sorted(cursor.fetchall(), key=key)
    assert found.where("NOT kept").count() > 10
