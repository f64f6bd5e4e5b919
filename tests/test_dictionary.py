"""Numbering of more names than one range holds, by itself and in the queries that rest on it."""

import os

import duckdb
import pytest

from tests.oracle import TABLES, assert_same
from tidemark.operators import dictionary
from tidemark.plans import catalogue

COPIES = 140


def _conf(spark, **values):
    keys = {f"spark.sql.adaptive.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def apart(spark):
    """Partitions of a shuffle stay apart, as large ones do."""
    yield from _conf(spark, coalescePartitions__enabled="false")


@pytest.fixture
def merged(spark):
    """Partitions of a shuffle merge by size, fewer of those with the wider rows."""
    yield from _conf(spark, advisoryPartitionSizeInBytes="200k", coalescePartitions__minPartitionSize="200k")


@pytest.fixture(scope="module")
def customers(small, tmp_path_factory):
    """The small tables with 21,000 customers: copies with shifted keys and names to match."""
    out = tmp_path_factory.mktemp("customers")
    for t in TABLES:
        if t != "customer":
            os.symlink(f"{small}/{t}.parquet", out / f"{t}.parquet")
    duckdb.sql(
        f"COPY (SELECT c_custkey + 150 * k AS c_custkey, printf('Customer#%09d', c_custkey + 150 * k) AS c_name, c_nationkey, c_acctbal, c_mktsegment"
        f" FROM '{small}/customer.parquet', (SELECT unnest(range({COPIES}))::BIGINT AS k) ORDER BY 1) TO '{out}/customer.parquet'"
    )
    return str(out)


def test_numbers_have_no_gaps(spark, apart):
    names = spark.range(30_000, numPartitions=3).selectExpr("id * id AS pos", "concat('n', id) AS ext_id")
    rows = dictionary.numbered(names, 7).collect()
    assert sorted((r.id, r.ext_id) for r in rows) == [(7 + k, f"n{k}") for k in range(30_000)]


def test_names_without_a_place_come_last(spark, apart):
    names = spark.range(1000).selectExpr("CASE WHEN id % 100 > 0 THEN -id END AS pos", "printf('n%03d', id) AS ext_id")
    want = [f"n{k:03d}" for k in range(999, 0, -1) if k % 100] + [f"n{k:03d}" for k in range(0, 1000, 100)]
    assert [r.ext_id for r in dictionary.numbered(names, 0).orderBy("id").collect()] == want
    assert dictionary.numbered(names.where("pos > 0"), 0).count() == 0
    assert [r.id for r in dictionary.numbered(names.where("pos IS NULL"), 5).orderBy("ext_id").collect()] == list(range(5, 15))


def same(spark, customers, name):
    assert_same(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], customers)


def test_store_uuid_lookups(spark, customers, merged):
    same(spark, customers, "store_uuid_lookups")


def test_store_uuids(spark, customers, merged):
    same(spark, customers, "store_uuids")


def test_store_put_remove_ids_range(spark, customers, apart):
    same(spark, customers, "store_put_remove_ids_range")


def test_dict_assign(spark, customers, apart):
    same(spark, customers, "dict_assign")


def test_dict_delete(spark, customers, apart):
    same(spark, customers, "dict_delete")


def test_export_ids(spark, customers, apart):
    same(spark, customers, "export_ids")


def test_get_ids(spark, customers, apart):
    same(spark, customers, "get_ids")


def test_store_lookups(spark, customers, apart):
    same(spark, customers, "store_lookups")
