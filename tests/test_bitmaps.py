import random

import pytest

from tidemark.errors import BitmapCorrupted
from tidemark.functions.periods import Period
from tidemark.operators import bitmaps as B
from tidemark.operators import sets
from tidemark.plans.expr import Ref


def jvm_bytes(spark, ids, runs=False):
    jvm = spark._jvm
    b = jvm.org.roaringbitmap.RoaringBitmap()
    for i in ids:
        b.add(i if i < 2**31 else i - 2**32)
    if runs:
        b.runOptimize()
    out = jvm.java.io.ByteArrayOutputStream()
    b.serialize(jvm.java.io.DataOutputStream(out))
    return bytes(out.toByteArray())


def test_portable_bytes(spark):
    assert B.encode([1, 2, 3, 70000]).hex() == "3a300000020000000000020001000000180000001e0000000100020003007011"
    r = random.Random(1)
    dense = list(range(65536, 65536 + 5000))
    for ids in ([], [0], [2**32 - 1, 0], dense, r.sample(range(200_000), 3000), list(range(65536 * 2))[::3] + [2**31]):
        assert B.encode(ids) == jvm_bytes(spark, ids)
        assert B.decode(B.encode(ids)) == sorted(ids)
    for ids in (dense, list(range(0, 100_000, 7)) + list(range(300_000, 420_000)), [5, 6, 7] + [i * 65536 for i in range(1, 9)] + list(range(700_000, 700_900))):
        raw = jvm_bytes(spark, ids, runs=True)
        assert B.decode(raw) == sorted(ids)
        assert B.contains(raw, ids[0]) and not B.contains(raw, 4_000_000_000)


def test_malformed_bytes():
    raw = B.encode(range(10))
    for bad in (b"", b"1234", raw[:-1], b"\0" * 20, raw[:9]):
        with pytest.raises(BitmapCorrupted):
            B.decode(bad)
        assert not B.contains(bad, 1)


def test_buckets_and_serialised_sets(spark):
    r = random.Random(2)
    rows = [("a", 0), ("a", 32768), ("a", 32769), ("a", 2**32 - 1), *{("b", r.randrange(200_000)) for _ in range(5000)}, ("b", 0), ("b", 32768)]
    facts = spark.createDataFrame(rows, "e string, i long")
    members = sets.membership(facts, facts.e, facts.i)
    buckets = B.build_buckets(members)
    assert sorted(map(tuple, B.bucket_ids(buckets).select("event", "id").collect())) == sorted(set(rows))
    keys = [Ref("a", Period.static()), Ref("b", Period.static())]
    for f in ("union_cardinality_many", "intersect_cardinality_many"):
        assert getattr(B, f)(buckets, keys).first()["n"] == getattr(sets, f)(members, keys).first()["n"]
    assert B.intersect_cardinality_many(buckets, [*keys, Ref("c", Period.static())]).first()["n"] == 0
    packed = {x.event: bytes(x.bytes) for x in B.serialize_portable(members, "event").collect()}
    assert packed["b"] == B.encode(i for e, i in rows if e == "b")
