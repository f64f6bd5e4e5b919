import random
from collections import Counter

import pytest

from tests.oracle import assert_same
from tidemark.llm import mixing, q_mixing


def test_query_equals_sql(spark, small):
    assert_same(spark, q_mixing.op8_mixing, q_mixing.ORACLE_SQL["op8_mixing"], small)


def test_deviation_is_below_one_block():
    r = random.Random(2)
    for shares in ({"a": 50, **{f"s{i}": 1 for i in range(50)}}, {"a": 1}, *({f"s{i}": r.randrange(1, 60) for i in range(r.randrange(2, 12))} for _ in range(20))):
        total, done = sum(shares.values()), Counter()
        order = mixing.schedule(shares)
        for t, s in enumerate(order, 1):
            done[s] += 1
            assert all(abs(done[x] - t * n / total) < 1 for x, n in shares.items())
        assert done == Counter(shares)


def test_mixture_of_documents(spark):
    rows = [(i, "big" if i % 3 else "small", i) for i in range(300)] + [(None, None, 0), (7, None, 0), (7, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, in_mix int")
    got = mixing.mix(df, {"big": 2, "small": 1}, block=4).orderBy("mix_slot", "mix_order").collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(r[:2] for r in rows)
    assert len({(r.mix_slot, r.mix_order) for r in got}) == len(rows)
    per_slot = Counter((r.mix_slot, r.source) for r in got)
    assert len({s for s, _ in per_slot}) == len(per_slot) and max(per_slot.values()) == 4
    assert all(per_slot[s, x] == 4 for s, x in per_slot if s < max((r.mix_slot for r in got if r.in_mix), default=-1))
    assert mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, max_sources=2)
    with pytest.raises(ValueError):
        mixing.mix(df, {"big": 10_000_000})


def test_many_sources_odd_ids_and_clashing_names(spark, monkeypatch):
    import time

    shares, t = {f"s{i}": 1 + i % 100 for i in range(2000)}, time.time()
    assert Counter(mixing.schedule(shares)) == Counter(shares) and time.time() - t < 5
    monkeypatch.setattr(mixing, "_BUCKET", 5)
    monkeypatch.setattr(mixing, "_BROADCAST", 0)
    rows = [(1024 * i, "a", "x", i, None) for i in range(400)] + [(None, "a", "y", i, "z" * 100_000) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, key string, place int, text string")
    got = mixing.mix(df, {"a": 3}).collect()
    assert sorted(r.mix_slot * 16 + r.mix_order for r in got) == list(range(450))
    assert Counter((r.doc_id, r.key, r.place) for r in got) == Counter((r[0], r[2], r[3]) for r in rows)
    buckets = mixing.places(df.select(mixing.F.struct("*").alias("row"), "source", "doc_id"), 450)
    assert buckets.count() == 450
