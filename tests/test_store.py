"""The store against small cases and a plain model of sets."""

import random
import uuid

import pytest

from tidemark import errors as E
from tidemark.functions.periods import Period
from tidemark.plans.expr import Ref
from tidemark.sources.store import Store

H = [Period.of_hour(2026, 3, 20, h) for h in range(24)]
DAY, MONTH, YEAR = H[0].ancestors()
S = Period.static()


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


def hourly(spark, path, **options):
    return Store(spark, path, default_granularity="hour", default_rollup="auto", **options)


def ids(df):
    return {r["id"] for r in df.collect()}


def state(store):
    return {(r.event, r.gran, r.period_key, r.id) for r in store.members().collect()}


def test_order_of_operations_and_rollup(spark, path):
    with hourly(spark, path) as s:
        s.put("e", H[10], [42, 7])
        s.put("e", H[11], [42])
        s.put("e", H[12], [42, 7])
        s.remove("e", H[10], [42])
        s.remove("e", H[11], [42])
        assert ids(s.get("e", H[12])) == {7, 42} and ids(s.get("e", DAY)) == {7}  # erased from the day even so
        s.flush()
        s.put("e", H[14], [42])
        assert ids(s.get("e", H[10])) == {7} and all(42 in ids(s.get("e", p)) for p in (H[14], DAY, MONTH, YEAR))
        s.replace("e", H[14], [99])
        assert ids(s.get("e", H[14])) == {99} and ids(s.get("e", DAY)) == {7, 42}
        s.delete_period("e", DAY)
        assert ids(s.get("e", DAY)) == set() and ids(s.get("e", H[14])) == {99}
        before = state(s)
        stats = s.compact()
        assert stats.periods_compacted > 0 and stats.deltas_applied > 0 and state(s) == before
        assert s.compact().periods_compacted == 0
        assert s.cardinality("e", MONTH) == 2
    again = hourly(spark, path)
    assert state(again) == before and again.health().total_events == 1
    s.close()
    with pytest.raises(E.Closed):
        s.get("e", DAY)


def test_static_range_reads_and_errors(spark, path):
    s = Store(spark, path)
    s.put("premium", S, [1, 2])
    s.replace("premium", S, [99])
    assert ids(s.get("premium", S)) == {99} and s.list_periods("premium") == [S]
    first, last = Period.of_day(2026, 3, 28), Period.of_day(2026, 4, 3)
    s.put_range("stay", first, last, [5, 6])
    s.remove_range("stay", Period.of_day(2026, 3, 30), Period.of_day(2026, 3, 31), [5])
    got = {r.period_key: r.n for r in s.cardinality_range("stay", Period.of_day(2026, 3, 20), Period.of_day(2026, 4, 9)).collect()}
    assert len(got) == 7 and got["2026-03-30"] == 1 and got["2026-04-03"] == 2
    assert s.get_range("stay", last, first).count() == 0
    assert s.intersect_cardinality_many([Ref("stay", first), Ref("stay", last)]) == 2 and s.union_cardinality_many([]) == 0
    assert ids(s.query(Ref("stay", first) - Ref("stay", Period.of_day(2026, 3, 30)))) == set(ids(s.get("stay", first))) - {6}
    assert s.query_cardinality(Ref("stay", first) | Ref("premium", S)) == 3
    assert s.contains_batch("stay", first, [6, 7, 5, 6]) == [True, False, True, True]
    assert not s.exists("stay", Period.of_day(2026, 3, 27))
    for call, error in (
        (lambda: s.put("stay", Period.of_month(2026, 3), [1]), E.GranularityMismatch),
        (lambda: s.put("stay", Period.of_day(2026, 2, 29), [1]), E.InvalidPeriod),
        (lambda: s.put_range("stay", last, first, []), E.InvalidPeriod),
        (lambda: s.put("a b", first, [1]), E.InvalidEventName),
        (lambda: s.put("stay", first, [2**32]), E.Configuration),
        (lambda: s.register_event("stay", "day"), E.EventAlreadyRegistered),
        (lambda: Store(spark, path + "2", index_freshness="immediate"), E.Configuration),
    ):
        with pytest.raises(error):
            call()
    s.put("stay", first, [])
    s.flush()
    reader = Store(spark, path, read_only=True)
    assert ids(reader.get("stay", first)) == {5, 6}
    with pytest.raises(E.ReadOnly):
        reader.put("stay", first, [1])
    assert s.retain_periods("stay", lambda p: p >= Period.of_day(2026, 4, 1)) == 4
    assert [p.key for p in s.list_periods("stay")] == ["2026-04-01", "2026-04-02", "2026-04-03"]
    s.drop_event("stay")
    assert [e.name for e in s.list_events()] == ["premium"] and s.list_periods("stay") == []
    with pytest.raises(E.Configuration):
        Store(spark, path, max_events=1).put("more", first, [1])
    s.files.write("_manifest.json", "garbage")
    with pytest.raises(E.CatalogCorrupted):
        Store(spark, path)


def test_dictionary_and_entities(spark, path):
    s = hourly(spark, path)
    assert s.assign(["x", "y", "x", "z"]) == [0, 1, 0, 2] and s.assign(["z", "ü"]) == [2, 3]
    assert s.lookup_batch(["ü", "no", "x"]) == [3, None, 0] and s.resolve_batch([1, 9]) == ["y", None]
    with pytest.raises(E.Configuration):
        s.assign(["", "q"])
    with pytest.raises(E.InvalidPeriod):
        s.put_ids("e", Period.of_hour(2026, 2, 30, 1), ["new"])
    assert s.lookup("new") is None  # a failed call uses no id
    s.put_ids("e", H[3], ["x", "y"])
    s.put_ids_range("f", H[4], H[5], ["y", "w"])
    s.remove_ids("e", H[3], ["unknown", "y"])
    assert {r.ext_id for r in s.get_ids("e", H[3]).collect()} == {"x"} and s.contains_ids_batch("f", H[4], ["w", "x", "?"]) == [True, False, False]
    assert [(r.event, r.gran) for r in s.find_memberships("x").collect()] == [("e", "hour"), ("e", "day"), ("e", "month"), ("e", "year")]
    assert [len(r.memberships) for r in s.find_memberships_batch(["w", "?", "x"]).collect()] == [5, 0, 4]
    assert s.delete_entity("w") == 5 and s.lookup("w") is None and s.delete_entity("w") == 0
    assert {r.ext_id for r in s.get_ids("f", H[4]).collect()} == {"y"}
    s.put_ids("f", H[4], ["w"])
    assert s.lookup("w") == 5 and s.resolve(4) is None and s.dictionary_len() == 5
    u = uuid.uuid4()
    s.put_uuids("u", H[0], [str(u).upper()])
    assert [r.ext_id for r in s.get_uuids("u", H[0]).collect()] == [str(u)] and s.contains_uuid("u", DAY.__class__.of_hour(2026, 3, 20, 0), u)
    assert [r.ext_id for r in s.export_ids(s.get("f", H[4])).collect()] == ["w", "y"]
    assert s.query_serialize(Ref("f", H[4])) == s.serialize_portable(s.get("f", H[4]))


def test_random_histories_follow_a_model_of_sets(spark, path):
    r = random.Random(11)
    s, model = hourly(spark, path), {}
    up = lambda p: [p, *p.ancestors()]
    for step in range(28):
        kind, p, own = r.choice("ppprrRdfc"), r.choice(H[:4]), set(r.sample(range(12), r.randrange(1, 5)))
        if kind == "p":
            s.put("e", p, own)
            for q in up(p):
                model[q] = model.get(q, set()) | own
        elif kind == "r":
            p = r.choice([p, DAY])
            s.remove("e", p, own)
            for q in up(p):
                model[q] = model.get(q, set()) - own
        elif kind == "R":
            s.replace("e", p, own)
            model[p] = set(own)
        elif kind == "d":
            s.delete_period("e", p)
            model[p] = set()
        elif kind == "f":
            s.flush()
        else:
            s.compact()
        if step % 9 == 8:
            want = {("e", q.gran, q.key, i) for q, x in model.items() for i in x}
            assert state(s) == want, step
    s.close()
    assert state(hourly(spark, path)) == {("e", q.gran, q.key, i) for q, x in model.items() for i in x}


def test_unnamed_directories_go_and_an_unfinished_write_is_unseen(spark, path):
    s = hourly(spark, path)
    s.put("e", H[0], [1])
    s.flush()
    spark.range(3).write.parquet(f"{path}/data/lost")
    again = hourly(spark, path)
    assert "lost" not in again.files.names("data") and ids(again.get("e", H[0])) == {1}


def test_ingest_replays_nothing_and_keeps_late_facts(spark, path, tmp_path):
    from datetime import UTC, datetime

    from tidemark.streaming.ingest import start_ingest, write_batch

    at = lambda h: datetime(2026, 3, 20, h, 30, tzinfo=UTC)
    schema = "event string, ts timestamp, id long, op string"
    spark.createDataFrame([("e", at(5), 1, "put"), ("e", at(5), 2, "put"), ("f", at(1), 3, "put"), ("f", None, 3, "put")], schema).write.parquet(str(tmp_path / "in/a"))
    spark.createDataFrame([("e", at(2), 9, "put"), ("e", at(5), 2, "remove")], schema).write.parquet(str(tmp_path / "in/b"))
    s = hourly(spark, path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    start_ingest(stream, s, "test", str(tmp_path / "cp")).awaitTermination()
    assert ids(s.get("e", DAY)) == {1, 9} and ids(s.get("f", H[1])) == {3}
    before = s.manifest["next_seq"]
    assert not write_batch(s, "test", spark.read.parquet(str(tmp_path / "in/a")), 0) and s.manifest["next_seq"] == before


def test_a_batch_whose_commit_fails_is_taken_again(spark, path, monkeypatch):
    from datetime import UTC, datetime

    from tidemark.sources.files import Files
    from tidemark.streaming.ingest import write_batch

    facts = spark.createDataFrame([("e", datetime(2026, 3, 20, 5, tzinfo=UTC), 1, "put")], "event string, ts timestamp, id long, op string")
    s = hourly(spark, path)
    s.register_event("e", "hour", "auto")
    write, failing = Files.write, [True]

    def broken(self, name, text):
        if failing:
            raise OSError("no space")
        write(self, name, text)

    monkeypatch.setattr(Files, "write", broken)
    before = (s.manifest["next_seq"], len(s.pending))
    with pytest.raises(E.CatalogError):
        write_batch(s, "in", facts, 0)
    assert (s.manifest["next_seq"], len(s.pending)) == before and not s.manifest["batches"]
    failing.clear()
    assert write_batch(s, "in", facts, 0) and not write_batch(s, "in", facts, 0)
    assert ids(Store(spark, path, read_only=True).get("e", H[5])) == {1}


def test_readers_go_on_after_a_compaction_until_the_retention_ends(spark, path):
    now = [1_000_000.0]
    s = hourly(spark, path, clock=lambda: now[0], retention=60.0)
    for k in (1, 2):
        s.put("e", H[0], [k])
        s.flush()
    reader = Store(spark, path, read_only=True)
    view = reader.get("e", H[0])
    assert s.compact().periods_compacted == 4 and len(s.files.names("ops")) == 3
    Store(spark, path, clock=lambda: now[0], retention=60.0)  # another opening for writing
    assert ids(view) == {1, 2} and ids(reader.get("e", DAY)) == {1, 2}
    now[0] += 61
    s.vacuum()
    assert len(s.files.names("ops")) == 1 and ids(s.get("e", H[0])) == {1, 2}


def test_compaction_of_one_event_leaves_other_files_alone(spark, path):
    s = hourly(spark, path)
    for k in range(3):
        for event in ("a:b", "2026", "c"):
            s.put(event, H[k % 2], [k, 100 + k])
        s.remove("2026", H[0], [0])
        s.flush()
    before, old = state(s), set(s.manifest["ops"])
    assert s.compact_event("a:b").periods_compacted > 0
    (new,) = set(s.manifest["ops"]) - old
    assert s._events_in(new) == {"a:b"} and old <= set(s.manifest["ops"]) and state(s) == before
    s.put("a:b", H[3], [7])
    s.compact()
    assert not old & set(s.manifest["ops"]) and state(s) == before | {("a:b", p.gran, p.key, 7) for p in (H[3], DAY, MONTH, YEAR)}
    assert len(s.manifest["barriers"]) == 3 and s.cardinality("2026", YEAR) == 5
    s.drop_event("c")
    plan = s.get("2026", H[0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event" in plan
    assert state(s) == {x for x in state(hourly(spark, path)) if x[0] != "c"}


def test_long_lists_are_no_literals(spark, path):
    s = Store(spark, path)
    s.put("e", S, range(30_000))
    assert "LocalTableScan" in s.get("e", S)._jdf.queryExecution().toString() or len(s.get("e", S)._jdf.queryExecution().toString()) < 100_000
    s.put_ids("n", S, [f"u{i}" for i in range(12_000)])
    assert s.cardinality("e", S) == 30_000 and s.get("n", S).count() == 12_000


def test_dictionary_alone_shares_ids_with_the_store(spark, path):
    from tidemark.sources.dictionary_store import Dictionary

    d = Dictionary(spark, path)
    assert d.is_empty() and d.get_or_assign_batch(["a", "b"]) == [0, 1] and d.get_or_assign("b") == 1
    u = uuid.uuid4()
    assert d.get_or_assign_uuid(str(u).upper()) == 2 and d.lookup_uuid(u) == 2 and d.resolve_uuid(2) == u and d.resolve_uuid(0) is None
    assert d.delete("a") == 0 and d.delete("a") is None and not d.contains("a") and len(d) == 2
    assert d.resolved_pairs([0, 1, 9]) == {1: "b"}
    d.close()
    s = hourly(spark, path)
    s.put_ids("e", H[0], ["a", "b"])
    assert ids(s.get("e", H[0])) == {1, 3}
    s.pin()
    assert ids(s.get("e", H[0])) == {1, 3}
    s.put("e", H[0], [8])
    assert ids(s.get("e", H[0])) == {1, 3, 8}
    s.unpin()


def test_store_queries_meet_every_event(spark, small):
    from tidemark.plans import catalogue

    whole, got = spark.read.parquet(f"{small}/events.parquet"), catalogue.queries()["store_ingest"](spark, small)
    want = {tuple(r) for r in whole.selectExpr("event_type", "date_format(ts, \"yyyy-MM-dd'T'HH\")", "user_id").collect()}
    assert {(r.event, r.period_key, r.id) for r in got.where("gran = 'hour'").collect()} == want
    assert len({e for e, *_ in want}) == 5 and len({k[:10] for _, k, _ in want}) > 3
