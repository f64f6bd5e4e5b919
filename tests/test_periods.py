import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import errors as E
from tidemark.functions import periods as P
from tidemark.functions.periods import Period


def test_keys_round_trip_and_order():
    ps = [Period.of_year(2026), Period.of_month(2026, 3), Period.of_day(2026, 3, 31), Period.of_hour(2026, 3, 31, 23), Period.static()]
    assert [p.key for p in ps] == ["2026", "2026-03", "2026-03-31", "2026-03-31T23", "_static"]
    assert [P.parse_period_key(p.key) for p in ps] == ps
    assert sorted(ps) == ps[::-1]  # static, hour, day, month, year
    assert [P.granularity_of(P.granularity_code(g)) for g in P.GRANULARITIES] == list(P.GRANULARITIES)
    for bad in ("", "x", "2026-1", "2026-13", "2026-01-32", "2026-01-01T24", "20260101"):
        with pytest.raises(E.InvalidPeriod):
            P.parse_period_key(bad)
    assert P.parse_period_key("2026-02-31").day == 31  # only 1 to 31 is checked here


@pytest.mark.parametrize("p", [Period.of_day(2026, 13, 40), Period.of_day(2026, 2, 29), Period.of_day(2026, 2, 0), Period.of_hour(2026, 1, 1, 24), Period.of_month(2026, 0), Period.of_year(0), Period.of_year(10000)])
def test_validation(p):
    with pytest.raises(E.InvalidPeriod):
        p.validate()


def test_leap_days_parents_and_boundaries():
    assert Period.of_day(2024, 2, 29).validate().next() == Period.of_day(2024, 3, 1)
    assert list(Period.of_hour(2026, 1, 31, 22).ancestors()) == [Period.of_day(2026, 1, 31), Period.of_month(2026, 1), Period.of_year(2026)]
    assert Period.static().parent() is None and list(Period.of_year(2026).ancestors()) == []
    end = int(datetime(2026, 4, 1, tzinfo=UTC).timestamp())
    assert Period.of_month(2026, 3).close_boundary() == end
    assert not Period.of_month(2026, 3).is_closed(end - 1) and Period.of_month(2026, 3).is_closed(end)
    assert not Period.static().is_closed(2**40) and Period.of_year(1960).is_closed(0)
    assert Period.of_year(9999).next() is None and Period.of_year(9999).close_boundary() > 0


def test_ranges():
    days = P.enumerate_periods(Period.of_day(2026, 3, 28), Period.of_day(2026, 4, 3))
    assert len(days) == 7 and days[3].key == "2026-03-31"
    hours = P.enumerate_periods(Period.of_hour(2026, 1, 31, 22), Period.of_hour(2026, 2, 1, 1))
    assert [p.key for p in hours][-2:] == ["2026-02-01T00", "2026-02-01T01"]
    assert P.enumerate_periods(days[1], days[0]) == [] == P.enumerate_periods(Period.of_day(2026, 1, 1), Period.of_month(2026, 2))
    assert P.enumerate_periods(Period.static(), Period.static()) == [Period.static()]
    with pytest.raises(E.InvalidPeriod):
        P.checked_read_range(Period.of_hour(2025, 1, 1, 0), Period.of_hour(2026, 6, 1, 0))
    assert len(P.checked_read_range(Period.of_hour(2024, 1, 1, 0), Period.of_hour(2024, 12, 31, 23))) == P.MAX_RANGE
    for first, last in ((Period.static(), Period.static()), (days[1], days[0]), (Period.of_day(2026, 2, 28), Period.of_day(2026, 2, 30)), (Period.of_day(2000, 1, 1), Period.of_day(2026, 1, 1))):
        with pytest.raises(E.InvalidPeriod):
            P.checked_write_range(first, last, "day")
    with pytest.raises(E.GranularityMismatch):
        P.checked_write_range(hours[0], hours[1], "day")


def test_names():
    for good in ("a", "A-b_c:d.e", "..."):
        assert P.check_event_name(good) == good
    for bad in ("", ".", "..", "a b", "a/b", "é"):
        with pytest.raises(E.InvalidEventName):
            P.check_event_name(bad)


def test_columns_mirror_values(spark):
    r = random.Random(4)
    moments = [datetime(1990, 1, 1, tzinfo=UTC) + timedelta(hours=r.randrange(500_000)) for _ in range(60)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(moments)], "i int, ts timestamp")
    every = F.array(*[P.period_struct(F.col("ts"), g) for g in P.GRANULARITIES])
    now = int(moments[0].timestamp())
    rows = df.select("i", F.inline(every)).select("i", "gran", "period_key", P.closed(F.col("period_start"), F.col("gran"), F.timestamp_seconds(F.lit(now))).alias("closed"), P.rank_of(F.col("gran")).alias("rank"), P.valid_key(F.col("period_key")).alias("valid")).collect()
    for x in rows:
        p = Period.at(x.gran, moments[x.i])
        assert (x.period_key, x.closed, x.rank, x.valid) == (p.key, p.is_closed(now), p.rank, True)


def test_interval_counts_of_whole_intervals(spark):
    from tidemark.operators import oplog, sets
    from tidemark.plans import catalogue

    r, start = random.Random(4), datetime(1995, 1, 1)
    rows = []
    for i in range(120):
        a = start + timedelta(days=r.randrange(2400), hours=r.randrange(24))
        rows.append((r.choice("xy"), r.randrange(12), a, a + timedelta(days=r.choice((-1, 0, 1, 30, 41, 400, 2478)), hours=r.randrange(24))))
    want = {}
    for event, i, a, b in rows:
        day = a.replace(hour=0)
        while day <= b:
            for gran, form in (("day", "%Y-%m-%d"), ("month", "%Y-%m"), ("year", "%Y")):
                want.setdefault((event, gran, day.strftime(form)), set()).add(i)
            day += timedelta(days=1)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.createDataFrame([(e, i, f"{a}", f"{b}") for e, i, a, b in rows], "event string, id long, a string, b string")
    df = df.withColumns({c: F.to_timestamp(c) for c in "ab"})
    counts = oplog.interval_counts(df, F.col("a"), F.col("b"), "day", "auto")
    assert {(x.event, x.gran, x.period_key): x.n for x in counts.collect()} == {k: len(v) for k, v in want.items()}
    buckets = oplog.interval_buckets(df, F.col("a"), F.col("b"), "day", "auto").select("event", "gran", "period_start", "period_key", "id").distinct()
    assert sorted(counts.collect()) == sorted(sets.cardinality(buckets).select("event", "gran", "period_key", "n").collect())
    assert "range_put_rollup" in catalogue.queries()
