"""Time buckets: a Python value for the driver, and the same rules as Column expressions for data.

Calendar arithmetic is UTC and proleptic Gregorian, for years 1 to 9999 (the range of Spark timestamps).
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import InvalidEventName, InvalidPeriod

#: Granularities from none (static sets) to the coarsest; a granularity's place is its code.
GRANULARITIES = ("none", "hour", "day", "month", "year")
RANK = {g: i for i, g in enumerate(GRANULARITIES)}
#: Life-cycle states of a period; a state's place is its code.
STATES = ("open", "closed", "compacted", "dropped")
ROLLUPS = ("auto", "none")
STATIC_KEY = "_static"
#: The longest interval, in buckets, that one range call takes: a leap year of hours.
MAX_RANGE = 8784

FORMATS = {"hour": "yyyy-MM-dd'T'HH", "day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def granularity_code(gran: str) -> int:
    return RANK[gran]


def granularity_of(code: int) -> str:
    if not 0 <= code < len(GRANULARITIES):
        raise InvalidPeriod(f"no granularity has the code {code}")
    return GRANULARITIES[code]


def rollup_chain(finest: str) -> tuple[str, ...]:
    """The finest granularity and all coarser ones; a static event has none."""
    return () if finest == "none" else GRANULARITIES[RANK[finest] :]


def check_event_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_:.\-]+", name or "") or name in (".", ".."):
        raise InvalidEventName(f"invalid event name {name!r}")
    return name


@dataclass(frozen=True, order=True)
class Period:
    """A bucket of time, ordered by granularity first and then by time."""

    rank: int
    year: int = 0
    month: int = 0
    day: int = 0
    hour: int = 0

    @classmethod
    def static(cls) -> Period:
        return cls(0)

    @classmethod
    def of_hour(cls, year: int, month: int, day: int, hour: int) -> Period:
        return cls(1, year, month, day, hour)

    @classmethod
    def of_day(cls, year: int, month: int, day: int) -> Period:
        return cls(2, year, month, day)

    @classmethod
    def of_month(cls, year: int, month: int) -> Period:
        return cls(3, year, month)

    @classmethod
    def of_year(cls, year: int) -> Period:
        return cls(4, year)

    @classmethod
    def at(cls, gran: str, moment: datetime) -> Period:
        """The bucket of a granularity that holds a moment."""
        parts = (moment.year, moment.month, moment.day, moment.hour)
        return cls(RANK[gran], *parts[: 5 - RANK[gran]]) if gran != "none" else cls.static()

    @property
    def gran(self) -> str:
        return GRANULARITIES[self.rank]

    @property
    def key(self) -> str:
        return {
            "none": STATIC_KEY,
            "hour": f"{self.year:04}-{self.month:02}-{self.day:02}T{self.hour:02}",
            "day": f"{self.year:04}-{self.month:02}-{self.day:02}",
            "month": f"{self.year:04}-{self.month:02}",
            "year": f"{self.year:04}",
        }[self.gran]

    def validate(self) -> Period:
        if self.rank == 0:
            return self
        if not 1 <= self.year <= 9999:
            raise InvalidPeriod(f"{self.key}: year out of range")
        if self.rank <= 3 and not 1 <= self.month <= 12:
            raise InvalidPeriod(f"{self.key}: month out of range")
        if self.rank <= 2 and not 1 <= self.day <= days_in_month(self.year, self.month):
            raise InvalidPeriod(f"{self.key}: day out of range")
        if self.rank == 1 and not 0 <= self.hour <= 23:
            raise InvalidPeriod(f"{self.key}: hour out of range")
        return self

    @property
    def start(self) -> datetime | None:
        """The first moment; none for a static period."""
        if self.rank == 0:
            return None
        self.validate()
        return datetime(self.year, self.month or 1, self.day or 1, self.hour, tzinfo=UTC)

    def next(self) -> Period | None:
        """The following period of the same granularity; none for a static one, or after the last year."""
        if self.rank == 0:
            return None
        try:
            return Period.at(self.gran, _step(self.start, self.gran))
        except (OverflowError, ValueError):
            return None

    def parent(self) -> Period | None:
        if self.rank in (0, 4):
            return None
        return Period.at(GRANULARITIES[self.rank + 1], self.start)

    def ancestors(self) -> Iterator[Period]:
        p = self.parent()
        while p is not None:
            yield p
            p = p.parent()

    def close_boundary(self) -> int | None:
        """Seconds since 1970 of the first moment after the period; none for a static one."""
        if self.rank == 0:
            return None
        after = self.next()
        return int(after.start.timestamp()) if after else int(datetime(9999, 12, 31, 23, tzinfo=UTC).timestamp()) + 3600

    def is_closed(self, now: int) -> bool:
        """Has the period ended by ``now`` (seconds since 1970)? A static one never does, one before 1970 always."""
        end = self.close_boundary()
        return end is not None and (end <= 0 or now >= end)


def days_in_month(year: int, month: int) -> int:
    return calendar.monthrange(year, month)[1]


def _step(moment: datetime, gran: str) -> datetime:
    if gran == "hour":
        return moment + timedelta(hours=1)
    if gran == "day":
        return moment + timedelta(days=1)
    if gran == "month":
        return moment.replace(year=moment.year + moment.month // 12, month=moment.month % 12 + 1)
    return moment.replace(year=moment.year + 1)


_KEYS = {4: "year", 7: "month", 10: "day", 13: "hour"}


def parse_period_key(key: str) -> Period:
    """The period that a key names. As in the stored form, a day is only checked to be 1 to 31."""
    if key == STATIC_KEY:
        return Period.static()
    m = re.fullmatch(r"([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2})(?:T([0-9]{2}))?)?)?", key)
    if not m or len(key) not in _KEYS:
        raise InvalidPeriod(f"no period key: {key!r}")
    year, month, day, hour = (int(x) if x else None for x in m.groups())
    if (month is not None and not 1 <= month <= 12) or (day is not None and not 1 <= day <= 31) or (hour is not None and hour > 23):
        raise InvalidPeriod(f"no period key: {key!r}")
    return Period(RANK[_KEYS[len(key)]], *(x for x in (year, month, day, hour) if x is not None))


def enumerate_periods(first: Period, last: Period, most: int | None = None) -> list[Period]:
    """All periods from first to last; none where granularities differ or the order is reversed."""
    if first.rank != last.rank or first > last:
        return []
    if first.rank == 0:
        return [first]
    first.validate()
    last.validate()
    out, p = [], first
    while p is not None and p <= last:
        out.append(p)
        if most is not None and len(out) > most:
            raise InvalidPeriod(f"{first.key} to {last.key}: more than {most} periods")
        p = p.next()
    return out


def checked_write_range(first: Period, last: Period, finest: str) -> list[Period]:
    """The buckets of an interval to write; anything odd is an error."""
    for p in (first, last):
        if p.rank == 0:
            raise InvalidPeriod("a range of periods can't be static")
        p.validate()
        if p.gran != finest:
            from tidemark.errors import GranularityMismatch

            raise GranularityMismatch(f"{p.key} is no {finest} period")
    if first > last:
        raise InvalidPeriod(f"{first.key} is after {last.key}")
    return enumerate_periods(first, last, MAX_RANGE)


def checked_read_range(first: Period, last: Period) -> list[Period]:
    """The buckets of an interval to read; reversed or mixed bounds give none, invalid or too many are errors."""
    first.validate()
    last.validate()
    return enumerate_periods(first, last, MAX_RANGE)


# Column expressions


def key_of(start: Column, gran: str) -> Column:
    """The period key of a bucket's start."""
    return F.lit(STATIC_KEY) if gran == "none" else F.date_format(start, FORMATS[gran])


def start_of(ts: Column, gran: str) -> Column:
    """The start of the bucket that holds a moment; null for static ones."""
    return F.lit(None).cast("timestamp") if gran == "none" else F.date_trunc(gran, ts)


def period_struct(ts: Column, gran: str) -> Column:
    """Granularity, start and key of a moment's bucket."""
    start = start_of(ts, gran)
    return F.struct(F.lit(gran).alias("gran"), start.alias("period_start"), key_of(start, gran).alias("period_key"))


def levels(ts: Column, finest: str, rollup: str) -> Column:
    """The buckets that a write at a moment reaches: its own and, with rollup, all coarser ones."""
    chain = rollup_chain(finest) if rollup == "auto" and finest != "none" else (finest,)
    return F.array(*[period_struct(ts, g) for g in chain])


def rank_of(gran: Column) -> Column:
    """Granularities in order of period sorting."""
    return F.array_position(F.array(*[F.lit(g) for g in GRANULARITIES]), gran).cast("int") - 1


def end_of(start: Column, gran: Column) -> Column:
    """The first moment after a bucket; null for static ones."""
    step = F.when(gran == "hour", F.expr("INTERVAL 1 HOUR")).when(gran == "day", F.expr("INTERVAL 1 DAY"))
    return F.when(gran.isin("hour", "day"), F.try_add(start, step)).when(gran == "month", F.add_months(start, 1).cast("timestamp")).when(gran == "year", F.add_months(start, 12).cast("timestamp"))


def closed(start: Column, gran: Column, now: Column) -> Column:
    """Has a bucket ended by ``now``? Static ones never do."""
    return F.coalesce(now >= end_of(start, gran), F.lit(False))


def valid_key(key: Column) -> Column:
    """Does a key name a bucket that exists on the calendar?"""
    padded = F.when(F.length(key) == 4, F.concat(key, F.lit("-01-01T00"))).when(F.length(key) == 7, F.concat(key, F.lit("-01T00"))).when(F.length(key) == 10, F.concat(key, F.lit("T00"))).otherwise(key)
    shape = key.rlike(r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2}(T[0-9]{2})?)?)?$")
    return (key == STATIC_KEY) | (shape & F.try_to_timestamp(padded, F.lit("yyyy-MM-dd'T'HH")).isNotNull())


def buckets_between(first: Column, last: Column, gran: str) -> Column:
    """Starts of all buckets that an interval [first, last] touches; none where it is reversed."""
    a, b = F.date_trunc(gran, first), F.date_trunc(gran, last)
    steps = F.sequence(a, F.greatest(a, b), F.expr(f"INTERVAL 1 {gran.upper()}"))
    return F.when(a <= b, steps).otherwise(F.array().cast("array<timestamp>"))
