"""Stateless reads, counts and reverse lookups over a membership table.

``members`` has the columns event, gran, period_start, period_key, id, each row a distinct fact, as
``oplog.fold`` and ``membership`` give it. Every operator is a plan of built-in functions; keys of a call are
literals, so they prune partitions and row groups.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import periods as P
from tidemark.functions.periods import Period
from tidemark.plans.expr import And, Or, Ref, SetExpr, evaluate, is_ref, one_of

KEY = ["event", "gran", "period_start", "period_key"]
MAX_ID = 4_294_967_295


def membership(facts: DataFrame, event: Column, id: Column, ts: Column | None = None, gran: str = "none", rollup: str = "none", only: list[Ref] | None = None, repeats: bool = False) -> DataFrame:
    """Membership rows of a table of facts; ids outside 0..2**32-1 and null events, ids or times are left out.

    ``only``: the sets that a query refers to. Their events and the time from the first to the last of their
    periods become conditions on the facts themselves, which a scan can prune by. ``repeats`` leaves facts of a
    set repeated and saves a shuffle, for operators that don't count rows: expressions, unions, bitmaps.
    """
    rows = facts.select(event.alias("event"), (F.lit(None).cast("timestamp") if ts is None else ts).alias("ts"), id.cast("long").alias("id"))
    if only:
        rows = rows.where(F.col("event").isin(sorted({r.event for r in only})))
        timed = [r.period for r in only if r.period.rank]
        if ts is not None and len(timed) == len(only):
            low, high = min(p.start for p in timed), max(p.close_boundary() for p in timed)
            rows = rows.where((F.col("ts") >= F.lit(low).cast("timestamp")) & (F.col("ts") < F.timestamp_seconds(F.lit(high))))
    rows = rows.where(F.col("event").isNotNull() & F.col("id").between(0, MAX_ID) & (F.lit(gran == "none") | F.col("ts").isNotNull()))
    rows = rows.select("event", F.inline(P.levels(F.col("ts"), gran, rollup)), "id").select(*KEY, "id")
    return rows if repeats else rows.distinct()


def get(members: DataFrame, event: str, period: Period) -> DataFrame:
    return members.where(is_ref(Ref(event, period))).select("id")


def _within(members: DataFrame, event: str, first: Period, last: Period) -> DataFrame:
    if not P.checked_read_range(first, last):
        return members.where(F.lit(False))
    rows = members.where((F.col("event") == event) & (F.col("gran") == first.gran))
    if first.rank == 0:
        return rows
    return rows.where(F.col("period_start").between(F.lit(first.start).cast("timestamp"), F.lit(last.start).cast("timestamp")))


def get_range(members: DataFrame, event: str, first: Period, last: Period) -> DataFrame:
    """(period_start, period_key, id) of an inclusive range; empty periods have no rows."""
    return _within(members, event, first, last).select("period_start", "period_key", "id").orderBy("period_start", "id")


def exists(members: DataFrame, keys: list[Ref]) -> DataFrame:
    """(event, period_key, found) for each key asked for."""
    spark = members.sparkSession
    asked = _table(spark, [(r.event, r.period.gran, r.period.key) for r in keys], "event string, gran string, period_key string")
    have = members.where(one_of(keys)).select("event", "gran", "period_key").distinct().withColumn("_is", F.lit(True))
    return asked.join(have, ["event", "gran", "period_key"], "left").select("event", "period_key", F.col("_is").isNotNull().alias("found"))


def contains_batch(members: DataFrame, event: str, period: Period, ids: DataFrame) -> DataFrame:
    """(pos, id, found) for a probe table (pos, id)."""
    own = get(members, event, period).withColumn("_is", F.lit(True))
    return ids.join(own, "id", "left").select("pos", "id", F.col("_is").isNotNull().alias("found"))


def contains_ids_batch(members: DataFrame, dictionary: DataFrame, event: str, period: Period, names: DataFrame) -> DataFrame:
    """(pos, ext_id, found) for a probe table (pos, ext_id); unknown strings are not found."""
    probe = names.join(dictionary, "ext_id", "left")
    own = get(members, event, period).withColumn("_is", F.lit(True))
    return probe.join(own, "id", "left").select("pos", "ext_id", F.col("_is").isNotNull().alias("found"))


def cardinality(members: DataFrame) -> DataFrame:
    """The exact count of every set."""
    return members.groupBy(*KEY).agg(F.count("*").alias("n"))


def cardinality_of(members: DataFrame, event: str, period: Period) -> DataFrame:
    return get(members, event, period).agg(F.count("*").alias("n"))


def cardinality_range(members: DataFrame, event: str, first: Period, last: Period) -> DataFrame:
    """(period_start, period_key, n) in ascending order; empty periods have no rows."""
    return _within(members, event, first, last).groupBy("period_start", "period_key").agg(F.count("*").alias("n")).orderBy("period_start")


def expression_cardinality(members: DataFrame, expr: SetExpr) -> DataFrame:
    return evaluate(members, expr).agg(F.count("*").alias("n"))


def intersect_cardinality(members: DataFrame, a: Ref, b: Ref) -> DataFrame:
    return expression_cardinality(members, And(a, b))


def union_cardinality(members: DataFrame, a: Ref, b: Ref) -> DataFrame:
    return expression_cardinality(members, Or(a, b))


def union_cardinality_many(members: DataFrame, keys: Iterable[Ref]) -> DataFrame:
    """Distinct ids in any of the sets; 0 for no sets."""
    return members.where(one_of(list(dict.fromkeys(keys)))).agg(F.count_distinct("id").alias("n"))


def intersect_cardinality_many(members: DataFrame, keys: Iterable[Ref]) -> DataFrame:
    """Ids in all of the sets; 0 for no sets. A repeated key counts once."""
    own = list(dict.fromkeys(keys))
    every = members.where(one_of(own)).groupBy("id").agg(F.count("*").alias("c")).where(F.col("c") == len(own))
    return every.agg(F.count("*").alias("n"))


def find_memberships(members: DataFrame, dictionary: DataFrame, ext_id: str) -> DataFrame:
    """(event, gran, period_key) of every set that holds an entity, coarser buckets included, in period order."""
    own = dictionary.where(F.col("ext_id") == ext_id).select("id")
    found = members.join(own, "id", "left_semi")
    return found.orderBy("event", P.rank_of(F.col("gran")), "period_start").select("event", "gran", "period_key")


def find_memberships_batch(members: DataFrame, dictionary: DataFrame, names: DataFrame) -> DataFrame:
    """(pos, ext_id, memberships) for a probe table (pos, ext_id): a sorted list for each, empty where unknown."""
    hits = names.join(dictionary, "ext_id").join(members, "id").groupBy("pos").agg(F.sort_array(F.collect_set(F.struct("event", "gran", "period_key"))).alias("memberships"))
    empty = F.array().cast("array<struct<event: string, gran: string, period_key: string>>")
    return names.join(hits, "pos", "left").select("pos", "ext_id", F.coalesce("memberships", empty).alias("memberships"))


def inverted_index(members: DataFrame) -> DataFrame:
    """(id, n, memberships): every entity's sets. An entity's list is bounded by the number of sets."""
    return members.groupBy("id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.concat_ws("/", "event", "gran", "period_key"))).alias("memberships"))


def get_ids(members: DataFrame, dictionary: DataFrame, event: str, period: Period) -> DataFrame:
    """External ids of a set; ids without an entry are left out."""
    return get(members, event, period).join(dictionary, "id").select("ext_id")


UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def get_uuids(members: DataFrame, dictionary: DataFrame, event: str, period: Period) -> DataFrame:
    return get_ids(members, dictionary, event, period).where(F.col("ext_id").rlike(UUID))


def list_events(members: DataFrame) -> DataFrame:
    return members.select("event").distinct().orderBy("event")


def list_periods(members: DataFrame, event: str) -> DataFrame:
    """Distinct periods of an event, in period order."""
    own = members.where(F.col("event") == event).select("gran", "period_start", "period_key").distinct()
    return own.orderBy(P.rank_of(F.col("gran")), "period_start").select("gran", "period_key")


def export_u32(ids: DataFrame) -> DataFrame:
    return ids.select("id").orderBy("id")


def export_ids(ids: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Strings of a set in byte order."""
    return ids.join(dictionary, "id").select("ext_id").orderBy("ext_id")


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of literals, made on the JVM."""
    import json

    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = "array<struct<" + ", ".join(c.replace(" ", ": ", 1) for c in schema.split(", ")) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


literal_table = _table
