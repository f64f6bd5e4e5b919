"""A global dictionary of external strings: (ext_id, id), ids counting up from 0 and never used twice."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import Configuration

EMPTY = "ext_id string, id long"
MAX_ID = 4_294_967_295


def canonical_uuid(column):
    """The lower-case hyphenated form, or null where it is no UUID."""
    plain = F.lower(F.regexp_replace(F.trim(column), "^urn:uuid:|[{}-]", ""))
    parts = [F.substring(plain, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(plain.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))


def first_seen(names: DataFrame) -> DataFrame:
    """(ext_id, pos) of each distinct string of (pos, ext_id) at its first place."""
    return names.groupBy("ext_id").agg(F.min("pos").alias("pos"))


def _longs(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<long>")


def _range_of(pos: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are smaller; for null, as many as there are."""
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda values: F.size(F.filter(values, lambda c: c < pos))
    first = F.greatest(below(_longs(cuts[::step])) - 1, F.lit(0)) * step
    return F.when(pos.isNull(), len(cuts)).otherwise(first + below(F.slice(_longs(cuts), first + 1, F.lit(step))))


def numbered(new: DataFrame, next_id: int) -> DataFrame:
    """New strings (ext_id, pos) with ids from ``next_id`` in order of pos, null ones last.

    Ranges of pos, about as many as shuffle partitions, are numbered each by itself and start after the totals of the
    ranges before, so no task sorts all new strings. Their cuts, quantiles of pos, and their totals are constants of the
    plan: a row lies in the same range in every reading of ``new``. Partitions of repartitionByRange would not do, since each
    reading samples and merges them anew.
    """
    n = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = new.agg(F.percentile_approx("pos", [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    cuts = sorted(set(found or ()))
    spread = new.withColumn("_part", _range_of(F.col("pos"), cuts))
    totals = {r["_part"]: r["count"] for r in spread.groupBy("_part").count().collect()}  # a row a range
    starts = list(accumulate((totals.get(k, 0) for k in range(len(cuts))), initial=next_id))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_last("pos"), "ext_id")) - 1
    return spread.withColumn("_own", own).select("ext_id", (F.get(_longs(starts), F.col("_part")) + F.col("_own")).alias("id"))


def assign(dictionary: DataFrame, names: DataFrame, next_id: int) -> DataFrame:
    """Entries to add for the strings of (pos, ext_id) that have none, in order of first appearance.

    Empty strings are refused. ``numbered`` reads the new ones more than once, so ``names`` should be a stored table.
    """
    if not names.where("ext_id IS NULL OR ext_id = ''").isEmpty():
        raise Configuration("an external id can't be empty")
    new = first_seen(names).join(dictionary, "ext_id", "left_anti")
    n = new.count()
    if next_id + n - 1 > MAX_ID:
        raise Configuration("the dictionary has no more ids")
    return numbered(new, next_id)


def lookup_batch(dictionary: DataFrame, names: DataFrame) -> DataFrame:
    """(pos, ext_id, id): null for unknown strings."""
    return names.join(dictionary, "ext_id", "left").select("pos", "ext_id", "id")


def resolve_batch(dictionary: DataFrame, ids: DataFrame) -> DataFrame:
    """(pos, id, ext_id): null for unknown ids."""
    return ids.join(dictionary, "id", "left").select("pos", "id", "ext_id")


def resolved_pairs(dictionary: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, ext_id) of the known ids alone."""
    return ids.select("id").distinct().join(dictionary, "id").select("id", "ext_id")


def lookup(dictionary: DataFrame, ext_id: str) -> DataFrame:
    return dictionary.where(F.col("ext_id") == ext_id).select("id")


def resolve(dictionary: DataFrame, id: int) -> DataFrame:
    return dictionary.where(F.col("id") == id).select("ext_id")


def without(dictionary: DataFrame, names: DataFrame) -> DataFrame:
    """The dictionary less some strings; their ids are not used again."""
    return dictionary.join(names.select("ext_id"), "ext_id", "left_anti")
