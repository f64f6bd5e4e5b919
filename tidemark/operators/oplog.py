"""The operation log: puts and removes in order, folded to current sets by last-writer-wins.

ops: (op_seq, op, event, gran, period_start, period_key, id), op being put or remove. One call has one op_seq,
and within it an id of a key occurs once. barriers: (op_seq, event, gran, period_key), where null gran and key
stand for the whole event; ops older than a key's last barrier don't count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import periods as P

OPS = "op_seq long, op string, event string, gran string, period_start timestamp, period_key string, id long"
BARRIERS = "op_seq long, event string, gran string, period_key string"
KEY = ["event", "gran", "period_start", "period_key"]


def ops_from_facts(facts: DataFrame, seq: Column, op: Column, event: Column, id: Column, ts: Column, gran: str, rollup: str = "none") -> DataFrame:
    """Ops of a table of timed facts, each reaching its bucket and, with rollup, all coarser ones."""
    rows = facts.select(seq.cast("long").alias("op_seq"), op.alias("op"), event.alias("event"), ts.cast("timestamp").alias("ts"), id.cast("long").alias("id"))
    return rows.select("op_seq", "op", "event", F.inline(P.levels(F.col("ts"), gran, rollup)), "id").select("op_seq", "op", *KEY, "id")


def interval_buckets(intervals: DataFrame, first: Column, last: Column, gran: str, rollup: str = "none", within: tuple | None = None) -> DataFrame:
    """Rows of ``intervals`` for each bucket that [first, last] touches, and once for each coarser bucket.

    ``within``: (start, end) of the buckets wanted; intervals that miss them are dropped before they expand.
    Reversed intervals have no buckets.
    """
    if within is not None:  # plain comparisons first, which reach the scan
        low, high = (F.lit(x).cast("timestamp") for x in within)
        intervals = intervals.where((last >= low) & (first < high + F.expr(f"INTERVAL 1 {gran.upper()}")))
    rows = intervals.withColumns({"_a": F.date_trunc(gran, first), "_b": F.date_trunc(gran, last)})
    if within is not None:
        rows = rows.withColumns({"_a": F.greatest("_a", low), "_b": F.least("_b", high)})
    rows = rows.where(F.col("_a") <= F.col("_b")).withColumn("_ts", F.explode(P.buckets_between(F.col("_a"), F.col("_b"), gran)))
    rows = rows.select(*intervals.columns, F.inline(P.levels(F.col("_ts"), gran, rollup)))
    return rows.distinct() if rollup == "auto" else rows


def interval_counts(intervals: DataFrame, first: Column, last: Column, gran: str, rollup: str = "none") -> DataFrame:
    """(event, gran, period_key, n): how many ids of (event, id) have a bucket, over all buckets of all intervals.

    The same as counting the distinct ids of ``interval_buckets``, but an interval of any length is two rows a
    granularity: each one counts from where the id's earlier ones end, and counts are running sums over the ends.
    """
    grans = P.rollup_chain(gran) if rollup == "auto" else (gran,)
    ends = [F.struct(F.lit(g).alias("gran"), F.date_trunc(g, first).alias("a"), (F.date_trunc(g, last) + F.expr(f"INTERVAL 1 {g.upper()}")).alias("b")) for g in grans]
    rows = intervals.where(F.date_trunc(gran, first) <= F.date_trunc(gran, last)).select("event", "id", F.inline(F.array(*ends))).distinct()
    before = Window.partitionBy("event", "id", "gran").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("a", F.greatest("a", F.max("b").over(before))).where("a < b")  # greatest skips a null
    deltas = rows.select("event", "gran", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    deltas = deltas.groupBy("event", "gran", F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))  # a row a bucket
    along = Window.partitionBy("event", "gran").orderBy("at")
    steps = deltas.select("event", "gran", "at", F.sum("d").over(along).alias("n"), F.lead("at").over(along).alias("next")).where("n > 0")
    parts = []
    for g in grans:
        buckets = P.buckets_between(F.col("at"), F.col("next") - F.expr(f"INTERVAL 1 {g.upper()}"), g)
        parts.append(steps.where(F.col("gran") == g).withColumn("_ts", F.explode(buckets)).select("event", "n", P.period_struct(F.col("_ts"), g).alias("p")))
    return reduce(DataFrame.unionAll, parts).select("event", "p.gran", "p.period_key", "n")


def alive(ops: DataFrame, barriers: DataFrame | None) -> DataFrame:
    """Ops that no later barrier hides; a barrier's own call survives it."""
    if barriers is None:
        return ops
    whole = barriers.where("gran IS NULL").groupBy("event").agg(F.max("op_seq").alias("_whole"))
    own = barriers.where("gran IS NOT NULL").groupBy("event", "gran", "period_key").agg(F.max("op_seq").alias("_own"))
    rows = ops.join(whole, "event", "left").join(own, ["event", "gran", "period_key"], "left")
    return rows.where(F.col("op_seq") >= F.greatest(F.coalesce("_whole", F.lit(-1)), F.coalesce("_own", F.lit(-1)))).select(*ops.columns)


def last_op(ops: DataFrame) -> DataFrame:
    """The last op of every (key, id): one hash aggregation, the op being packed into the lowest bit."""
    packed = F.max(F.col("op_seq") * 2 + F.when(F.col("op") == "put", 1).otherwise(0)).alias("_last")
    return ops.groupBy(*KEY, "id").agg(packed).select(*KEY, "id", F.shiftright("_last", 1).alias("op_seq"), (F.col("_last") % 2 == 1).alias("is_put"))


def fold(ops: DataFrame, barriers: DataFrame | None = None) -> DataFrame:
    """Current members: (event, gran, period_start, period_key, id)."""
    return last_op(alive(ops, barriers)).where("is_put").select(*KEY, "id")


def changed_since(ops: DataFrame, barriers: DataFrame | None = None) -> DataFrame:
    """(event, gran, period_key, puts, removes): how many calls of each kind touch a key. What has more than one
    put call, or any remove, is worth compacting."""
    calls = alive(ops, barriers).select(*KEY, "op_seq", "op").distinct()
    return calls.groupBy("event", "gran", "period_key").agg(F.count_if(F.col("op") == "put").alias("puts"), F.count_if(F.col("op") == "remove").alias("removes"))
