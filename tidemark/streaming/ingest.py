"""Continuous ingest of timed facts into a store, each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import oplog, sets
from tidemark.operators.sets import MAX_ID
from tidemark.sources.store import Store


def write_batch(store: Store, source: str, facts: DataFrame, batch_id: int) -> bool:
    """Appends (event, ts, id, op) as one operation; a batch that was committed before changes nothing.

    Facts are never late: a bucket that has ended takes them all the same. Rows with a null or an id out of range
    are left out. The store keeps the last batch of a source, whose numbers only grow. An event's facts go to its finest granularity and, with rollup, to all coarser ones.
    """
    if batch_id <= store.manifest["batches"].get(source, -1):
        return False
    store._check(True)
    rows = facts.where("event IS NOT NULL AND ts IS NOT NULL").where(f"id BETWEEN 0 AND {MAX_ID}").cache()
    try:
        # one row an event, as many as the registry holds; events registered here stay so if the batch fails
        configs = [store.ensure_event(r["event"]) for r in rows.select("event").distinct().collect()]
        with store._whole():  # the batch counts as done only with the commit
            named = [(c.name, store._next_seq(), c.finest, c.rollup) for c in configs]
            store.manifest["written"] |= {event: seq for event, seq, *_ in named}
            known = F.broadcast(sets.literal_table(store.spark, named, "event string, op_seq long, finest string, rollup string"))
            for finest, rollup in sorted({(c.finest, c.rollup) for c in configs}):  # at most ten kinds
                own = rows.join(known.where((F.col("finest") == finest) & (F.col("rollup") == rollup)).select("event"), "event")
                # within one operation an id of a bucket is put or removed, the latest fact telling
                ops = oplog.ops_from_facts(own, F.unix_micros("ts"), F.col("op"), F.col("event"), F.col("id"), F.col("ts"), finest, rollup)
                last = oplog.last_op(ops).drop("op_seq").join(known.select("event", "op_seq"), "event")
                store.pending.append(("put", None, last.select("op_seq", F.when(F.col("is_put"), "put").otherwise("remove").alias("op"), *oplog.KEY, "id"), store.config.flush_rows))
            store.manifest["batches"][source] = batch_id
            store.flush()
    finally:
        rows.unpersist()
    return True


def start_ingest(facts: DataFrame, store: Store, source: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream of (event, ts, id, op) into the store. No watermark: late facts are kept."""
    return facts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: write_batch(store, source, df, n)).trigger(**(trigger or {"availableNow": True})).start()
