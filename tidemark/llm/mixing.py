"""Mixing sources to target weights by Pfair scheduling.

Block k of a source with weight w has the release time floor(k / w) and the deadline ceil((k + 1) / w); running
the released block with the earliest deadline in every slot keeps each source within less than one block of
its share at all times. Weights are whole shares of a period of slots, so one period's schedule, a small table
whatever the number of documents, repeats for ever; a document's slot then follows from its place within its
source.

Places are counted without gathering a source in one task: documents are ordered by the MD5 of doc_id and dealt into buckets by
its first digits, as many as the counts ask for, so no arithmetic of ids fills one bucket. Each bucket is numbered by itself, and
bucket totals are added up in a table of sources x buckets.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.store import Shelf

#: What a null source is called.
NO_SOURCE = "null"


def schedule(shares: dict[str, int]) -> list[str]:
    """The source that runs in each slot of one period, of as many slots as there are shares."""
    period = sum(shares.values())
    waiting = [(0, s, 0) for s in sorted(shares)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // shares[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append(s)
        if k + 1 < shares[s]:
            heapq.heappush(waiting, ((k + 1) * period // shares[s], s, k + 1))
    return out


def root_shares(counts: dict[str, int], most: int = 100) -> dict[str, int]:
    """Whole shares in proportion to the square roots of the counts, the largest being ``most``, none below 1."""
    top = max(counts.values(), default=1) ** 0.5
    return {s: max(1, int(most * n**0.5 / top + 0.5)) for s, n in counts.items()}


#: Documents of a bucket, about.
_BUCKET = 50_000


def places(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``place``, a document's number from 0 within its source, to about ``n`` rows of (row, source, doc_id).

    Places go by the MD5 of doc_id, then doc_id, then the rest of the row's hash; a null doc_id has the row's hash instead. They
    don't depend on the number of buckets.
    """
    digits = max(3, -(-(n // _BUCKET).bit_length() // 4))
    rest = F.xxhash64(*[F.col(f"row.`{f.name}`") for f in rows.schema["row"].dataType.fields if not isinstance(f.dataType, T.MapType | T.VariantType)])
    rows = rows.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), rest.cast("string")))))
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    counts = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = counts.select("source", "bucket", before.alias("start"))
    own = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id", rest))
    return rows.withColumn("own", own).join(start, ["source", "bucket"]).select("row", "source", (F.col("start") + F.col("own") - 1).alias("place"))


#: Rows of a period that are broadcast: some tens of MB.
_BROADCAST = 200_000


def mix(docs: DataFrame, shares: dict[str, int] | None = None, block: int = 16, max_sources: int = 100_000, max_period: int = 2_000_000) -> DataFrame:
    """Adds mix_slot, mix_order and in_mix to documents (doc_id, source, ...): the order of the mixture.

    A slot runs one block of up to ``block`` documents of one source; sorting by (mix_slot, mix_order) gives
    the mixture, in which every source is within less than one block of its target weight for as long as no
    source has run out (in_mix). Later slots of a source that ran out stay empty, so no document is dropped.

    ``shares``: whole shares by source; by default in proportion to the square root of a source's count, the largest being
    100, or less where a period would not fit. A source without a share of its own, and a null one, which is called "null", has
    one share. Repeated rows are documents of their own and ties are ordered by the row's content. Texts are not looked at, so
    their length does not matter. Other columns stay, whatever their names, columns named like the results are replaced, and
    an empty table gives no rows. The schedule of a period is made on the driver and stored as a table, so more than ``max_sources``
    sources or ``max_period`` slots raise an error; it is broadcast if it is small.
    """
    names = [c for c in docs.columns if c not in ("mix_slot", "mix_order", "in_mix")]
    spark = docs.sparkSession
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")  # one column, so no name can clash
    rows = docs.select(whole, F.coalesce(F.col("source"), F.lit(NO_SOURCE)).alias("source"), "doc_id")
    found = rows.groupBy("source").count().limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources; group the small ones first")
    counts = {r["source"]: r["count"] for r in found}
    if shares is None:
        shares = root_shares(counts, max(1, min(100, max_period // max(1, len(counts)))))
    shares = {s: max(1, shares.get(s, 1)) for s in counts}
    if sum(shares.values()) > max_period:
        raise ValueError(f"a period of more than {max_period} slots; give smaller shares")
    order = schedule(shares)
    slots: dict[str, list[int]] = {}
    for slot, s in enumerate(order):
        slots.setdefault(s, []).append(slot)
    # the first slot that a source could not fill
    ends = [(n // block) // shares[s] * len(order) + slots[s][(n // block) % shares[s]] for s, n in counts.items()]
    end = min(ends, default=0)
    plan = pa.table({"source": pa.array([s for s in slots for _ in slots[s]], pa.string()), "k": pa.array([k for s in slots for k in range(len(slots[s]))], pa.int64()), "slot": pa.array([x for s in slots for x in slots[s]], pa.int64())})
    shelf = Shelf(spark)
    plan = shelf.keep(spark.createDataFrame(plan) if len(order) else spark.createDataFrame([], "source string, k long, slot long"))
    sources = shelf.keep(plan.groupBy("source").agg(F.count("*").alias("share")))
    small = F.broadcast if len(order) <= _BROADCAST else lambda x: x
    numbered = places(rows, sum(counts.values())).withColumn("block", F.floor(F.col("place") / block))
    numbered = numbered.join(small(sources), "source").withColumn("k", F.col("block") % F.col("share")).join(small(plan), ["source", "k"])
    slot = F.floor(F.col("block") / F.col("share")) * len(order) + F.col("slot")
    out = numbered.select(*[F.col(f"row.`{c}`").alias(c) for c in names], slot.cast("long").alias("mix_slot"), (F.col("place") % block).cast("int").alias("mix_order"))
    return out.withColumn("in_mix", F.col("mix_slot") < end)
