"""Sets as bitmaps: buckets of 32,768 bits for fast counts, and the portable serialised form.

Bucket 0 holds id 0 alone; bucket b > 0 holds ids (b - 1) * 32768 + 1 to b * 32768.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import BitmapCorrupted
from tidemark.operators.sets import KEY
from tidemark.plans.expr import Ref, one_of

#: The portable format (fixed values): cookies, and the size up to which a container is a sorted array.
COOKIE, COOKIE_RUNS, ARRAY_MOST, BITS, NO_OFFSETS = 12346, 12347, 4096, 65536, 4


def build_buckets(members: DataFrame) -> DataFrame:
    """(event, gran, period_start, period_key, bucket, bitmap) of every set."""
    placed = members.withColumns({"bucket": F.bitmap_bucket_number("id"), "_at": F.bitmap_bit_position("id")})
    return placed.groupBy(*KEY, "bucket").agg(F.bitmap_construct_agg("_at").alias("bitmap"))


def bucket_ids(buckets: DataFrame) -> DataFrame:
    """Back from buckets to ids."""
    byte = F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.conv(F.hex(F.substring("bitmap", i + 1, F.lit(1))), 16, 10).cast("int"))
    rows = buckets.withColumn("_b", byte).select(*[c for c in buckets.columns if c not in ("bucket", "bitmap")], "bucket", F.posexplode("_b").alias("_i", "_byte")).where("_byte > 0")
    rows = rows.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(7)))).where(F.getbit("_byte", F.col("_bit")) == 1)
    at = F.when(F.col("bucket") == 0, F.lit(0)).otherwise((F.col("bucket") - 1) * 32768 + F.col("_i") * 8 + F.col("_bit") + 1)
    return rows.withColumn("id", at.cast("long")).drop("bucket", "_i", "_byte", "_bit")


def union_cardinality_many(buckets: DataFrame, keys: Iterable[Ref]) -> DataFrame:
    each = buckets.where(one_of(list(dict.fromkeys(keys)))).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("m"))
    return each.agg(F.coalesce(F.sum(F.bitmap_count("m")), F.lit(0)).alias("n"))


def intersect_cardinality_many(buckets: DataFrame, keys: Iterable[Ref]) -> DataFrame:
    """A bucket counts only where every set has it."""
    own = list(dict.fromkeys(keys))
    each = buckets.where(one_of(own)).groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("m"), F.count("*").alias("c")).where(F.col("c") == len(own))
    return each.agg(F.coalesce(F.sum(F.bitmap_count("m")), F.lit(0)).alias("n"))


def encode(ids: Iterable[int]) -> bytes:
    """Portable bytes of a set: sorted containers by the high 16 bits, arrays or plain bitmaps, no runs."""
    values = np.unique(np.fromiter(ids, np.uint64))
    if len(values) and values[-1] > 4_294_967_295:
        raise BitmapCorrupted("id out of range")
    return _whole(_containers(values))


def _containers(values: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(high bits, size, payload) of sorted distinct values."""
    high, low = (values >> np.uint64(16)).astype(np.int64), (values & np.uint64(0xFFFF)).astype(np.uint16)
    keys, start = np.unique(high, return_index=True)
    out = []
    for key, own in zip(keys.tolist(), np.split(low, start[1:]), strict=True) if len(keys) else ():
        if len(own) <= ARRAY_MOST:
            payload = own.astype("<u2").tobytes()
        else:
            bits = np.zeros(BITS, np.uint8)
            bits[own] = 1
            payload = np.packbits(bits, bitorder="little").tobytes()
        out.append((key, len(own), payload))
    return out


def _whole(containers: list[tuple[int, int, bytes]]) -> bytes:
    head = struct.pack("<II", COOKIE, len(containers)) + b"".join(struct.pack("<HH", k, n - 1) for k, n, _ in containers)
    at, offsets = len(head) + 4 * len(containers), []
    for *_, payload in containers:
        offsets.append(at)
        at += len(payload)
    return head + struct.pack(f"<{len(offsets)}I", *offsets) + b"".join(p for *_, p in containers)


def decode(raw: bytes) -> list[int]:
    """Ids of portable bytes, run containers included; malformed bytes raise ``BitmapCorrupted``."""
    try:
        return _decode(raw)
    except (struct.error, ValueError, IndexError) as e:
        raise BitmapCorrupted(str(e)) from e


def _decode(raw: bytes) -> list[int]:
    (cookie,) = struct.unpack_from("<I", raw, 0)
    if cookie & 0xFFFF == COOKIE_RUNS:
        n = (cookie >> 16) + 1
        runs = [bool(raw[4 + i // 8] >> i % 8 & 1) for i in range(n)]
        at = 4 + (n + 7) // 8
        offsets = n >= NO_OFFSETS
    elif cookie == COOKIE:
        (n,), at, offsets = struct.unpack_from("<I", raw, 4), 8, True
        if n > BITS:
            raise ValueError("too many containers")
        runs = [False] * n
    else:
        raise ValueError("unknown cookie")
    heads = [struct.unpack_from("<HH", raw, at + 4 * i) for i in range(n)]
    at += 4 * n + 4 * n * offsets
    out: list[int] = []
    for (key, size), run in zip(heads, runs, strict=True):
        base, size = key << 16, size + 1
        if run:
            (count,) = struct.unpack_from("<H", raw, at)
            for start, more in struct.iter_unpack("<HH", _exact(raw, at + 2, 4 * count)):
                out += range(base + start, base + start + more + 1)
            at += 2 + 4 * count
        elif size <= ARRAY_MOST:
            out += [base + x for (x,) in struct.iter_unpack("<H", _exact(raw, at, 2 * size))]
            at += 2 * size
        else:
            bits = np.unpackbits(np.frombuffer(_exact(raw, at, BITS // 8), np.uint8), bitorder="little")
            out += (np.flatnonzero(bits) + base).tolist()
            at += BITS // 8
    return out


def _exact(raw: bytes, at: int, size: int) -> bytes:
    part = raw[at : at + size]
    if len(part) != size:
        raise ValueError("truncated")
    return part


def contains(raw: bytes, id: int) -> bool:
    """Does a serialised set hold an id? Malformed bytes hold nothing.

    Only the container of the id's high bits is looked at: it is found in the header, and the id in it by bisection.
    """
    try:
        return _contains(raw, id >> 16, id & 0xFFFF)
    except (struct.error, ValueError, IndexError):
        return False


def _contains(raw: bytes, high: int, low: int) -> bool:
    (cookie,) = struct.unpack_from("<I", raw, 0)
    if cookie & 0xFFFF == COOKIE_RUNS:
        n, flags = (cookie >> 16) + 1, 4
        at = flags + (n + 7) // 8
        offsets = n >= NO_OFFSETS
    elif cookie == COOKIE:
        (n,), flags, at, offsets = struct.unpack_from("<I", raw, 4), None, 8, True
        if n > BITS:
            raise ValueError("too many containers")
    else:
        raise ValueError("unknown cookie")
    heads = np.frombuffer(_exact(raw, at, 4 * n), "<u2").reshape(n, 2)
    k = int(np.searchsorted(heads[:, 0], high))
    if k == n or heads[k, 0] != high:
        return False
    run = lambda i: flags is not None and bool(raw[flags + i // 8] >> i % 8 & 1)
    at += 4 * n
    if offsets:
        (at,) = struct.unpack_from("<I", raw, at + 4 * k)
    else:  # fewer than four containers, whose sizes add up
        for i in range(k):
            size = int(heads[i, 1]) + 1
            at += 2 + 4 * struct.unpack_from("<H", raw, at)[0] if run(i) else 2 * size if size <= ARRAY_MOST else BITS // 8
    size = int(heads[k, 1]) + 1
    if run(k):
        (count,) = struct.unpack_from("<H", raw, at)
        runs = np.frombuffer(_exact(raw, at + 2, 4 * count), "<u2").reshape(count, 2)
        i = int(np.searchsorted(runs[:, 0], low, "right")) - 1
        return i >= 0 and low - int(runs[i, 0]) <= int(runs[i, 1])
    if size <= ARRAY_MOST:
        values = np.frombuffer(_exact(raw, at, 2 * size), "<u2")
        i = int(np.searchsorted(values, low))
        return i < size and int(values[i]) == low
    return bool(_exact(raw, at, BITS // 8)[low // 8] >> low % 8 & 1)


def serialize_portable(sets: DataFrame, *keys: str) -> DataFrame:
    """(keys, bytes) for each group of ``id``: one container is encoded at a time, then the containers of a set
    are put together, so no task holds more than a set's serialised form."""

    def container(pdf: pd.DataFrame) -> pd.DataFrame:
        ((_, n, payload),) = _containers(np.unique(pdf["id"].to_numpy(np.uint64) & np.uint64(0xFFFF)))
        return pdf.iloc[:1][[*keys, "_high"]].assign(_n=n, _payload=payload)

    rows = sets.select(*keys, "id").withColumn("_high", F.shiftright("id", 16).cast("int"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    parts = rows.groupBy(*keys, "_high").applyInPandas(container, f"{kinds + ', ' if keys else ''}_high int, _n int, _payload binary")
    held = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_high", "_n", "_payload"))).alias("_c"))

    @F.pandas_udf("binary")
    def whole(c: pd.Series) -> pd.Series:
        return c.map(lambda own: _whole([(int(x["_high"]), int(x["_n"]), bytes(x["_payload"])) for x in own]))

    return held.select(*keys, whole("_c").alias("bytes"))


def serialized_contains(sets: DataFrame, column: str, id: int) -> DataFrame:
    """Adds ``found``: does the serialised set of a row hold the id?"""

    @F.pandas_udf("boolean")
    def has(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: x is not None and contains(bytes(x), id))

    return sets.withColumn("found", has(column))


def decoded_ids(sets: DataFrame, column: str) -> DataFrame:
    """Back from serialised sets to rows of ids."""

    @F.pandas_udf("array<bigint>")
    def ids(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: decode(bytes(x)))

    return sets.select(*[c for c in sets.columns if c != column], F.explode(ids(column)).alias("id"))
