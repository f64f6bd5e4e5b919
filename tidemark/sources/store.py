"""A store of time-bucketed sets: one writer, many readers, snapshot by manifest.

Data are Parquet directories that never change once written; ``_manifest.json`` names those that count, and its
replacement is the only moment at which anything becomes visible. A failed or stopped write leaves directories
that no manifest names; opening the store for writing removes them. Directories that a commit replaces stay for the
retention time, so readers that hold an older manifest can go on.

Writes are buffered as plans and become one directory at ``flush``, with a part an event, so reads and compaction of an
event leave the files of others alone. Reads see the buffer. Replacing or dropping
periods flushes at once.
"""

from __future__ import annotations

import copy
import json
import time
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from typing import Protocol
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import errors as E
from tidemark.functions import periods as P
from tidemark.functions.periods import Period
from tidemark.operators import bitmaps, dictionary, oplog, sets
from tidemark.plans.expr import Ref, SetExpr, evaluate
from tidemark.sources.files import Files

MANIFEST, VERSION = "_manifest.json", 2
MAX_ID = sets.MAX_ID
Ids = Iterable[int] | DataFrame
Names = Iterable[str] | DataFrame


class Metrics(Protocol):
    """What a store tells about itself. A store calls bitmap_read, mempart_flushed, compaction_completed,
    delta_written, bitmap_written, backfill_write, rollup_performed, period_state_changed and error_occurred."""

    def bitmap_written(self, event: str, period: Period, bytes: int, cardinality: int) -> None: ...
    def delta_written(self, event: str, period: Period, bits_removed: int) -> None: ...
    def backfill_write(self, event: str, period: Period, lag_seconds: int) -> None: ...
    def bitmap_read(self, event: str, period: Period, cached: bool, seconds: float) -> None: ...
    def rollup_performed(self, event: str, source: Period, target: Period) -> None: ...
    def mempart_flushed(self, data_parts: int, delta_parts: int, bytes: int) -> None: ...
    def compaction_completed(self, periods: int, parts: int, deltas: int, bytes: int) -> None: ...
    def period_state_changed(self, event: str, period: Period, old: str, new: str) -> None: ...
    def error_occurred(self, error: Exception) -> None: ...


#: Ids or names beyond which a list is sent as Arrow batches, and bits of a range of ids that files keep together.
LITERAL, RANGE_BITS = 10_000, 22


class NullMetrics:
    """Ignores everything."""

    def __getattr__(self, name: str):
        return lambda *a, **k: None


@dataclass(frozen=True)
class StoreConfig:
    default_granularity: str = "day"
    default_rollup: str = "none"
    flush_rows: int = 1_000_000
    max_events: int = 0
    read_only: bool = False
    clock: Callable[[], float] = time.time
    metrics: object = field(default_factory=NullMetrics)
    map_size: int | None = None  # accepted for compatibility, without effect
    index_freshness: str = "disabled"
    #: Seconds for which files that a commit has replaced stay, for readers that opened before it.
    retention: float = 86_400.0


@dataclass(frozen=True)
class EventConfig:
    name: str
    finest: str
    rollup: str

    @property
    def chain(self) -> tuple[str, ...]:
        return P.rollup_chain(self.finest) if self.rollup == "auto" else ()


@dataclass
class CompactStats:
    periods_compacted: int = 0
    parts_merged: int = 0
    deltas_applied: int = 0
    bytes_reclaimed: int = 0


@dataclass
class Health:
    catalog_ok: bool
    mempart_size_bytes: int
    mempart_entries: int
    total_events: int
    total_data_parts: int
    total_delta_parts: int
    open_periods: int
    closed_periods: int
    compacted_periods: int
    periods_needing_compaction: int
    disk_usage_bytes: int


def _fresh() -> dict:
    return {"version": VERSION, "next_seq": 1, "next_id": 0, "ops": {}, "dictionary": [], "deleted": [], "stats": None, "events": {}, "barriers": [], "states": {}, "written": {}, "batches": {}, "log": {}, "retired": {}}


class Store:
    """Opens or makes a store at ``path``."""

    def __init__(self, spark: SparkSession, path: str, config: StoreConfig | None = None, **options):
        self.spark, self.config = spark, replace(config or StoreConfig(), **options)
        c = self.config
        if c.index_freshness not in ("disabled", "on_flush", "on_compact"):
            raise E.Configuration(f"index freshness {c.index_freshness!r} is not supported")
        if c.default_granularity not in P.GRANULARITIES or c.default_rollup not in P.ROLLUPS:
            raise E.Configuration("unknown default granularity or rollup")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.path, self.files, self.is_closed = path.rstrip("/"), Files(spark, path), False
        self.pending: list[tuple[str, Period | None, DataFrame, int]] = []
        self._pinned: tuple[tuple, DataFrame] | None = None
        if self.files.exists(MANIFEST):
            self.manifest = self._load()
        elif c.read_only:
            raise E.Configuration(f"no store at {path}")
        else:
            self.files.mkdirs()
            self.manifest = _fresh()
            self._commit()
        if not c.read_only:
            self.vacuum()

    # life cycle

    def _load(self) -> dict:
        try:
            found = json.loads(self.files.read(MANIFEST))
        except ValueError as e:
            raise E.CatalogCorrupted(str(e)) from e
        if not isinstance(found, dict) or found.get("version") != VERSION or set(_fresh()) - set(found):
            raise E.CatalogCorrupted("the manifest is malformed or of an unknown version")
        return found

    def refresh(self) -> None:
        """Takes up what another process has committed since."""
        self.manifest = self._load()

    def _commit(self) -> None:
        try:
            self.files.write(MANIFEST, json.dumps(self.manifest, sort_keys=True))
        except Exception as e:
            self.config.metrics.error_occurred(e)
            raise E.CatalogError(str(e)) from e

    @contextmanager
    def _whole(self):
        """A change that is taken back, in memory, if it does not come to its commit."""
        manifest, pending = copy.deepcopy(self.manifest), list(self.pending)
        try:
            yield
        except BaseException:
            self.manifest, self.pending = manifest, pending
            raise

    def _retire(self, *places: str | None) -> None:
        """Files that the next commit no longer names; readers of older manifests may still need them."""
        self.manifest["retired"] |= dict.fromkeys(filter(None, places), self.config.clock())

    def vacuum(self) -> list[str]:
        """Removes data directories that the manifest does not name, replaced ones once the retention has passed."""
        oldest = self.config.clock() - self.config.retention
        self.manifest["retired"] = {k: t for k, t in self.manifest["retired"].items() if t > oldest}
        live = {*self.manifest["ops"], *self.manifest["dictionary"], *self.manifest["deleted"], self.manifest["stats"], *self.manifest["retired"]}
        gone = [f"{at}/{x}" for at in ("data", "ops") for x in self.files.names(at) if f"{at}/{x}" not in live]
        for x in gone:
            self.files.delete(x)
        return gone

    def _check(self, change: bool = False) -> None:
        if self.is_closed:
            raise E.Closed("the store is closed")
        if change and self.config.read_only:
            raise E.ReadOnly("the store is read-only")

    def close(self) -> None:
        if not self.is_closed:
            if not self.config.read_only:
                self.flush()
            self.is_closed = True

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # events

    def _event(self, name: str) -> EventConfig | None:
        found = self.manifest["events"].get(name)
        return EventConfig(name, *found) if found else None

    def register_event(self, name: str, granularity: str, rollup: str = "none") -> EventConfig:
        self._check(True)
        P.check_event_name(name)
        if self._event(name):
            raise E.EventAlreadyRegistered(name)
        return self._register(name, granularity, rollup)

    def _register(self, name: str, granularity: str, rollup: str) -> EventConfig:
        if granularity not in P.GRANULARITIES or rollup not in P.ROLLUPS:
            raise E.Configuration("unknown granularity or rollup")
        self.manifest["events"][name] = [granularity, "none" if granularity == "none" else rollup]
        self._commit()
        return self._event(name)

    def ensure_event(self, name: str) -> EventConfig:
        self._check(True)
        P.check_event_name(name)
        found = self._event(name)
        if found:
            return found
        if self.config.max_events and len(self.manifest["events"]) >= self.config.max_events:
            raise E.Configuration(f"more than {self.config.max_events} events")
        return self._register(name, self.config.default_granularity, self.config.default_rollup)

    def list_events(self) -> list[EventConfig]:
        self._check()
        return [self._event(n) for n in sorted(self.manifest["events"])]

    # writes

    def _ids(self, ids: Ids) -> tuple[DataFrame, int | None]:
        if isinstance(ids, DataFrame):
            ok = F.col("id").between(0, MAX_ID)
            return ids.select(F.when(ok, F.col("id")).otherwise(F.raise_error(F.lit("id out of range"))).cast("long").alias("id")).distinct(), None
        own = sorted(set(ids))
        if own and not 0 <= own[0] <= own[-1] <= MAX_ID:
            raise E.Configuration("id out of range")
        if len(own) > LITERAL:  # Arrow batches rather than a literal in the plan
            return self.spark.createDataFrame(pa.table({"id": pa.array(own, pa.int64())})), len(own)
        return sets.literal_table(self.spark, [(i,) for i in own], "id long"), len(own)

    def _names(self, names: Names) -> DataFrame:
        if isinstance(names, DataFrame):
            return names
        if len(names) > LITERAL:
            return self.spark.createDataFrame(pa.table({"pos": pa.array(range(len(names)), pa.int64()), "ext_id": pa.array(names, pa.string())}))
        return sets.literal_table(self.spark, list(enumerate(names)), "pos long, ext_id string")

    def _targets(self, config: EventConfig, buckets: list[Period]) -> list[Period]:
        """Buckets and, with rollup, each ancestor in the event's chain once."""
        up = {a: b for b in buckets for a in b.ancestors() if a.gran in config.chain and b.gran in config.chain}
        for target, source in up.items():
            self.config.metrics.rollup_performed(config.name, source, target)
        return list(dict.fromkeys([*buckets, *sorted(up)]))

    def _next_seq(self) -> int:
        seq = self.manifest["next_seq"]
        self.manifest["next_seq"] = seq + 1
        return seq

    def _write(self, config: EventConfig, op: str, buckets: list[Period], ids: DataFrame, n: int | None, flush: bool = True, rollup: bool = True) -> None:
        targets = self._targets(config, buckets) if rollup else buckets
        seq = self._next_seq()
        rows = [(p.gran, p.start.strftime("%Y-%m-%d %H:%M:%S") if p.start else None, p.key) for p in targets]
        ops = ids.select("id", F.lit(seq).cast("long").alias("op_seq"), F.lit(op).alias("op"), F.lit(config.name).alias("event"))
        # the buckets, at most MAX_RANGE and their ancestors, are one literal
        kind = "array<struct<gran: string, period_start: string, period_key: string>>"
        at = F.from_json(F.lit(json.dumps([dict(zip(("gran", "period_start", "period_key"), r, strict=True)) for r in rows])), kind)
        ops = ops.select("op_seq", "op", "event", F.inline(at), "id").withColumn("period_start", F.to_timestamp("period_start"))
        self.pending.append((op, buckets[0], ops, (n if n is not None else self.config.flush_rows) * len(targets)))
        self.manifest["written"][config.name] = seq
        self._backfill(config, buckets)
        if op == "put":
            self.config.metrics.bitmap_written(config.name, buckets[0], 0, n or 0)
        else:
            self.config.metrics.delta_written(config.name, buckets[0], n or 0)
        if flush and sum(rows for *_, rows in self.pending) >= self.config.flush_rows:
            self.flush()

    def _backfill(self, config: EventConfig, buckets: list[Period]) -> None:
        """A late write opens a compacted period again."""
        now = int(self.config.clock())
        for p in buckets:
            if not p.is_closed(now):
                continue
            self.config.metrics.backfill_write(config.name, p, now - p.close_boundary())
            place = f"{config.name}/{p.gran}/{p.key}"
            if self.manifest["states"].get(place) == "compacted":
                self.manifest["states"][place] = "closed"
                self.config.metrics.period_state_changed(config.name, p, "compacted", "closed")

    def _put_config(self, event: str, period: Period) -> EventConfig:
        self._check(True)
        period.validate()
        config = self.ensure_event(event)
        if period.rank != 0 and period.gran != config.finest:
            raise E.GranularityMismatch(f"{event}: {period.key} is no {config.finest} period")
        return config

    def put(self, event: str, period: Period, ids: Ids) -> None:
        """Adds ids to a bucket and, with rollup, to all coarser ones. No ids: a validated no-op."""
        config = self._put_config(event, period)
        rows, n = self._ids(ids)
        if n != 0:
            self._write(config, "put", [period], rows, n)

    def _range_config(self, event: str, first: Period, last: Period) -> tuple[EventConfig, list[Period]]:
        self._check(True)
        P.check_event_name(event)
        finest = self._event(event).finest if self._event(event) else self.config.default_granularity
        buckets = P.checked_write_range(first, last, finest)
        return self.ensure_event(event), buckets

    def put_range(self, event: str, first: Period, last: Period, ids: Ids) -> None:
        """Adds ids to every bucket of an inclusive interval, as one operation."""
        config, buckets = self._range_config(event, first, last)
        rows, n = self._ids(ids)
        if n != 0:
            self._write(config, "put", buckets, rows, n)

    def remove(self, event: str, period: Period, ids: Ids) -> None:
        """Takes ids out of a bucket of any granularity and of all coarser ones, even where a sibling has them."""
        self._check(True)
        period.validate()
        config = self.ensure_event(event)
        rows, n = self._ids(ids)
        if n != 0:
            self._write(config, "remove", [period], rows, n, flush=False)

    def remove_range(self, event: str, first: Period, last: Period, ids: Ids) -> None:
        config, buckets = self._range_config(event, first, last)
        rows, n = self._ids(ids)
        if n != 0:
            self._write(config, "remove", buckets, rows, n)

    def put_ids(self, event: str, period: Period, names: Names) -> None:
        """``put`` by external strings, which get an id where they have none. Checks come before any id is used."""
        self._check(True)
        if isinstance(names, list | tuple) and not names:
            return
        self._put_config(event, period)
        self.put(event, period, self._assigned(names))

    def put_ids_range(self, event: str, first: Period, last: Period, names: Names) -> None:
        self._range_config(event, first, last)
        if isinstance(names, list | tuple) and not names:
            return
        self.put_range(event, first, last, self._assigned(names))

    def _known(self, names: Names) -> DataFrame:
        return dictionary.lookup_batch(self.dictionary(), self._names(names)).where("id IS NOT NULL").select("id").distinct()

    def remove_ids(self, event: str, period: Period, names: Names) -> None:
        """Unknown strings are ignored; if all are, nothing happens."""
        self._check(True)
        known = self._known(names)
        if not known.isEmpty():
            self.remove(event, period, known)

    def remove_ids_range(self, event: str, first: Period, last: Period, names: Names) -> None:
        self._range_config(event, first, last)
        known = self._known(names)
        if not known.isEmpty():
            self.remove_range(event, first, last, known)

    def replace(self, event: str, period: Period, ids: Ids) -> None:
        """Makes a bucket hold just these ids, at once; coarser buckets stay as they are."""
        self.bulk_replace(event, [(period, ids)])

    def bulk_replace(self, event: str, changes: list[tuple[Period, Ids]]) -> None:
        """``replace`` for several buckets of an event in one commit."""
        self._check(True)
        for period, _ in changes:
            period.validate()
        config = self.ensure_event(event)
        for period, ids in changes:
            rows, n = self._ids(ids)
            if n != 0:
                self._write(config, "put", [period], rows, n, flush=False, rollup=False)
            else:
                self.manifest["written"][event] = self._next_seq()
            seq = self.manifest["written"][event]
            self.manifest["barriers"].append([seq, event, period.gran, period.key])
        self.flush()

    # UUID forms

    @staticmethod
    def _uuid(value) -> str:
        return str(value if isinstance(value, uuid.UUID) else uuid.UUID(str(value)))

    def _uuids(self, values: list | DataFrame) -> Names:
        """Canonical forms; (pos, ext_id) of a table, where anything else raises an error."""
        if isinstance(values, DataFrame):
            return values.select("pos", F.coalesce(dictionary.canonical_uuid(F.col("ext_id")), F.raise_error(F.lit("no UUID"))).alias("ext_id"))
        return [self._uuid(x) for x in values]

    def put_uuids(self, event: str, period: Period, values: list | DataFrame) -> None:
        self.put_ids(event, period, self._uuids(values))

    def put_uuids_range(self, event: str, first: Period, last: Period, values: list | DataFrame) -> None:
        self.put_ids_range(event, first, last, self._uuids(values))

    def remove_uuids(self, event: str, period: Period, values: list | DataFrame) -> None:
        self.remove_ids(event, period, self._uuids(values))

    def remove_uuids_range(self, event: str, first: Period, last: Period, values: list | DataFrame) -> None:
        self.remove_ids_range(event, first, last, self._uuids(values))

    def get_uuids(self, event: str, period: Period) -> DataFrame:
        return sets.get_uuids(self.members(), self.dictionary(), event, period)

    def contains_uuid(self, event: str, period: Period, value) -> bool:
        return self.contains_id(event, period, self._uuid(value))

    def find_memberships_uuid(self, value) -> DataFrame:
        return self.find_memberships(self._uuid(value))

    def delete_entity_uuid(self, value) -> int:
        return self.delete_entity(self._uuid(value))

    # dictionary

    def _read(self, places: list[str], schema: str) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}" for x in places])

    def dictionary(self) -> DataFrame:
        """Live entries: (ext_id, id)."""
        self._check()
        live = self._read(self.manifest["dictionary"], dictionary.EMPTY)
        if self.manifest["deleted"]:
            live = live.join(self._read(self.manifest["deleted"], "id long"), "id", "left_anti").select("ext_id", "id")
        return live

    def _save(self, df: DataFrame) -> str:
        place = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{place}")
        return place

    def _save_ops(self, ops: DataFrame) -> str:
        """Operations in a directory an event, by period and id, with Bloom filters of ids. A large set falls into ranges of ids."""
        place = f"ops/part={uuid.uuid4().hex}"
        dealt = ops.repartition("event", "gran", "period_key", F.shiftright("id", RANGE_BITS)).sortWithinPartitions("event", "gran", "period_key", "id")
        dealt.write.partitionBy("event").option("parquet.bloom.filter.enabled#id", "true").parquet(f"{self.path}/{place}")
        self.manifest["ops"][place] = self.manifest["next_seq"] - 1
        return place

    def _read_ops(self, places: Iterable[str]) -> DataFrame:
        places = sorted(places)
        if not places:
            return self.spark.createDataFrame([], oplog.OPS)
        found = self.spark.read.schema(f"{oplog.OPS}, part string").option("basePath", f"{self.path}/ops").parquet(*[f"{self.path}/{x}" for x in places])
        return found.select(*[c.split()[0] for c in oplog.OPS.split(", ")])

    def _events_in(self, place: str) -> set[str]:
        return {unquote(x.removeprefix("event=")) for x in self.files.names(place) if x.startswith("event=")}

    def _assigned(self, names: Names) -> DataFrame:
        asked = self._names(names)
        if isinstance(names, DataFrame):
            place = self._save(asked)
            asked = self._read([place], "pos long, ext_id string")
        place = self._save(dictionary.assign(self.dictionary(), asked, self.manifest["next_id"]))
        added = self._read([place], dictionary.EMPTY)
        top = added.agg(F.max("id")).first()[0]
        if top is not None:
            self.manifest["dictionary"].append(place)
            self.manifest["next_id"] = top + 1
            self._commit()
        return dictionary.lookup_batch(self.dictionary(), asked).select("id").distinct()

    def assign(self, names: list[str]) -> list[int]:
        """Ids of strings in order, new ones for those that have none."""
        self._check(True)
        if names:
            self._assigned(names)
        return [x for x in self.lookup_batch(names)]

    def lookup_batch(self, names: list[str]) -> list[int | None]:
        rows = dictionary.lookup_batch(self.dictionary(), self._names(names)).orderBy("pos").collect() if names else []
        return [r["id"] for r in rows]

    def lookup(self, name: str) -> int | None:
        return self.lookup_batch([name])[0]

    def resolve_batch(self, ids: list[int]) -> list[str | None]:
        probe = sets.literal_table(self.spark, list(enumerate(ids)), "pos long, id long")
        rows = dictionary.resolve_batch(self.dictionary(), probe).orderBy("pos").collect() if ids else []
        return [r["ext_id"] for r in rows]

    def resolve(self, id: int) -> str | None:
        return self.resolve_batch([id])[0]

    def delete_name(self, name: str) -> int | None:
        """Drops a string's entry and gives its id, which is never used again."""
        self._check(True)
        id = self.lookup(name)
        if id is not None:
            self.manifest["deleted"].append(self._save(sets.literal_table(self.spark, [(id,)], "id long")))
            self._commit()
        return id

    def dictionary_len(self) -> int:
        return self.dictionary().count()

    # reads

    def _ops(self, pending: bool = True) -> DataFrame:
        stored = self._read_ops(self.manifest["ops"])
        return reduce(DataFrame.unionByName, [p[2] for p in self.pending], stored) if pending else stored

    def _barriers(self) -> DataFrame | None:
        rows = [tuple(b) for b in self.manifest["barriers"]]
        return sets.literal_table(self.spark, rows, oplog.BARRIERS) if rows else None

    def members(self) -> DataFrame:
        """The current state of every set, the buffer included."""
        self._check()
        version = (self.manifest["next_seq"], len(self.pending))
        if self._pinned and self._pinned[0] == version:
            return self._pinned[1]
        return oplog.fold(self._ops(), self._barriers())

    def pin(self) -> DataFrame:
        """Keeps the current state of every set in memory, spilling to disk, until the next write."""
        self.unpin()
        self._pinned = ((self.manifest["next_seq"], len(self.pending)), self.members().persist())
        return self._pinned[1]

    def unpin(self) -> None:
        if self._pinned:
            self._pinned[1].unpersist()
            self._pinned = None

    def _members_of(self, event: str) -> DataFrame:
        self._check()
        if self._pinned and self._pinned[0] == (self.manifest["next_seq"], len(self.pending)):
            return self._pinned[1]
        return oplog.fold(self._ops().where(F.col("event") == event), self._barriers())

    def get(self, event: str, period: Period) -> DataFrame:
        began = time.time()
        out = sets.get(self._members_of(event), event, period)
        self.config.metrics.bitmap_read(event, period, False, time.time() - began)
        return out

    get_shared = get

    def get_range(self, event: str, first: Period, last: Period) -> DataFrame:
        return sets.get_range(self._members_of(event), event, first, last)

    def get_ids(self, event: str, period: Period) -> DataFrame:
        return sets.get_ids(self._members_of(event), self.dictionary(), event, period)

    def exists(self, event: str, period: Period) -> bool:
        return not self.get(event, period).isEmpty()

    def contains_batch(self, event: str, period: Period, ids: list[int]) -> list[bool]:
        if not ids:
            return []
        probe = sets.literal_table(self.spark, list(enumerate(ids)), "pos long, id long")
        return [r["found"] for r in sets.contains_batch(self._members_of(event), event, period, probe).orderBy("pos").collect()]

    def contains_ids_batch(self, event: str, period: Period, names: list[str]) -> list[bool]:
        if not names:
            return []
        return [r["found"] for r in sets.contains_ids_batch(self._members_of(event), self.dictionary(), event, period, self._names(names)).orderBy("pos").collect()]

    def contains_id(self, event: str, period: Period, name: str) -> bool:
        return self.contains_ids_batch(event, period, [name])[0]

    def cardinality(self, event: str, period: Period) -> int:
        """Exact; from the statistics of the last compaction where nothing was written to the event since."""
        self._check()
        stats = self.manifest["stats"]
        state = self.manifest["states"].get(f"{event}/{period.gran}/{period.key}")
        if stats and state == "compacted" and not self.pending:
            row = self._read([stats], "event string, gran string, period_key string, n long, as_of_seq long").where((F.col("event") == event) & (F.col("gran") == period.gran) & (F.col("period_key") == period.key)).first()
            if row and row["as_of_seq"] >= self.manifest["written"].get(event, 0):
                return row["n"]
        return self.get(event, period).count()

    def cardinality_range(self, event: str, first: Period, last: Period) -> DataFrame:
        return sets.cardinality_range(self._members_of(event), event, first, last)

    def intersect_cardinality(self, a: Ref, b: Ref) -> int:
        return sets.intersect_cardinality(self.members(), a, b).first()["n"]

    def union_cardinality(self, a: Ref, b: Ref) -> int:
        return sets.union_cardinality(self.members(), a, b).first()["n"]

    def union_cardinality_many(self, keys: list[Ref]) -> int:
        return sets.union_cardinality_many(self.members(), keys).first()["n"]

    def intersect_cardinality_many(self, keys: list[Ref]) -> int:
        return sets.intersect_cardinality_many(self.members(), keys).first()["n"]

    def query(self, expr: SetExpr) -> DataFrame:
        return evaluate(self.members(), expr)

    def query_cardinality(self, expr: SetExpr) -> int:
        return sets.expression_cardinality(self.members(), expr).first()["n"]

    def find_memberships(self, name: str) -> DataFrame:
        return sets.find_memberships(self.members(), self.dictionary(), name)

    def find_memberships_batch(self, names: list[str]) -> DataFrame:
        return sets.find_memberships_batch(self.members(), self.dictionary(), self._names(names)).orderBy("pos")

    # exports

    @staticmethod
    def export_u32(ids: DataFrame) -> DataFrame:
        return sets.export_u32(ids)

    def export_ids(self, ids: DataFrame) -> DataFrame:
        return sets.export_ids(ids, self.dictionary())

    def export_uuids(self, ids: DataFrame) -> DataFrame:
        return self.export_ids(ids).where(F.col("ext_id").rlike(sets.UUID))

    @staticmethod
    def serialize_portable(ids: DataFrame) -> bytes:
        row = bitmaps.serialize_portable(ids).first()
        return bytes(row["bytes"]) if row else bitmaps.encode([])

    def query_export(self, expr: SetExpr) -> DataFrame:
        return sets.export_u32(self.query(expr))

    def query_serialize(self, expr: SetExpr) -> bytes:
        return self.serialize_portable(self.query(expr))

    # administration

    def flush(self) -> None:
        """Makes the buffer durable: one directory, one manifest."""
        self._check(True)
        if self.pending:
            with self._whole():
                rows = reduce(DataFrame.unionByName, [p[2] for p in self.pending])
                place = self._save_ops(rows)
                data, delta = (sum(p[0] == x for p in self.pending) for x in ("put", "remove"))
                self._commit()
            self.pending = []
            self.config.metrics.mempart_flushed(data, delta, self.files.size(place))
        else:
            self._commit()

    def list_periods(self, event: str) -> list[Period]:
        """Periods with flushed puts or removes, in period order."""
        self._check()
        stored = oplog.alive(self._ops(pending=False).where(F.col("event") == event), self._barriers())
        return sorted(P.parse_period_key(r["period_key"]) for r in stored.select("gran", "period_key").distinct().collect())

    def drop_event(self, event: str) -> None:
        """Drops an event and all its periods; the dictionary stays."""
        self._check(True)
        self.flush()
        seq = self._next_seq()
        self.manifest["barriers"].append([seq, event, None, None])
        self.manifest["events"].pop(event, None)
        self.manifest["written"].pop(event, None)
        self.manifest["states"] = {k: v for k, v in self.manifest["states"].items() if k.split("/")[0] != event}
        self._commit()

    def _drop_periods(self, event: str, gone: list[Period]) -> None:
        self.flush()
        seq = self._next_seq()
        for p in gone:
            self.manifest["barriers"].append([seq, event, p.gran, p.key])
            self.manifest["states"].pop(f"{event}/{p.gran}/{p.key}", None)
        self.manifest["written"][event] = seq
        self._commit()

    def delete_period(self, event: str, period: Period) -> None:
        """Drops just this bucket, neither coarser nor finer ones."""
        self._check(True)
        period.validate()
        self._drop_periods(event, [period])

    def retain_periods(self, event: str, keep: Callable[[Period], bool]) -> int:
        """Deletes the listed periods that fail the predicate, and says how many. Periods compare by granularity
        first: ``p >= a day`` keeps all months and years, and drops all hours and static sets."""
        self._check(True)
        gone = [p for p in self.list_periods(event) if not keep(p)]
        if gone:
            self._drop_periods(event, gone)
        return len(gone)

    def delete_entity(self, name: str) -> int:
        """Takes an entity out of every set and out of the dictionary; gives the number of its memberships."""
        self._check(True)
        id = self.lookup(name)
        if id is None:
            return 0
        self.flush()
        seq = self._next_seq()
        own = self.members().where(F.col("id") == id)
        place = self._save_ops(own.select(F.lit(seq).cast("long").alias("op_seq"), F.lit("remove").alias("op"), "event", "gran", "period_start", "period_key", "id"))
        rows = self._read_ops([place])
        counts = {r["event"]: r["count"] for r in rows.groupBy("event").count().collect()}
        self.manifest["written"] |= dict.fromkeys(counts, seq)
        self.delete_name(name)
        return sum(counts.values())

    def compact(self) -> CompactStats:
        """Folds the log of every event that has periods worth it, and logs the run."""
        stats = self._compact([e.name for e in self.list_events()])
        self.manifest["log"][str(int(self.config.clock()))] = asdict(stats)
        self._commit()
        return stats

    def compact_event(self, event: str) -> CompactStats:
        return self._compact([event])

    def _compact(self, events: list[str]) -> CompactStats:
        """Folds the log of those events that have periods worth it; other events' files are not touched.

        The folded rows carry a number of their own, and a barrier of the same number hides all that was before. A directory
        goes once barriers hide every event in it.
        """
        self._check(True)
        self.flush()
        out = CompactStats()
        ops, barriers = self._ops(), self._barriers()
        touched = oplog.changed_since(ops.where(F.col("event").isin(events)), barriers).where("puts > 1 OR removes > 0").collect()  # a row a period
        if not touched:
            self.config.metrics.compaction_completed(0, 0, 0, 0)
            return out
        with self._whole():
            work = sorted({r["event"] for r in touched})
            inside = F.col("event").isin(work)
            as_of = self._next_seq()
            folded = oplog.fold(ops.where(inside), barriers).select(F.lit(as_of).cast("long").alias("op_seq"), F.lit("put").alias("op"), *oplog.KEY, "id")
            before = sum(map(self.files.size, self.manifest["ops"]))
            place = self._save_ops(folded)
            kinds = "event string, gran string, period_key string, n long, as_of_seq long"
            counts = self._read_ops([place]).groupBy("event", "gran", "period_key").agg(F.count("*").alias("n")).withColumn("as_of_seq", F.lit(as_of).cast("long"))
            old = self.manifest["stats"]
            self.manifest["stats"] = self._save(counts.unionByName(self._read([old], kinds).where(~inside)) if old else counts)
            hidden = dict.fromkeys(work, as_of)
            self.manifest["barriers"] = [x for x in self.manifest["barriers"] if x[1] not in hidden] + [[as_of, e, None, None] for e in work]
            whole = {x[1]: x[0] for x in self.manifest["barriers"] if x[2] is None}
            gone = [x for x, seq in self.manifest["ops"].items() if x != place and all(whole.get(e, -1) > seq for e in self._events_in(x))]
            for x in gone:
                del self.manifest["ops"][x]
            self._retire(old, *gone)
            for r in touched:
                out.periods_compacted += 1
                out.parts_merged += r["puts"]
                out.deltas_applied += r["removes"]
                at = f"{r['event']}/{r['gran']}/{r['period_key']}"
                state = self.manifest["states"].get(at, "open")
                self.manifest["states"][at] = "compacted"
                self.config.metrics.period_state_changed(r["event"], P.parse_period_key(r["period_key"]), state, "compacted")
            self._commit()
        out.bytes_reclaimed = max(0, before - sum(map(self.files.size, self.manifest["ops"])))
        self.vacuum()
        self.config.metrics.compaction_completed(out.periods_compacted, out.parts_merged, out.deltas_applied, out.bytes_reclaimed)
        return out

    def health(self) -> Health:
        self._check()
        per = oplog.changed_since(self._ops(pending=False), self._barriers())
        row = per.agg(F.sum("puts"), F.sum("removes"), F.count_if(F.expr("puts > 1 OR removes > 0")), F.count("*")).first()
        states = list(self.manifest["states"].values())
        closed, compacted = states.count("closed"), states.count("compacted")
        pending = sum(rows for *_, rows in self.pending)
        return Health(True, pending * 8, len(self.pending), len(self.manifest["events"]), row[0] or 0, row[1] or 0, max(0, row[3] - closed - compacted), closed, compacted, row[2], sum(map(self.files.size, self.manifest["ops"])))
