"""Registered queries of the set engine over the driver's tables, and the SQL that they are compared with.

Facts: ME, users by event type and time; MO, customers by order priority and date; MS, customers by market
segment (static sets); MI, customers for as long as an order was open; MD, a dictionary of customer names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import periods as P
from tidemark.functions.periods import Period
from tidemark.operators import bitmaps, dictionary, oplog, sets
from tidemark.plans.expr import Diff, Ref, SetExpr, evaluate, refs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DAY = Period.of_day(2024, 1, 5)
WEEK = [Period.of_day(2024, 1, d) for d in range(1, 8)]
HOUR_RANGE = (Period.of_hour(2024, 1, 5, 22), Period.of_hour(2024, 1, 6, 3))
OPEN_RANGE = (Period.of_day(1997, 3, 28), Period.of_day(1997, 4, 3))


def query(sql: str | None, name: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def me(spark: SparkSession, sf_dir: str, gran: str = "day", rollup: str = "none", only: list[Ref] | None = None, repeats: bool = False) -> DataFrame:
    return sets.membership(read(spark, sf_dir, "events"), F.col("event_type"), F.col("user_id"), F.col("ts"), gran, rollup, only, repeats)


def asked(spark: SparkSession, sf_dir: str, expr: SetExpr) -> DataFrame:
    """The facts of ME that an expression refers to, repeats and all."""
    return me(spark, sf_dir, only=refs(expr), repeats=True)


def mo(spark: SparkSession, sf_dir: str, gran: str = "year", only: list[Ref] | None = None, repeats: bool = False) -> DataFrame:
    return sets.membership(read(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.col("o_custkey"), F.col("o_orderdate"), gran, "none", only, repeats)


def ms(spark: SparkSession, sf_dir: str, only: list[Ref] | None = None, repeats: bool = False) -> DataFrame:
    return sets.membership(read(spark, sf_dir, "customer"), F.col("c_mktsegment"), F.col("c_custkey"), only=only, repeats=repeats)


def mo_ms(spark: SparkSession, sf_dir: str, expr: SetExpr) -> DataFrame:
    """The facts of MO and MS that an expression refers to, timed and static sets, repeats and all."""
    timed, static = ([r for r in refs(expr) if bool(r.period.rank) == x] for x in (True, False))
    return mo(spark, sf_dir, only=timed, repeats=True).unionByName(ms(spark, sf_dir, static, repeats=True))


def md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary that assigning all customer names in order of key gives."""
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("ext_id"))
    return dictionary.numbered(dictionary.first_seen(names), 0)


def log(spark: SparkSession, sf_dir: str, gran: str = "day", rollup: str = "none") -> DataFrame:
    """An operation log of one event: signups put a user, errors remove it, in order of event_id."""
    facts = read(spark, sf_dir, "events").where("event_type IN ('signup', 'error')")
    op = F.when(F.col("event_type") == "signup", "put").otherwise("remove")
    return oplog.ops_from_facts(facts, F.col("event_id"), op, F.lit("account"), F.col("user_id"), F.col("ts"), gran, rollup)


def barriers(spark: SparkSession, *rows: tuple) -> DataFrame:
    return sets.literal_table(spark, list(rows), oplog.BARRIERS)


_DAY = "date_trunc('day', ts)"
_ME = "SELECT DISTINCT event_type AS event, strftime(ts, '%Y-%m-%d') AS k, user_id AS id FROM events"
_SET = "SELECT DISTINCT user_id AS id FROM events WHERE event_type = '{}' AND strftime(ts, '%Y-%m-%d') = '2024-01-05'"
VIEW, CLICK, ERROR = (_SET.format(x) for x in ("view", "click", "error"))
_NESTED = f"({VIEW}) INTERSECT (({CLICK}) EXCEPT ({ERROR}))"
LEVELS = "SELECT unnest(['hour', 'day', 'month', 'year']) AS gran"
KEY_OF = "CASE gran WHEN 'hour' THEN strftime({0}, '%Y-%m-%dT%H') WHEN 'day' THEN strftime({0}, '%Y-%m-%d') WHEN 'month' THEN strftime({0}, '%Y-%m') ELSE strftime({0}, '%Y') END"
KEY_TS = KEY_OF.format("ts")


def nested() -> Ref:
    return Ref("view", DAY) & (Ref("click", DAY) - Ref("error", DAY))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(asked(spark, sf_dir, nested()), nested())


# reads


@query(VIEW)
def get_day(spark, sf_dir):
    return sets.get(me(spark, sf_dir, only=[Ref("view", DAY)]), "view", DAY)


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def get_static(spark, sf_dir):
    return sets.get(ms(spark, sf_dir, [Ref("BUILDING", Period.static())]), "BUILDING", Period.static())


@query("SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS period_start, strftime(ts, '%Y-%m-%d') AS period_key, user_id AS id FROM events WHERE event_type = 'click' AND ts >= '2024-01-05' AND ts < '2024-01-09'")
def get_range_day(spark, sf_dir):
    return sets.get_range(me(spark, sf_dir, only=[Ref("click", DAY), Ref("click", Period.of_day(2024, 1, 8))]), "click", DAY, Period.of_day(2024, 1, 8)).withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@query("SELECT user_id AS id FROM events WHERE event_type = 'nothing'")
def get_missing_empty(spark, sf_dir):
    return sets.get(me(spark, sf_dir), "nothing", DAY)


@query("SELECT user_id AS id FROM events WHERE event_type = 'nothing'")
def get_range_reversed_empty(spark, sf_dir):
    return sets.get_range(me(spark, sf_dir), "click", Period.of_day(2024, 1, 8), DAY).select("id")


@query(f"SELECT * FROM (VALUES ('view', '2024-01-05'), ('view', '2023-01-05'), ('none', '2024-01-05')) v(event, period_key), LATERAL (SELECT count(*) > 0 AS found FROM ({_ME}) WHERE event = v.event AND k = v.period_key)")
def exists_flags(spark, sf_dir):
    keys = [Ref("view", DAY), Ref("view", Period.of_day(2023, 1, 5)), Ref("none", DAY)]
    return sets.exists(me(spark, sf_dir, only=keys, repeats=True), keys)


@query(f"SELECT pos, id, id IN ({VIEW}) AS found FROM (SELECT range AS pos, (range * 7) % 200 AS id FROM range(0, 40))")
def contains_batch(spark, sf_dir):
    probe = spark.range(0, 40).select(F.col("id").alias("pos"), (F.col("id") * 7 % 200).alias("id"))
    return sets.contains_batch(me(spark, sf_dir, only=[Ref("view", DAY)]), "view", DAY, probe)


_PROBE = "SELECT range AS pos, printf('Customer#%09d', range * 3) AS ext_id FROM range(0, 120)"
_BUILDING = "SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING'"


def _names(spark):
    return spark.range(0, 120).select(F.col("id").alias("pos"), F.format_string("Customer#%09d", F.col("id") * 3).alias("ext_id"))


def _by_id(spark, sf_dir) -> DataFrame:
    """MS with the dictionary's ids in place of customer keys."""
    names = read(spark, sf_dir, "customer").join(md(spark, sf_dir), F.col("c_name") == F.col("ext_id"))
    return sets.membership(names, F.col("c_mktsegment"), F.col("id"))


@query(f"SELECT pos, ext_id, ext_id IN ({_BUILDING}) AS found FROM ({_PROBE})")
def contains_ids_batch(spark, sf_dir):
    return sets.contains_ids_batch(_by_id(spark, sf_dir), md(spark, sf_dir), "BUILDING", Period.static(), _names(spark))


# counts


@query(f"SELECT event, k AS period_key, count(*) AS n FROM ({_ME}) GROUP BY ALL")
def cardinality_all(spark, sf_dir):
    return sets.cardinality(me(spark, sf_dir)).select("event", "period_key", "n")


@query(f"SELECT count(*) AS n FROM ({CLICK})")
def cardinality_one(spark, sf_dir):
    return sets.cardinality_of(me(spark, sf_dir, only=[Ref("click", DAY)]), "click", DAY)


@query(f"SELECT k AS period_key, count(*) AS n FROM ({_ME}) WHERE event = 'view' AND k BETWEEN '2024-01-03' AND '2024-01-12' GROUP BY ALL")
def cardinality_range_day(spark, sf_dir):
    return sets.cardinality_range(me(spark, sf_dir, only=[Ref("view", Period.of_day(2024, 1, d)) for d in (3, 12)]), "view", Period.of_day(2024, 1, 3), Period.of_day(2024, 1, 12)).select("period_key", "n")


@query("SELECT strftime(ts, '%Y-%m-%dT%H') AS period_key, count(DISTINCT user_id) AS n FROM events WHERE event_type = 'view' AND ts >= '2024-01-05 22:00' AND ts < '2024-01-06 04:00' GROUP BY ALL")
def cardinality_range_hour(spark, sf_dir):
    return sets.cardinality_range(me(spark, sf_dir, "hour", only=[Ref("view", p) for p in HOUR_RANGE]), "view", *HOUR_RANGE).select("period_key", "n")


@query(f"SELECT count(*) AS n FROM (({VIEW}) INTERSECT ({CLICK}))")
def intersect_card(spark, sf_dir):
    a, b = Ref("view", DAY), Ref("click", DAY)
    return sets.intersect_cardinality(asked(spark, sf_dir, a & b), a, b)


@query(f"SELECT count(*) AS n FROM (({VIEW}) UNION ({CLICK}))")
def union_card(spark, sf_dir):
    a, b = Ref("view", DAY), Ref("click", DAY)
    return sets.union_cardinality(asked(spark, sf_dir, a | b), a, b)


@query("SELECT count(*) AS n FROM ((SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1997) INTERSECT (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))")
def intersect_card_orders_segment(spark, sf_dir):
    a, b = Ref("1-URGENT", Period.of_year(1997)), Ref("BUILDING", Period.static())
    return sets.intersect_cardinality(mo_ms(spark, sf_dir, a & b), a, b)


_WEEK = "SELECT user_id AS id, strftime(ts, '%Y-%m-%d') AS k FROM events WHERE event_type = 'view' AND ts >= '2024-01-01' AND ts < '2024-01-08'"
_UNION_WEEK = f"SELECT count(DISTINCT id) AS n FROM ({_WEEK})"
_INTERSECT_WEEK = f"SELECT count(*) AS n FROM (SELECT id FROM ({_WEEK}) GROUP BY id HAVING count(DISTINCT k) = 7)"
_WEEK_KEYS = [Ref("view", d) for d in WEEK]


@query(_UNION_WEEK)
def union_many(spark, sf_dir):
    return sets.union_cardinality_many(me(spark, sf_dir, only=_WEEK_KEYS, repeats=True), _WEEK_KEYS)


@query(_INTERSECT_WEEK)
def intersect_many(spark, sf_dir):
    return sets.intersect_cardinality_many(me(spark, sf_dir, only=_WEEK_KEYS), [*_WEEK_KEYS, _WEEK_KEYS[0]])


@query("SELECT 0::BIGINT AS n")
def union_many_of_none(spark, sf_dir):
    return sets.union_cardinality_many(me(spark, sf_dir), [])


@query(_UNION_WEEK)
def union_many_bitmap(spark, sf_dir):
    return bitmaps.union_cardinality_many(bitmaps.build_buckets(me(spark, sf_dir, only=_WEEK_KEYS, repeats=True)), _WEEK_KEYS)


@query(_INTERSECT_WEEK)
def intersect_many_bitmap(spark, sf_dir):
    return bitmaps.intersect_cardinality_many(bitmaps.build_buckets(me(spark, sf_dir, only=_WEEK_KEYS, repeats=True)), _WEEK_KEYS)


@query("SELECT c_mktsegment AS event, c_custkey AS id FROM customer")
def bitmap_round_trip(spark, sf_dir):
    return bitmaps.bucket_ids(bitmaps.build_buckets(ms(spark, sf_dir))).select("event", "id")


# expressions


@query(f"({VIEW}) INTERSECT ({CLICK})")
def expr_and(spark, sf_dir):
    expr = Ref("view", DAY) & Ref("click", DAY)
    return evaluate(asked(spark, sf_dir, expr), expr)


@query(f"({VIEW}) UNION ({CLICK})")
def expr_or(spark, sf_dir):
    expr = Ref("view", DAY) | Ref("click", DAY)
    return evaluate(asked(spark, sf_dir, expr), expr)


@query(f"({VIEW}) EXCEPT ({CLICK})")
def expr_diff(spark, sf_dir):
    expr = Ref("view", DAY) - Ref("click", DAY)
    return evaluate(asked(spark, sf_dir, expr), expr)


@query(_NESTED)
def expr_nested(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(
    "((SELECT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1996) UNION (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH' AND year(o_orderdate) = 1997)) EXCEPT (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')"
)
def expr_orders_segment(spark, sf_dir):
    expr = Diff(Ref("1-URGENT", Period.of_year(1996)) | Ref("2-HIGH", Period.of_year(1997)), Ref("MACHINERY", Period.static()))
    return evaluate(mo_ms(spark, sf_dir, expr), expr)


@query(f"SELECT count(*) AS n FROM ({_NESTED})")
def expr_cardinality(spark, sf_dir):
    return sets.expression_cardinality(asked(spark, sf_dir, nested()), nested())


@query(f"({VIEW}) INTERSECT ({CLICK})", "raw_intersect")
def _raw_intersect(spark, sf_dir):
    m = asked(spark, sf_dir, Ref("view", DAY) & Ref("click", DAY))
    return sets.get(m, "view", DAY).intersect(sets.get(m, "click", DAY))


@query(f"({VIEW}) EXCEPT ({CLICK})", "raw_subtract")
def _raw_subtract(spark, sf_dir):
    m = asked(spark, sf_dir, Ref("view", DAY) & Ref("click", DAY))
    return sets.get(m, "view", DAY).subtract(sets.get(m, "click", DAY))


# rollup and the operation log


@query(f"SELECT event_type AS event, gran, {KEY_TS} AS period_key, count(DISTINCT user_id) AS n FROM events, ({LEVELS}) GROUP BY ALL")
def rollup_auto(spark, sf_dir):
    return sets.cardinality(me(spark, sf_dir, "hour", "auto")).select("event", "gran", "period_key", "n")


@query("SELECT event_type AS event, 'hour' AS gran, strftime(ts, '%Y-%m-%dT%H') AS period_key, count(DISTINCT user_id) AS n FROM events GROUP BY ALL")
def rollup_none(spark, sf_dir):
    return sets.cardinality(me(spark, sf_dir, "hour")).select("event", "gran", "period_key", "n")


@query(f"SELECT DISTINCT event_type AS event, g.gran, strftime(date_trunc('month', ts), '%Y-%m-%d') AS child, {KEY_TS} AS period_key FROM events, ({LEVELS}) g WHERE gran IN ('month', 'year')")
def rollup_ancestors(spark, sf_dir):
    """The distinct coarser buckets of a list of buckets."""
    facts = read(spark, sf_dir, "events").select("event_type", F.date_trunc("month", "ts").alias("m"))
    rows = facts.select(F.col("event_type").alias("event"), F.date_format("m", "yyyy-MM-dd").alias("child"), F.inline(P.levels(F.col("m"), "month", "auto")))
    return rows.select("event", "gran", "child", "period_key").distinct()


_LOG = "SELECT strftime(ts, '%Y-%m-%d') AS period_key, user_id AS id, event_id, event_type FROM events WHERE event_type IN ('signup', 'error')"
_FOLD = f"SELECT period_key, id FROM ({_LOG}) GROUP BY ALL HAVING arg_max(event_type, event_id) = 'signup'"


@query(_FOLD)
def lww_fold(spark, sf_dir):
    return oplog.fold(log(spark, sf_dir)).select("period_key", "id")


@query(f"SELECT gran, {KEY_TS} AS period_key, user_id AS id FROM events, ({LEVELS}) WHERE event_type IN ('signup', 'error') GROUP BY ALL HAVING arg_max(event_type, event_id) = 'signup'")
def rollup_erasure(spark, sf_dir):
    """A remove erases from coarser buckets even where a sibling bucket still has the id."""
    return oplog.fold(log(spark, sf_dir, "hour", "auto")).select("gran", "period_key", "id")


@query(f"SELECT period_key, id FROM ({_LOG}) GROUP BY ALL HAVING arg_max(event_type, event_id) = 'signup' AND count(*) FILTER (event_type = 'error') > 0")
def reinsert_after_remove(spark, sf_dir):
    ops = log(spark, sf_dir)
    removed = ops.where("op = 'remove'").select("period_key", "id").distinct()
    return oplog.fold(ops).select("period_key", "id").join(removed, ["period_key", "id"], "left_semi")


_MID = 5000


@query(f"SELECT period_key, id FROM ({_LOG}) WHERE period_key <> '2024-01-05' OR event_id >= {_MID} GROUP BY ALL HAVING arg_max(event_type, event_id) = 'signup' UNION SELECT '2024-01-05', unnest([7, 1000007])")
def replace_barrier(spark, sf_dir):
    """A bucket replaced by {7, 1000007} just before operation 5000."""
    new = sets.literal_table(spark, [(7,), (1000007,)], "id long").select(
        F.lit(_MID).cast("long").alias("op_seq"), F.lit("put").alias("op"), F.lit("account").alias("event"), F.lit("day").alias("gran"), F.lit(DAY.start).cast("timestamp").alias("period_start"), F.lit(DAY.key).alias("period_key"), "id"
    )
    ops = log(spark, sf_dir).where(~((F.col("op_seq") >= _MID) & (F.col("period_key") == DAY.key) & F.col("id").isin(7, 1000007))).unionByName(new)
    return oplog.fold(ops, barriers(spark, (_MID, "account", "day", DAY.key))).select("period_key", "id")


@query(f"SELECT period_key, id FROM ({_LOG}) WHERE period_key <> '2024-01-05' GROUP BY ALL HAVING arg_max(event_type, event_id) = 'signup'")
def delete_period(spark, sf_dir):
    return oplog.fold(log(spark, sf_dir), barriers(spark, (10**12, "account", "day", DAY.key))).select("period_key", "id")


@query(f"SELECT period_key, id FROM ({_LOG}) WHERE period_key >= '2024-01-05' GROUP BY ALL HAVING arg_max(event_type, event_id) = 'signup'")
def retain_periods(spark, sf_dir):
    ops = log(spark, sf_dir)
    every = [P.parse_period_key(r["period_key"]) for r in ops.select("period_key").distinct().collect()]  # a row a period
    gone = [p for p in every if not p >= DAY]
    rows = [(10**12, "account", p.gran, p.key) for p in gone] or [(0, "account", "day", "-")]
    return oplog.fold(ops, barriers(spark, *rows)).select("period_key", "id")


@query(f"SELECT event, count(*) AS n FROM ({_ME}) WHERE event <> 'view' GROUP BY ALL")
def drop_event(spark, sf_dir):
    ops = oplog.ops_from_facts(read(spark, sf_dir, "events"), F.col("event_id"), F.lit("put"), F.col("event_type"), F.col("user_id"), F.col("ts"), "day")
    return oplog.fold(ops, barriers(spark, (10**12, "view", None, None))).groupBy("event").agg(F.count("*").alias("n"))


_INTERVALS = "SELECT DISTINCT o_custkey AS id, o_orderpriority AS event, o_orderdate AS a, l_shipdate AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate"
_OPEN = f"SELECT event, id, unnest(generate_series(greatest(date_trunc('day', a), TIMESTAMP '1997-03-28'), least(date_trunc('day', b), TIMESTAMP '1997-04-03'), INTERVAL 1 DAY)) AS d FROM ({_INTERVALS}) WHERE a < TIMESTAMP '1997-04-04' AND b >= TIMESTAMP '1997-03-28'"


def intervals(spark, sf_dir) -> DataFrame:
    """MI: (event, id, a, b), one row for each time that a customer's order was open.

    The lines of an order all begin with it, so the last one covers the others.
    """
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("l_shipdate"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    return both.select(F.col("o_orderpriority").alias("event"), F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("a"), F.col("l_shipdate").alias("b"))


def _open(spark, sf_dir) -> DataFrame:
    return oplog.interval_buckets(intervals(spark, sf_dir), F.col("a"), F.col("b"), "day", within=(OPEN_RANGE[0].start, OPEN_RANGE[1].start))


@query(f"SELECT event, strftime(d, '%Y-%m-%d') AS period_key, count(DISTINCT id) AS n FROM ({_OPEN}) GROUP BY ALL")
def range_put_occupancy(spark, sf_dir):
    members = _open(spark, sf_dir).select("event", "gran", "period_start", "period_key", "id").distinct()
    return sets.cardinality(members).select("event", "period_key", "n")


@query(f"SELECT strftime(d, '%Y-%m-%d') AS period_key, count(DISTINCT id) AS n FROM ({_OPEN}) WHERE event = '1-URGENT' AND NOT (d BETWEEN '1997-03-30' AND '1997-04-01' AND id % 2 = 0) GROUP BY ALL")
def range_remove(spark, sf_dir):
    """Even customers are taken out of a part of the interval."""
    puts = _open(spark, sf_dir).where("event = '1-URGENT'").select(F.lit(1).cast("long").alias("op_seq"), F.lit("put").alias("op"), "event", "gran", "period_start", "period_key", "id").distinct()
    even = intervals(spark, sf_dir).where("event = '1-URGENT' AND id % 2 = 0").select("event", "id").distinct()
    gone = even.withColumns({"a": F.to_timestamp(F.lit("1997-03-30")), "b": F.to_timestamp(F.lit("1997-04-01"))})
    removes = oplog.interval_buckets(gone, F.col("a"), F.col("b"), "day").select(F.lit(2).cast("long").alias("op_seq"), F.lit("remove").alias("op"), "event", "gran", "period_start", "period_key", "id")
    return sets.cardinality(oplog.fold(puts.unionByName(removes))).select("period_key", "n")


@query("SELECT event, gran, period_key, count(DISTINCT id) AS n FROM (SELECT DISTINCT event, id, unnest(generate_series(date_trunc('day', a), date_trunc('day', b), INTERVAL 1 DAY)) AS d FROM (" + _INTERVALS + ")) t, LATERAL (SELECT gran, " + KEY_OF.format("d") + " AS period_key FROM (" + LEVELS + ") WHERE gran <> 'hour') GROUP BY ALL")
def range_put_rollup(spark, sf_dir):
    """All intervals from end to end, with all coarser buckets once."""
    return oplog.interval_counts(intervals(spark, sf_dir), F.col("a"), F.col("b"), "day", "auto")


# dictionary


@query("SELECT c_name AS ext_id, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer")
def dict_assign(spark, sf_dir):
    return md(spark, sf_dir)


_DICT = "SELECT c_name AS ext_id, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer"


@query(f"SELECT pos, ext_id, id FROM ({_PROBE}) LEFT JOIN ({_DICT}) USING (ext_id)")
def dict_lookup_batch(spark, sf_dir):
    return dictionary.lookup_batch(md(spark, sf_dir), _names(spark))


def _probe_ids(spark):
    return spark.range(0, 100).select(F.col("id").alias("pos"), (F.col("id") * 31 % 1700).alias("id"))


@query(f"SELECT pos, id, ext_id FROM (SELECT range AS pos, range * 31 % 1700 AS id FROM range(0, 100)) LEFT JOIN ({_DICT}) USING (id)")
def dict_resolve_batch(spark, sf_dir):
    return dictionary.resolve_batch(md(spark, sf_dir), _probe_ids(spark))


@query(f"SELECT DISTINCT id, ext_id FROM (SELECT range * 31 % 1700 AS id FROM range(0, 100)) JOIN ({_DICT}) USING (id)")
def dict_resolved_pairs(spark, sf_dir):
    return dictionary.resolved_pairs(md(spark, sf_dir), _probe_ids(spark))


@query(f"SELECT ext_id, id FROM ({_DICT}) WHERE ext_id NOT IN (SELECT ext_id FROM ({_PROBE}))")
def dict_delete(spark, sf_dir):
    return dictionary.without(md(spark, sf_dir), _names(spark)).select("ext_id", "id")


@query("SELECT format('{:032x}', c_custkey)[1:8] || '-' || format('{:032x}', c_custkey)[9:12] || '-' || format('{:032x}', c_custkey)[13:16] || '-' || format('{:032x}', c_custkey)[17:20] || '-' || format('{:032x}', c_custkey)[21:32] AS ext_id FROM customer")
def dict_uuid_canonical(spark, sf_dir):
    hex32 = F.upper(F.lpad(F.lower(F.hex("c_custkey")), 32, "0"))
    return read(spark, sf_dir, "customer").select(dictionary.canonical_uuid(hex32).alias("ext_id"))


@query(_BUILDING.replace("c_name", "c_name AS ext_id"))
def get_ids(spark, sf_dir):
    return sets.get_ids(_by_id(spark, sf_dir), md(spark, sf_dir), "BUILDING", Period.static())


@query(_BUILDING.replace("c_name", "c_name AS ext_id"))
def export_ids(spark, sf_dir):
    members = _by_id(spark, sf_dir)
    return sets.export_ids(sets.get(members, "BUILDING", Period.static()), md(spark, sf_dir))


# reverse lookups


def _users(spark, sf_dir) -> DataFrame:
    """A dictionary of users: u0, u1, ... for user_id 0, 1, ..."""
    return read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("ext_id"), F.col("user_id").alias("id")).distinct()


@query(f"SELECT event, 'day' AS gran, k AS period_key FROM ({_ME}) WHERE id = 0")
def find_memberships(spark, sf_dir):
    return sets.find_memberships(me(spark, sf_dir), _users(spark, sf_dir), "u0")


@query(f"SELECT p.pos, p.ext_id, coalesce(count(id), 0) AS n, string_agg(event || '/' || k, ',' ORDER BY event, k) AS keys FROM (SELECT range AS pos, 'u' || (range * 30) AS ext_id FROM range(0, 10)) p LEFT JOIN ({_ME}) m ON p.ext_id = 'u' || m.id GROUP BY p.pos, p.ext_id")
def find_memberships_batch(spark, sf_dir):
    probe = spark.range(0, 10).select(F.col("id").alias("pos"), F.concat(F.lit("u"), F.col("id") * 30).alias("ext_id"))
    found = sets.find_memberships_batch(me(spark, sf_dir), _users(spark, sf_dir), probe)
    keys = F.array_join(F.transform("memberships", lambda m: F.concat_ws("/", m["event"], m["period_key"])), ",")
    return found.select("pos", "ext_id", F.size("memberships").cast("long").alias("n"), F.when(F.size("memberships") > 0, keys).alias("keys"))


@query(f"SELECT id, count(*) AS n, string_agg(event || '/day/' || k, ',' ORDER BY event, k) AS memberships FROM ({_ME}) GROUP BY id")
def inverted_index(spark, sf_dir):
    return sets.inverted_index(me(spark, sf_dir)).withColumn("memberships", F.array_join("memberships", ","))


@query(f"SELECT event, k AS period_key, count(*) AS n, (SELECT count(*) FROM ({_ME}) WHERE id = 7) AS removed FROM ({_ME}) WHERE id <> 7 GROUP BY ALL")
def delete_entity(spark, sf_dir):
    """An entity taken out of every set by removes, and how many sets it was in."""
    members = me(spark, sf_dir)
    puts = members.select(F.lit(1).cast("long").alias("op_seq"), F.lit("put").alias("op"), *oplog.KEY, "id")
    own = members.where("id = 7")
    removes = own.select(F.lit(2).cast("long").alias("op_seq"), F.lit("remove").alias("op"), *oplog.KEY, "id")
    left = sets.cardinality(oplog.fold(puts.unionByName(removes))).select("event", "period_key", "n")
    return left.join(F.broadcast(own.agg(F.count("*").alias("removed")).withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one")).drop("_one")


# administration


@query(_FOLD)
def compact_state(spark, sf_dir):
    """The fold of a log of which one half was compacted before."""
    ops = log(spark, sf_dir)
    early = oplog.fold(ops.where(F.col("op_seq") < _MID)).select(F.lit(_MID - 1).cast("long").alias("op_seq"), F.lit("put").alias("op"), *oplog.KEY, "id")
    return oplog.fold(early.unionByName(ops.where(F.col("op_seq") >= _MID))).select("period_key", "id")


@query(f"SELECT count(*) AS periods_compacted, sum(p)::BIGINT AS parts_merged, sum(r)::BIGINT AS deltas_applied FROM (SELECT period_key, count(*) FILTER (event_type = 'signup') AS p, count(*) FILTER (event_type = 'error') AS r FROM ({_LOG}) GROUP BY ALL) WHERE p > 1 OR r > 0")
def compact_stats(spark, sf_dir):
    touched = oplog.changed_since(log(spark, sf_dir)).where("puts > 1 OR removes > 0")
    return touched.agg(F.count("*").alias("periods_compacted"), F.sum("puts").alias("parts_merged"), F.sum("removes").alias("deltas_applied"))


@query(f"SELECT sum(p)::BIGINT AS data_parts, sum(r)::BIGINT AS delta_parts, count(*) AS periods, count(*) FILTER (p > 1 OR r > 0) AS needing FROM (SELECT period_key, count(*) FILTER (event_type = 'signup') AS p, count(*) FILTER (event_type = 'error') AS r FROM ({_LOG}) GROUP BY ALL)")
def health(spark, sf_dir):
    per = oplog.changed_since(log(spark, sf_dir))
    return per.agg(F.sum("puts").alias("data_parts"), F.sum("removes").alias("delta_parts"), F.count("*").alias("periods"), F.count_if(F.expr("puts > 1 OR removes > 0")).alias("needing"))


@query("SELECT DISTINCT event_type AS event FROM events")
def list_events(spark, sf_dir):
    return sets.list_events(me(spark, sf_dir))


@query(f"SELECT DISTINCT gran, {KEY_TS} AS period_key FROM events, ({LEVELS}) WHERE event_type = 'purchase'")
def list_periods(spark, sf_dir):
    return sets.list_periods(me(spark, sf_dir, "hour", "auto"), "purchase")


# period functions


@query(f"SELECT event_id, gran, {KEY_TS} AS period_key FROM events, ({LEVELS}) UNION ALL SELECT event_id, 'none', '_static' FROM events")
def period_keys(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "ts")
    every = F.array(*[P.period_struct(F.col("ts"), g) for g in P.GRANULARITIES])
    return rows.select("event_id", F.inline(every)).select("event_id", "gran", "period_key")


@query(f"SELECT DISTINCT strftime(ts, '%Y-%m-%dT%H') AS child, gran, {KEY_TS} AS period_key FROM events, ({LEVELS}) WHERE gran <> 'hour'")
def period_ancestors(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH").alias("child"), F.inline(P.levels(F.col("ts"), "hour", "auto")))
    return rows.where("gran <> 'hour'").select("child", "gran", "period_key").distinct()


@query(f"SELECT DISTINCT gran, {KEY_TS} AS period_key, TIMESTAMP '2024-01-15 12:30:00' >= CASE gran WHEN 'hour' THEN date_trunc('hour', ts) + INTERVAL 1 HOUR WHEN 'day' THEN date_trunc('day', ts) + INTERVAL 1 DAY WHEN 'month' THEN date_trunc('month', ts) + INTERVAL 1 MONTH ELSE date_trunc('year', ts) + INTERVAL 1 YEAR END AS closed FROM events, ({LEVELS})")
def period_closed(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.inline(P.levels(F.col("ts"), "hour", "auto"))).distinct()
    return rows.select("gran", "period_key", P.closed(F.col("period_start"), F.col("gran"), F.to_timestamp(F.lit("2024-01-15 12:30:00"))).alias("closed"))


_KEYS = ["_static", "2024", "2024-02", "2024-13", "2024-02-29", "2023-02-29", "2026-02-30T10", "2024-01-05T23", "2024-01-05T24", "24-01", "x", ""]


@query("SELECT k AS period_key, k = '_static' OR coalesce(regexp_matches(k, '^\\d{4}(-\\d{2}(-\\d{2}(T\\d{2})?)?)?$') AND try_strptime(k || CASE length(k) WHEN 4 THEN '-01-01T00' WHEN 7 THEN '-01T00' WHEN 10 THEN 'T00' ELSE '' END, '%Y-%m-%dT%H') IS NOT NULL, false) AS valid FROM (SELECT unnest([" + ", ".join(f"'{k}'" for k in _KEYS) + "]) AS k)")
def period_validate(spark, sf_dir):
    return sets.literal_table(spark, [(k,) for k in _KEYS], "period_key string").withColumn("valid", F.coalesce(P.valid_key(F.col("period_key")), F.lit(False)))


@query("SELECT DISTINCT o_orderkey, strftime(d, '%Y-%m') AS period_key FROM (SELECT o_orderkey, unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate + INTERVAL 75 DAY), INTERVAL 1 MONTH)) AS d FROM orders)")
def period_enumerate(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.expr("o_orderdate + INTERVAL 75 DAY").alias("b"))
    return oplog.interval_buckets(rows, F.col("o_orderdate"), F.col("b"), "month").select("o_orderkey", "period_key")


# exports


@query(_NESTED)
def export_u32(spark, sf_dir):
    return sets.export_u32(flagship(spark, sf_dir))


@query(_ME.replace("k,", "period_key,"))
def serialize_portable(spark, sf_dir):
    """Every set as portable bytes, decoded again."""
    packed = bitmaps.serialize_portable(me(spark, sf_dir), "event", "period_key")
    return bitmaps.decoded_ids(packed, "bytes")


@query("SELECT c_mktsegment AS event, max(CASE WHEN c_custkey = 42 THEN 1 ELSE 0 END) = 1 AS found FROM customer GROUP BY 1")
def serialized_contains(spark, sf_dir):
    packed = bitmaps.serialize_portable(ms(spark, sf_dir), "event")
    return bitmaps.serialized_contains(packed, "bytes", 42).select("event", "found")


# the store itself


def _stored(spark, sf_dir):
    """A store with the users of all events, by hour, rolled up."""
    from tidemark.streaming.ingest import write_batch

    store = _opened(spark, default_granularity="hour", default_rollup="auto")
    facts = read(spark, sf_dir, "events")
    rows = facts.select(F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("id"), F.lit("put").alias("op"))
    write_batch(store, "events", rows, 0)
    write_batch(store, "events", rows, 0)  # a replay changes nothing
    return store


def _changed(store):
    store.remove("view", Period.of_day(2024, 1, 2), [3, 5, 8])
    store.replace("click", Period.of_day(2024, 1, 3), [1, 2])
    store.compact()
    return store.members().select("event", "gran", "period_key", "id")


def _dropped(store):
    store.drop_event("click")
    store.retain_periods("view", lambda p: p >= Period.of_day(2024, 1, 2) and p.key >= "2024-01-02")
    return store.members().select("event", "gran", "period_key", "id")


_STORED = f"SELECT event_type AS event, gran, {KEY_TS} AS period_key, user_id AS id FROM events, ({LEVELS}) GROUP BY ALL"


@query(_STORED)
def store_ingest(spark, sf_dir):
    return _stored(spark, sf_dir).members().select("event", "gran", "period_key", "id")


@query(f"SELECT * FROM ({_STORED}) WHERE NOT (event = 'view' AND id IN (3, 5, 8) AND period_key IN ('2024-01-02', '2024-01', '2024')) AND NOT (event = 'click' AND period_key = '2024-01-03') UNION ALL SELECT 'click', 'day', '2024-01-03', unnest([1, 2])")
def store_remove_replace_compact(spark, sf_dir):
    """Some users removed from a day and what is above it, a day replaced, and all of it compacted."""
    return _changed(_stored(spark, sf_dir))


@query(f"SELECT * FROM ({_STORED}) WHERE event <> 'click' AND (event <> 'view' OR period_key >= '2024-01-02' AND gran <> 'hour')")
def store_drop_retain(spark, sf_dir):
    """An event dropped, and all periods of another before a day, and all its hours."""
    return _dropped(_stored(spark, sf_dir))


def _opened(spark, **options):
    """An empty store in the shared folder."""
    from tidemark.sources.scratch import scratch
    from tidemark.sources.store import Store

    return Store(spark, scratch(spark), **options)


def _customers(spark, sf_dir, where="true"):
    return read(spark, sf_dir, "customer").where(where).select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("ext_id"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT c_mktsegment AS event, '_static' AS period_key, c_name AS ext_id FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') AND c_nationkey <> 3")
def store_put_remove_ids(spark, sf_dir):
    """All customers put by name into their segments, those of a nation removed by name, with names nobody has."""
    store = _opened(spark)
    for segment in SEGMENTS:
        store.put_ids(segment, Period.static(), _customers(spark, sf_dir, f"c_mktsegment = '{segment}'"))
        store.remove_ids(segment, Period.static(), _customers(spark, sf_dir, "c_nationkey = 3").unionByName(sets.literal_table(spark, [(-1, "nobody")], "pos long, ext_id string")))
    return store.members().join(store.dictionary(), "id").select("event", "period_key", "ext_id")


@query("SELECT strftime(d, '%Y-%m-%d') AS period_key, c_name AS ext_id FROM customer, (SELECT unnest(generate_series(TIMESTAMP '2024-02-27', TIMESTAMP '2024-03-02', INTERVAL 1 DAY)) AS d) WHERE NOT (c_custkey % 7 = 0 AND d IN (TIMESTAMP '2024-02-28', TIMESTAMP '2024-02-29'))")
def store_put_remove_ids_range(spark, sf_dir):
    """All customers put by name into an interval of days, some removed from a part of it."""
    store = _opened(spark)
    store.put_ids_range("stay", Period.of_day(2024, 2, 27), Period.of_day(2024, 3, 2), _customers(spark, sf_dir))
    store.remove_ids_range("stay", Period.of_day(2024, 2, 28), Period.of_day(2024, 2, 29), _customers(spark, sf_dir, "c_custkey % 7 = 0"))
    rows = store.get_range("stay", Period.of_day(2024, 2, 1), Period.of_day(2024, 3, 31))
    return rows.join(store.dictionary(), "id").select("period_key", "ext_id")


@query(f"SELECT * FROM ({_STORED}) WHERE NOT (event = 'view' AND period_key IN ('2024-01-02', '2024-01-03', '2024-01')) UNION ALL SELECT 'view', 'day', '2024-01-02', unnest([7, 8, 9]) UNION ALL SELECT 'view', 'month', '2024-01', 4000000000")
def store_bulk_replace(spark, sf_dir):
    """Two days and a month of all events replaced in one commit, one of them by nothing."""
    store = _stored(spark, sf_dir)
    store.bulk_replace("view", [(Period.of_day(2024, 1, 2), [7, 8, 9]), (Period.of_day(2024, 1, 3), []), (Period.of_month(2024, 1), [4_000_000_000])])
    return store.members().select("event", "gran", "period_key", "id")


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


def _by_uuid(spark, sf_dir):
    store = _opened(spark)
    values = _customers(spark, sf_dir).withColumn("ext_id", F.upper(F.md5("ext_id")))
    store.put_uuids_range("u", Period.of_day(2024, 1, 1), Period.of_day(2024, 1, 3), values)
    store.put_uuids("u", Period.of_day(2024, 1, 5), values.where("pos % 2 = 0"))
    store.remove_uuids("u", Period.of_day(2024, 1, 1), values.where("pos % 3 = 0"))
    store.remove_uuids_range("u", Period.of_day(2024, 1, 2), Period.of_day(2024, 1, 5), values.where("pos % 5 = 0"))
    store.put_ids("u", Period.of_day(2024, 1, 1), ["no uuid"])
    return store


@query(f"SELECT 1 AS day, {_UUID} AS ext_id FROM (SELECT c_custkey AS k, md5(c_name) AS h FROM customer) WHERE k % 3 <> 0 UNION ALL SELECT 5, {_UUID} FROM (SELECT c_custkey AS k, md5(c_name) AS h FROM customer) WHERE k % 2 = 0 AND k % 5 <> 0")
def store_uuids(spark, sf_dir):
    """UUIDs of all customers put and removed, by day and by interval; a name that is none is not exported."""
    store = _by_uuid(spark, sf_dir)
    one = store.get_uuids("u", Period.of_day(2024, 1, 1)).select(F.lit(1).alias("day"), "ext_id")
    return one.unionByName(store.export_uuids(store.get("u", Period.of_day(2024, 1, 5))).select(F.lit(5).alias("day"), "ext_id"))


@query("SELECT c_name, c_custkey % 3 <> 0 AS found, ((c_custkey % 3 <> 0)::INT + 2 * (c_custkey % 5 <> 0)::INT + (c_custkey % 2 = 0 AND c_custkey % 5 <> 0)::INT)::BIGINT AS n FROM customer WHERE c_custkey <= 6 UNION ALL SELECT 'nobody', false, 0")
def store_uuid_lookups(spark, sf_dir):
    """Membership of a day, and all memberships, of the first customers' UUIDs."""
    import hashlib

    store, rows = _by_uuid(spark, sf_dir), []
    store.pin()
    for name in [r["ext_id"] for r in _customers(spark, sf_dir, "c_custkey <= 6").collect()] + ["nobody"]:
        value = hashlib.md5(name.encode()).hexdigest()
        rows.append((name, store.contains_uuid("u", Period.of_day(2024, 1, 1), value), store.find_memberships_uuid(value).count()))
    store.unpin()
    return sets.literal_table(spark, rows, "c_name string, found boolean, n long")


@query("SELECT c_name, c_mktsegment = 'BUILDING' AS found, (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS id, c_name AS back FROM customer QUALIFY c_custkey <= 5 UNION ALL SELECT 'nobody', false, NULL, NULL UNION ALL SELECT 'added', true, (SELECT count(*) FROM customer)::BIGINT, 'added'")
def store_lookups(spark, sf_dir):
    """Single lookups: membership by name, a name's id, an id's name; one name assigned by itself."""
    from tidemark.sources.dictionary_store import Dictionary

    store = _opened(spark)
    store._assigned(_customers(spark, sf_dir))
    store.put_ids("BUILDING", Period.static(), _customers(spark, sf_dir, "c_mktsegment = 'BUILDING'"))
    store.put_ids("BUILDING", Period.static(), ["added"])
    store.flush()
    words, rows = Dictionary(spark, store.path), []
    words.get_or_assign("added")
    for name in [r["ext_id"] for r in _customers(spark, sf_dir, "c_custkey <= 5").collect()] + ["nobody", "added"]:
        id = words.lookup(name)
        assert words.contains(name) == (id is not None)
        rows.append((name, store.contains_id("BUILDING", Period.static(), name), id, words.resolve(id) if id is not None else None))
    return sets.literal_table(spark, rows, "c_name string, found boolean, id long, back string")


@query("SELECT c_mktsegment AS event, c_custkey AS id FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')")
def store_auto_flush(spark, sf_dir):
    """All customers put into their segments; what a reader sees without any flush, each put being as large as the buffer."""
    from tidemark.sources.store import Store

    store = _opened(spark, flush_rows=1)
    for segment in SEGMENTS:
        store.put(segment, Period.static(), read(spark, sf_dir, "customer").where(F.col("c_mktsegment") == segment).select(F.col("c_custkey").alias("id")))
    return Store(spark, store.path, read_only=True).members().select("event", "id")


@query("SELECT * FROM (VALUES ('2024-01-02T04', 'compacted'), ('2024-01-02T05', 'closed'), ('2024-01-02', 'compacted')) t(period_key, state)")
def store_backfill_states(spark, sf_dir):
    """States of two hours and their day after a compaction of all events and a late write to one of the hours."""
    store = _stored(spark, sf_dir)
    hours = [Period.of_hour(2024, 1, 2, h) for h in (4, 5)]
    for hour in hours:
        store.remove("view", hour, [4_000_000_000])  # what a compaction has to fold
    store.compact()
    store.put("view", hours[1], [1])
    keys = [*hours, Period.of_day(2024, 1, 2)]
    return sets.literal_table(spark, [(p.key, store.manifest["states"].get(f"view/{p.gran}/{p.key}", "open")) for p in keys], "period_key string, state string")


@query("SELECT DISTINCT user_id AS id FROM events WHERE event_type IN ('view', 'click') AND ts >= '2024-01-05' AND ts < '2024-01-06'")
def store_query_serialize(spark, sf_dir):
    """A union from a store of all events as portable bytes, decoded again."""
    store = _stored(spark, sf_dir)
    raw = store.query_serialize(Ref("view", DAY) | Ref("click", DAY))
    return spark.createDataFrame([(i,) for i in bitmaps.decode(raw)], "id long")


@query("SELECT * FROM (VALUES ('click', 'hour', 'auto'), ('error', 'hour', 'auto'), ('monthly', 'month', 'none'), ('purchase', 'hour', 'auto'), ('signup', 'hour', 'auto'), ('still', 'none', 'none'), ('view', 'hour', 'auto')) t(name, finest, rollup)")
def store_registry(spark, sf_dir):
    """Events that were registered, and those that ingest of all events registered with the store's defaults."""
    store = _stored(spark, sf_dir)
    store.register_event("monthly", "month")
    store.register_event("still", "none", "auto")
    return sets.literal_table(spark, [(e.name, e.finest, e.rollup) for e in store.list_events()], "name string, finest string, rollup string")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
