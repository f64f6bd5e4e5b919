"""Set expressions: a small tree of references, and, or, and difference, compiled to a single scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.periods import Period


class SetExpr:
    def __and__(self, other: SetExpr) -> SetExpr:
        return And(self, other)

    def __or__(self, other: SetExpr) -> SetExpr:
        return Or(self, other)

    def __sub__(self, other: SetExpr) -> SetExpr:
        return Diff(self, other)


@dataclass(frozen=True)
class Ref(SetExpr):
    event: str
    period: Period


@dataclass(frozen=True)
class And(SetExpr):
    a: SetExpr
    b: SetExpr


@dataclass(frozen=True)
class Or(SetExpr):
    a: SetExpr
    b: SetExpr


@dataclass(frozen=True)
class Diff(SetExpr):
    a: SetExpr
    b: SetExpr


def refs(expr: SetExpr) -> list[Ref]:
    """Distinct references, in order of appearance."""
    if isinstance(expr, Ref):
        return [expr]
    return list(dict.fromkeys(refs(expr.a) + refs(expr.b)))


def is_ref(ref: Ref) -> Column:
    return (F.col("event") == ref.event) & (F.col("gran") == ref.period.gran) & (F.col("period_key") == ref.period.key)


def one_of(keys: list[Ref]) -> Column:
    """Rows of any of the references: an OR of equalities, which Parquet scans can prune by."""
    return reduce(lambda a, b: a | b, map(is_ref, keys), F.lit(False))


def _predicate(expr: SetExpr, flags: dict[Ref, Column]) -> Column:
    if isinstance(expr, Ref):
        return flags[expr]
    a, b = _predicate(expr.a, flags), _predicate(expr.b, flags)
    if isinstance(expr, And):
        return a & b
    return a | b if isinstance(expr, Or) else a & ~b


def evaluate(members: DataFrame, expr: SetExpr) -> DataFrame:
    """The ids of an expression over members (event, gran, period_key, id).

    One filter, one aggregation with a flag a reference, one filter on the flags: a single shuffle, by id. That is
    enough as there is no complement, so every id of the result is in some referenced set.
    """
    keys = refs(expr)
    flags = members.where(one_of(keys)).groupBy("id").agg(*[F.bool_or(is_ref(r)).alias(f"f{i}") for i, r in enumerate(keys)])
    return flags.where(_predicate(expr, {r: F.col(f"f{i}") for i, r in enumerate(keys)})).select("id")
