"""Statements and predicates of the query language."""

from __future__ import annotations

from dataclasses import dataclass


class Predicate:
    pass


@dataclass(frozen=True)
class Compare(Predicate):
    field: str
    op: str
    value: str


@dataclass(frozen=True)
class Between(Predicate):
    field: str
    low: str
    high: str


@dataclass(frozen=True)
class Contains(Predicate):
    field: str
    query: str


@dataclass(frozen=True)
class Near(Predicate):
    lat: float
    lon: float
    radius: float


@dataclass(frozen=True)
class Within(Predicate):
    min_lat: float
    min_lon: float
    max_lat: float
    max_lon: float


@dataclass(frozen=True)
class And(Predicate):
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Or(Predicate):
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Not(Predicate):
    of: Predicate


@dataclass(frozen=True)
class Select:
    index: str
    columns: tuple[str, ...] = ()
    where: Predicate | None = None
    order: tuple[str, bool] | None = None  # field, descending
    limit: int | None = None


@dataclass(frozen=True)
class Insert:
    index: str
    key: str
    value: str


@dataclass(frozen=True)
class Update:
    index: str
    value: str
    where: Predicate | None = None


@dataclass(frozen=True)
class Delete:
    index: str
    where: Predicate | None = None


Statement = Select | Insert | Update | Delete


def conjuncts(p: Predicate | None) -> list[Predicate]:
    """The predicates of a top-level AND chain."""
    if p is None:
        return []
    return conjuncts(p.left) + conjuncts(p.right) if isinstance(p, And) else [p]
