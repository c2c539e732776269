"""Filter trees, frozen and comparable, with their builders."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


class Filter:
    def __and__(self, other: Filter) -> Filter:
        return all_of(self, other)

    def __or__(self, other: Filter) -> Filter:
        return any_of(self, other)

    def __invert__(self) -> Filter:
        return negate(self)

    def fields(self) -> frozenset[str]:
        """Fields that the filter refers to."""
        todo, out = [self], set()
        while todo:
            match todo.pop():
                case And(parts) | Or(parts):
                    todo += parts
                case Not(part):
                    todo.append(part)
                case Leaf(_, field, _):
                    out.add(field)
        return frozenset(out)


@dataclass(frozen=True)
class Leaf(Filter):
    """op: eq, between (a pair), gt, ge, lt, le, contains or match."""

    op: str
    field: str
    value: Any


@dataclass(frozen=True)
class And(Filter):
    """No parts: no rows."""

    parts: tuple[Filter, ...]


@dataclass(frozen=True)
class Or(Filter):
    """No parts: no rows."""

    parts: tuple[Filter, ...]


@dataclass(frozen=True)
class Not(Filter):
    """The complement: rows without the field are in it."""

    part: Filter


def eq(field: str, value) -> Filter:
    return Leaf("eq", field, value)


def ne(field: str, value) -> Filter:
    return Not(Leaf("eq", field, value))


def between(field: str, low, high) -> Filter:
    """Both ends are in; an empty interval has no rows."""
    return Leaf("between", field, (low, high))


def gt(field: str, value) -> Filter:
    return Leaf("gt", field, value)


def ge(field: str, value) -> Filter:
    return Leaf("ge", field, value)


def lt(field: str, value) -> Filter:
    return Leaf("lt", field, value)


def le(field: str, value) -> Filter:
    return Leaf("le", field, value)


def contains(field: str, word) -> Filter:
    return Leaf("contains", field, word)


def matches(field: str, phrase) -> Filter:
    return Leaf("match", field, phrase)


def all_of(*parts: Filter) -> Filter:
    return And(tuple(parts))


def any_of(*parts: Filter) -> Filter:
    return Or(tuple(parts))


def negate(part: Filter) -> Filter:
    return Not(part)
