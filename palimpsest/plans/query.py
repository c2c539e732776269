"""Searches and facet requests as values; an Engine runs them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from .filters import Filter

#: Items of a page where none is asked for.
PAGE_SIZE = 500


@dataclass(frozen=True)
class Sort:
    """One field; ties by rising id and items without the field last, whatever the direction."""

    field: str
    descending: bool = False

    def desc(self) -> Sort:
        return replace(self, descending=True)

    def asc(self) -> Sort:
        return replace(self, descending=False)


@dataclass(frozen=True)
class Page:
    start: int = 0
    size: int = PAGE_SIZE


@dataclass(frozen=True)
class Scope:
    """Deltas of one branch (None: main) up to a date, that day's included."""

    date: dt.date
    branch: int | None = None

    @property
    def branch_key(self) -> int:
        """0 for main, n + 1 for branch n."""
        return 0 if self.branch is None else self.branch + 1


@dataclass(frozen=True)
class Query:
    """FROM entity [WHERE filter] [scope] [sort] [page]."""

    entity: str
    filter: Filter | None = None
    sort: Sort | None = None
    scope: Scope | None = None
    page: Page = Page()

    @staticmethod
    def parse(text: str) -> Query:
        from .parser import parse

        return parse(text)

    def where(self, f: Filter) -> Query:
        return replace(self, filter=f)

    def order_by(self, field: str, descending: bool = False) -> Query:
        return replace(self, sort=Sort(field, descending))

    def as_of(self, date, branch: int | None = None) -> Query:
        return replace(self, scope=Scope(dt.date.fromisoformat(date) if isinstance(date, str) else date, branch))

    def paged(self, start: int = 0, size: int = PAGE_SIZE) -> Query:
        return replace(self, page=Page(start, size))

    def run(self, engine):
        """The page of items, in order."""
        return engine.query(self)

    def hits(self, engine):
        """All matching items, as a set: neither sorted nor paged."""
        return engine.hits(self)

    def options(self, engine):
        """Facets of the matching items; sort and page play no part."""
        return engine.options(self)
