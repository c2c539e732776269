"""The query language.

    FROM entity [WHERE cond] { BRANCH n | AS OF "date" | ORDER BY f [ASC|DESC] | OFFSET n | LIMIT n }
    cond    := primary [(AND | OR) cond]        equal precedence, to the right
    primary := '(' cond ')' | name op value
    op      := = != >= <= > < CONTAINS MATCH
    value   := number | "string" | TRUE | FALSE | [value, ...]

Keywords are case-insensitive. Clauses follow WHERE in this order of groups: BRANCH and AS OF (either first), ORDER BY,
OFFSET and LIMIT (either first), each once at most. What is left over is an error, never ignored.
"""

from __future__ import annotations

import datetime as dt
import json
import re

from ..errors import EmptyQuery, ParseError
from . import filters as f
from .query import Page, Query, Scope, Sort

TOKEN = re.compile(
    r"""\s+|(?P<string>"(?:[^"\\]|\\.)*")|(?P<number>-?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?(?![A-Za-z0-9._]))|(?P<name>[A-Za-z0-9._]+)|(?P<op>!=|>=|<=|=|>|<)|(?P<mark>[()\[\],])""", re.S
)
COMPARE = {"=": f.eq, "!=": f.ne, ">": f.gt, ">=": f.ge, "<": f.lt, "<=": f.le, "CONTAINS": f.contains, "MATCH": f.matches}
#: The groups of clauses, in order.
GROUPS = (("BRANCH", "AS"), ("ORDER",), ("OFFSET", "LIMIT"))


class _Tokens:
    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            if m.lastgroup:
                self.items.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.items[i] if i < len(self.items) else ("end", "")

    def next(self) -> tuple[str, str]:
        out = self.peek()
        self.at += 1
        return out

    def word(self, ahead: int = 0) -> str:
        kind, text = self.peek(ahead)
        return text.upper() if kind == "name" else ""

    def expect(self, what: str) -> None:
        kind, text = self.next()
        if text.upper() != what or kind == "string":
            raise ParseError(f"{what} is missing before {text or 'the end'!r}")


def parse(text: str) -> Query:
    if not text.strip():
        raise EmptyQuery("the query is empty")
    t = _Tokens(text)
    t.expect("FROM")
    entity = _name(t)
    where = None
    if t.word() == "WHERE":
        t.next()
        where = _condition(t)
    found: dict[str, object] = {}
    group = 0
    while t.peek()[0] != "end":
        clause = t.word()
        at = next((i for i, g in enumerate(GROUPS) if clause in g), None)
        if at is None or at < group or clause in found:
            raise ParseError(f"unexpected {t.peek()[1]!r}")
        group = at
        t.next()
        found[clause] = _CLAUSES[clause](t)
    if "BRANCH" in found and "AS" not in found:
        raise ParseError("BRANCH needs AS OF")
    scope = Scope(found["AS"], found.get("BRANCH")) if "AS" in found else None
    page = Page(found.get("OFFSET", Page.start), found.get("LIMIT", Page.size))
    return Query(entity, where, found.get("ORDER"), scope, page)


def _name(t: _Tokens) -> str:
    kind, text = t.next()
    if kind not in ("name", "number") or not re.fullmatch(r"[A-Za-z0-9._]+", text):
        raise ParseError(f"a name is missing before {text or 'the end'!r}")
    return text


def _condition(t: _Tokens) -> f.Filter:
    # Chains lean to the right; they are gathered first, so that long ones don't nest calls.
    parts, joins = [_primary(t)], []
    while t.word() in ("AND", "OR"):
        joins.append(t.next()[1].upper())
        parts.append(_primary(t))
    out = parts.pop()
    while parts:
        out = (f.all_of if joins.pop() == "AND" else f.any_of)(parts.pop(), out)
    return out


def _primary(t: _Tokens) -> f.Filter:
    if t.peek() == ("mark", "("):
        t.next()
        out = _condition(t)
        t.expect(")")
        return out
    field = _name(t)
    op = t.next()[1].upper()
    if op not in COMPARE:
        raise ParseError(f"unknown operator {op!r}")
    return COMPARE[op](field, _value(t))


def _value(t: _Tokens):
    kind, text = t.next()
    if kind == "number":
        return float(text)
    if kind == "string":
        return _string(text)
    if kind == "name" and text.upper() in ("TRUE", "FALSE"):
        return text.upper() == "TRUE"
    if text == "[":
        out = []
        while t.peek()[1] != "]":
            out.append(_value(t))
            if t.peek() == ("mark", ","):
                t.next()
            elif t.peek() != ("mark", "]"):
                raise ParseError("an array isn't closed")
        t.next()
        return tuple(out)
    raise ParseError(f"a value is missing before {text or 'the end'!r}")


def _string(text: str) -> str:
    try:
        return json.loads(text, strict=False)
    except ValueError:
        raise ParseError(f"the string {text} has an unknown escape") from None


def _count(t: _Tokens) -> int:
    kind, text = t.next()
    if kind != "number" or not text.isdecimal():
        raise ParseError(f"a whole number is missing before {text or 'the end'!r}")
    return int(text)


def _as_of(t: _Tokens) -> dt.date:
    t.expect("OF")
    kind, text = t.next()
    try:
        if kind != "string":
            raise ValueError
        return dt.date.fromisoformat(_string(text))
    except ValueError:
        raise ParseError(f"AS OF needs an ISO 8601 date in quotes, not {text!r}") from None


def _order(t: _Tokens) -> Sort:
    t.expect("BY")
    field = _name(t)
    if t.word() in ("ASC", "DESC"):
        return Sort(field, t.next()[1].upper() == "DESC")
    return Sort(field)


_CLAUSES = {"BRANCH": _count, "AS": _as_of, "ORDER": _order, "OFFSET": _count, "LIMIT": _count}
