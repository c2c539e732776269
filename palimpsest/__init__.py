"""A Spark-native search engine over declared fields, with facets and what-if overlays."""

from .engine import Engine, Entity
from .errors import EmptyQuery, EngineError, EntityAlreadyExists, EntityNotFound, InvalidInput, MissingIndex, MissingTermIndex, ParseError, UnknownEnumValue, UnsupportedOperation
from .operators.deltas import Change
from .plans.filters import all_of, any_of, between, contains, eq, ge, gt, le, lt, matches, ne, negate
from .plans.query import Page, Query, Scope, Sort
from .types import Bool, Date, Enum, Numeric, String

__all__ = [
    "Bool", "Change", "Date", "EmptyQuery", "Engine", "EngineError", "Entity", "EntityAlreadyExists", "EntityNotFound", "Enum", "InvalidInput", "MissingIndex", "MissingTermIndex", "Numeric", "Page", "ParseError",
    "Query", "Scope", "Sort", "String", "UnknownEnumValue", "UnsupportedOperation", "all_of", "any_of", "between", "contains", "eq", "ge", "gt", "le", "lt", "matches", "ne", "negate",
]
