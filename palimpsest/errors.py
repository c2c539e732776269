"""Errors of the engine; ParseError and its kin are about query strings."""


class EngineError(Exception):
    """Base of all errors raised on purpose."""


class EntityNotFound(EngineError):
    pass


class EntityAlreadyExists(EngineError):
    pass


class MissingIndex(EngineError):
    """A filter, sort or delta names a field without a declaration."""


class MissingTermIndex(EngineError):
    """CONTAINS or MATCH on a string that isn't declared with terms."""


class InvalidInput(EngineError):
    """A value of the wrong type for the field."""


class UnsupportedOperation(EngineError):
    """The operator isn't defined for the field's type."""


class UnknownEnumValue(EngineError):
    pass


class ParseError(EngineError):
    """The query string isn't valid."""


class EmptyQuery(ParseError):
    pass
