"""Errors of the engine; each is a kind of ValueError or KeyError."""


class EngineError(ValueError):
    """A request that the engine refuses."""


class TableExists(EngineError):
    """The table's name is taken."""


class TableNotFound(EngineError, KeyError):
    """No table has this name."""


class UnknownColumn(EngineError):
    """The table has no such column."""


class InvalidDefinition(EngineError):
    """A table's declaration is incomplete or contradicts itself."""


class UnsupportedType(EngineError):
    """A type outside the eight logical ones, or one that an operation doesn't take."""


class SchemaMismatch(EngineError):
    """A file doesn't fit the table it is loaded into."""


class InvalidQuery(EngineError):
    """A query that can't be read or makes no sense."""
