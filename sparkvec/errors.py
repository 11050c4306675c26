"""Errors by the class that callers of the reference interface expect."""


class InvalidArgument(ValueError):
    """An argument out of its range."""


class DimensionMismatch(ValueError):
    """A vector or matrix of another width than the collection's."""


class IdOutOfRange(ValueError):
    """An id that no vector has."""


class Corrupt(RuntimeError):
    """Stored state that contradicts itself, or an operation that the stored state doesn't allow."""
