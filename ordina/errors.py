"""Errors of the library; Spark's own exceptions surface as they are."""


class OrdinaError(Exception):
    """Any error of this library."""


class NoSortKeys(OrdinaError, ValueError):
    """No sort key was given where one is needed."""


class SchemaMismatch(OrdinaError, ValueError):
    """A batch or run has another schema than was fixed."""


class WriterClosed(OrdinaError, RuntimeError):
    """A writer was used after it was finished."""
