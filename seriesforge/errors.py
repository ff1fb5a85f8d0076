"""Errors raised by the engine."""


class SubmissionError(ValueError):
    """A batch that cannot be accepted: bad code, malformed key, duplicate key."""


class CommitConflict(RuntimeError):
    """Another writer committed the version this one was about to make."""


class QueryError(ValueError):
    """A search request that cannot be turned into a query."""


class ExportError(RuntimeError):
    """A result that cannot be expressed in the requested wire format."""


class NothingToExport(ExportError):
    """The filter matched no observation."""
