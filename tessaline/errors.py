"""Errors that callers can tell apart."""


class EngineError(ValueError):
    """A request that the engine refuses."""


class InvalidRequest(EngineError):
    """A missing or malformed argument."""


class NotFound(EngineError):
    """No such key, entry or table."""


class Conflict(EngineError):
    """An entry key that another entry has."""
