"""Errors that callers can tell apart."""


class EngineError(Exception):
    """Any error of this package."""


class ConfigError(EngineError):
    """A configuration is malformed or asks for something unknown."""


class FeedError(EngineError):
    """Tick data are missing or unreadable."""
