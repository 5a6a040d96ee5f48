"""The one error users are meant to see."""


class EngineError(Exception):
    """A query, table or argument the engine can't accept, in words for the user."""
