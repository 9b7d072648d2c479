"""Errors of the engine."""


class EngineError(Exception):
    """Base of all errors raised by the package."""


class DimensionError(EngineError):
    """A vector's length differs from the corpus dimension."""


class SchemaError(EngineError):
    """A table lacks what an operation needs."""


class EngineClosedError(EngineError):
    """The engine was used after it was closed."""


class EmbeddingError(EngineError):
    """What an embedder returned are no vectors."""


class VectorBackendError(EngineError):
    """A vector strategy is unknown or unusable."""
