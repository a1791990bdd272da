"""Errors of the engine."""


class EngineError(Exception):
    """Any error that the engine raises itself."""

    code = "ENGINE"


class QueryError(EngineError, ValueError):
    code = "QUERY"


class UnknownModelError(EngineError, KeyError):
    code = "UNKNOWN_MODEL"


class UnknownFormatError(EngineError, ValueError):
    code = "UNKNOWN_FORMAT"


class NotStoredError(EngineError, KeyError):
    code = "NOT_STORED"


class BudgetExceededError(EngineError, ValueError):
    code = "BUDGET_EXCEEDED"


class EncodingError(EngineError, ValueError):
    code = "ENCODING"


class DecodingError(EngineError, ValueError):
    code = "DECODING"


class ValidationError(EngineError, ValueError):
    code = "VALIDATION"


class TokenizerVersionError(EngineError, ValueError):
    code = "TOKENIZER_VERSION"


class StorageError(EngineError, OSError):
    code = "STORAGE"


class DatasetNotFoundError(EngineError, KeyError):
    code = "DATASET_NOT_FOUND"


class WindowExceededError(BudgetExceededError):
    code = "WINDOW_EXCEEDED"


class InjectionError(EngineError, ValueError):
    code = "INJECTION"


class StreamingError(EngineError, RuntimeError):
    code = "STREAMING"
