"""Errors that abort a query. Failures of single rows are columns, not exceptions."""


class FieldloomError(Exception):
    """Base of all errors of this package."""


class SchemaError(FieldloomError):
    """A schema can't be used."""


class DiscoveryError(FieldloomError):
    """No schema could be discovered."""


class ExtractionError(FieldloomError):
    """Extraction failed, and was asked to fail as a whole."""


class NormalizationError(FieldloomError):
    """A value, field or strategy can't be normalized."""


class ProviderError(FieldloomError):
    """A model provider failed."""

    def __init__(self, message: str, retryable: bool = False):
        super().__init__(message)
        self.retryable = retryable


class BudgetExceededError(FieldloomError):
    """Spending passed the limit."""

    def __init__(self, spent, limit):
        super().__init__(f"spent {spent:.4f} of a limit of {limit:.4f} USD")
        self.spent, self.limit = spent, limit
