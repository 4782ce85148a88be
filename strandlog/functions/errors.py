"""Errors that the log raises; each suggests an HTTP status."""

from __future__ import annotations


class LogError(Exception):
    http_status = 500


class UsageError(LogError):
    """A call that can never work."""


class ConflictError(LogError):
    http_status = 409

    def __init__(self, expected: int, actual: int):
        super().__init__(f"context changed: expected version {expected}, actual {actual}")
        self.expected, self.actual = expected, actual


class UniqueViolationError(LogError):
    """A unique path or an idempotency key is taken. The message never repeats the value."""

    http_status = 409

    def __init__(self, type_: str | None = None, path: str | None = None, idempotency_key: bool = False):
        super().__init__("idempotency key already used" if idempotency_key else f"unique violation on {type_}.{path}")
        self.type, self.path, self.idempotency_key = type_, path, idempotency_key


class ValidationError(LogError):
    http_status = 400

    def __init__(self, type_: str, issues: list[str]):
        super().__init__(f"{type_} is invalid: {'; '.join(issues)}")
        self.type, self.issues = type_, issues


class UnindexableContextError(LogError):
    http_status = 500


class TransientError(LogError):
    http_status = 503


class StalePageError(TransientError):
    """Records were erased while a page of them was folded; the page must be read again."""


class PolicyViolationError(LogError):
    http_status = 403


class TenantMismatchError(LogError):
    http_status = 403


class ContextTooLargeError(LogError):
    http_status = 422


class WatchOverflowError(LogError):
    http_status = 503


class FailedKeyError(LogError):
    http_status = 500

    def __init__(self, model: str, key: str, failed: dict):
        super().__init__(f"model {model} failed for a key at sequence {failed.get('sequence')}: {failed.get('error')}")
        self.model, self.key, self.failed = model, key, failed


class NotConfiguredError(LogError):
    pass


def http_status_of(error: BaseException) -> int:
    return error.http_status if isinstance(error, LogError) else 500
