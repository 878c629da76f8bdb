"""Errors by kind, as callers tell them apart."""


class StoreError(Exception):
    """Any error of the store."""


class ValidationError(StoreError):
    """A request that is wrong whatever the data are."""


class ConditionFailed(StoreError):
    """A write whose condition doesn't hold."""


class DuplicateItem(StoreError):
    """An insert of an item that exists."""


class ResourceNotFound(StoreError):
    """A table, index, stream or version that isn't there."""


class ResourceInUse(StoreError):
    """A table or snapshot name that is taken, or a table under deletion protection."""


class IdempotencyMismatch(StoreError):
    """A token used again with another request."""


class TransactionCanceled(StoreError):
    """An all-or-nothing request that was refused; ``reasons`` has one entry per action ('' where it was fine)."""

    def __init__(self, reasons: list[str]) -> None:
        super().__init__("transaction canceled: " + ", ".join(r or "None" for r in reasons))
        self.reasons = reasons
