"""Typed errors of the engine."""

from __future__ import annotations


class CatalogError(Exception):
    """Base of the engine's errors; code is the name that a caller can switch on."""

    code = "internal"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


class InvalidRequest(CatalogError):
    code = "invalid_request"


class NotFound(CatalogError):
    code = "not_found"


class InvariantViolation(CatalogError):
    """A batch would break the state's rules; nothing of it is published."""

    code = "invariant"


class CheckpointGap(CatalogError):
    """The journal no longer holds what follows the checkpoint: a reconciliation scan is needed."""

    code = "checkpoint_gap"


class AlreadyExists(CatalogError):
    code = "already_exists"


class SchemaMismatch(CatalogError):
    code = "schema_mismatch"


class CapacityExceeded(CatalogError):
    code = "capacity"


class QuerySyntax(InvalidRequest):
    code = "query_syntax"
