"""Errors, each with a context of named details."""

from __future__ import annotations

from typing import Any


class GridError(Exception):
    """Base of all errors: a message and a context."""

    def __init__(self, message: str, **context: Any):
        super().__init__(message)
        self.message = message
        self.context = {k: v for k, v in context.items() if v is not None}

    def __str__(self) -> str:
        details = ", ".join(f"{k}={v}" for k, v in self.context.items())
        return f"{self.message} ({details})" if details else self.message

    def to_dict(self) -> dict[str, Any]:
        return {"error_type": type(self).__name__, "message": self.message, "context": dict(self.context)}


class FileError(GridError):
    """The file is missing or can't be read."""


class FormatError(GridError):
    """The content isn't what it should be."""


class StructureError(GridError):
    """The sheet's structure can't be made out."""


class NormalizationError(GridError):
    """Values can't be cleaned."""


class FormulaError(GridError):
    """A formula can't be evaluated."""


class CircularReferenceError(FormulaError):
    """Formulas refer to one another in a circle."""

    def __init__(self, cells: list[str], **context: Any):
        super().__init__("Circular reference: " + " -> ".join(cells), **context)
        self.cells = cells


class UnsupportedFunctionError(FormulaError):
    """A formula uses a function that the evaluator doesn't know."""
