"""Errors and warnings of the tools. All errors derive from ``Exception``."""


class CartolithError(Exception):
    """Base of all errors."""


class ArgumentError(CartolithError, ValueError):
    """An argument has the wrong type or value."""


class OperationsError(CartolithError):
    """A tool can't do what is asked: bad predicate, existing target."""


class FieldError(CartolithError):
    """A field is missing, protected, or of the wrong type."""


class GeometryTypeError(CartolithError):
    """A layer's shape type doesn't fit the tool."""


class DimensionError(CartolithError):
    """The topological dimensions of two layers don't fit each other."""


class CoordinateSystemError(CartolithError):
    """A coordinate system is unknown, unsupported or doesn't fit."""


class ContainerError(CartolithError):
    """A workspace or table is missing or exists already."""


class UnitError(CartolithError):
    """A distance can't be understood."""


class CartolithWarning(UserWarning):
    """Base of all warnings."""


class EmptyResultWarning(CartolithWarning):
    """A result has no rows (only with eager checks)."""


class SkippedRowsWarning(CartolithWarning):
    """Rows were left out, such as those with distances that can't be parsed."""


class TransformWarning(CartolithWarning):
    """A coordinate transformation was guessed."""
