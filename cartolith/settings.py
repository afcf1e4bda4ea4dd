"""Analysis settings: an immutable value, passed explicitly or set for a block of code."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, replace
from enum import StrEnum


class OutputOption(StrEnum):
    """What becomes of Z or M values on output."""

    SAME = "same"
    ENABLED = "enabled"
    DISABLED = "disabled"


@dataclass(frozen=True)
class Extent:
    """A window of coordinates. Given the wrong way round, its bounds are swapped; it is false if not finite."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float
    crs: str | None = None

    @classmethod
    def from_bounds(cls, x0: float, y0: float, x1: float, y1: float, crs: str | None = None) -> Extent:
        return cls(min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1), crs)

    def __bool__(self) -> bool:
        bounds = (self.xmin, self.ymin, self.xmax, self.ymax)
        return all(abs(v) < float("inf") for v in bounds) and self.xmax > self.xmin and self.ymax > self.ymin


@dataclass(frozen=True)
class Settings:
    overwrite: bool = False
    xy_tolerance: float | None = None
    z_value: float = 0.0
    output_z_option: OutputOption = OutputOption.SAME
    output_m_option: OutputOption = OutputOption.SAME
    current_workspace: str | None = None
    scratch_workspace: str | None = None
    scratch_folder: str | None = None
    output_coordinate_system: str | None = None
    geographic_transformations: tuple = ()
    extent: Extent | None = None


_current: ContextVar[Settings] = ContextVar("cartolith_settings", default=Settings())


def current() -> Settings:
    return _current.get()


@contextmanager
def use(**changes):
    """Settings changed for the block."""
    token = _current.set(replace(_current.get(), **changes))
    try:
        yield _current.get()
    finally:
        _current.reset(token)


def tolerance(argument: float | None, settings: Settings | None = None) -> float | None:
    """The argument if given, else the setting; never negative."""
    value = argument if argument is not None else (settings or current()).xy_tolerance
    return None if value is None else max(0.0, float(value))


def zm(option: OutputOption, *has: bool) -> bool:
    """Whether an output has Z (or M) values, given those of its inputs."""
    return {OutputOption.SAME: any(has), OutputOption.ENABLED: True, OutputOption.DISABLED: False}[option]
