"""Distances with units."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import UnitError

_FOOT, _SURVEY = 0.3048, 1200 / 3937
#: Metres in one of each; the first name of a unit is its own.
LENGTHS: dict[str, tuple[float, tuple[str, ...]]] = {
    "meters": (1.0, ("m", "meter", "metre", "metres")),
    "kilometers": (1000.0, ("km", "kilometer", "kilometre", "kilometres")),
    "decimeters": (0.1, ("dm", "decimeter", "decimetre", "decimetres")),
    "centimeters": (0.01, ("cm", "centimeter", "centimetre", "centimetres")),
    "millimeters": (0.001, ("mm", "millimeter", "millimetre", "millimetres")),
    "feet": (_FOOT, ("ft", "foot", "international feet", "international foot", "feet international")),
    "us survey feet": (_SURVEY, ("us feet", "us foot", "us survey foot", "ftus", "feet us")),
    "yards": (3 * _FOOT, ("yd", "yard", "yards international")),
    "us survey yards": (3 * _SURVEY, ("yards us", "us yards")),
    "miles": (5280 * _FOOT, ("mi", "mile", "miles international", "statute miles", "statute mile")),
    "us survey miles": (5280 * _SURVEY, ("miles us", "us miles")),
    "nautical miles": (1852.0, ("nm", "nmi", "nautical mile", "nautical miles international")),
    "us nautical miles": (1853.248, ("nautical miles us",)),
    "inches": (_FOOT / 12, ("in", "inch")),
}
ANGLES = ("decimal degrees", "decimal degree", "degrees", "degree", "deg", "dd")
#: Square metres in one of each.
AREAS: dict[str, float] = {
    **{f"square {n}": f * f for n, (f, _) in LENGTHS.items()},
    **{f"square {a}": f * f for f, aliases in LENGTHS.values() for a in aliases if a.endswith((" international", " us"))},
    "hectares": 1e4,
    "ares": 100.0,
    "acres": 43_560 * _FOOT**2,
    "acres international": 43_560 * _FOOT**2,
    "acres us": 43_560 * _SURVEY**2,
}
_FACTORS = {alias: factor for name, (factor, aliases) in LENGTHS.items() for alias in (name, *aliases)}


@dataclass(frozen=True)
class Distance:
    """A value and its unit: a linear one, or decimal degrees."""

    value: float
    unit: str = "meters"

    @property
    def angular(self) -> bool:
        return self.unit.casefold().replace("_", " ") in ANGLES

    @property
    def meters(self) -> float:
        if self.angular:
            raise UnitError("degrees have no length without a place")
        return self.value * length_factor(self.unit)

    def __str__(self) -> str:
        return f"{self.value:g} {self.unit}"


def length_factor(unit: str) -> float:
    """Metres in one ``unit``."""
    try:
        return _FACTORS[unit.strip().casefold().replace("_", " ")]
    except KeyError:
        raise UnitError(f"unknown unit of length: {unit!r}") from None


def area_factor(unit: str) -> float:
    """Square metres in one ``unit``."""
    try:
        return AREAS[unit.strip().casefold().replace("_", " ")]
    except KeyError:
        raise UnitError(f"unknown unit of area: {unit!r}") from None


def parse(value: Distance | float | int | str) -> Distance | float:
    """A distance of a literal: objects and plain numbers stay, ``'12 km'`` is taken apart."""
    if isinstance(value, (Distance, int, float)) and not isinstance(value, bool):
        return value
    found = re.fullmatch(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*(\S.*?)?\s*", str(value))
    if not found:
        raise UnitError(f"not a distance: {value!r}")
    number, unit = float(found[1]), found[2]
    if unit is None:
        return number
    unit = unit.casefold().replace("_", " ")
    if unit not in ANGLES:
        length_factor(unit)
    return Distance(number, unit)


def meters_of(column: Column) -> Column:
    """Metres of a column of strings such as ``12 km``; null where they can't be parsed, a bare number being metres."""
    text = F.lower(F.trim(column.cast("string")))
    number = F.regexp_extract(text, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)\s*(.*)$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)\s*(.*)$", 2)
    table = F.create_map(*[F.lit(x) for pair in _FACTORS.items() for x in pair])
    found = number * F.when(unit == "", F.lit(1.0)).otherwise(F.element_at(table, unit))
    return F.when(~F.isnan(found) & (F.abs(found) < float("inf")), found)
