"""Units: aliases, equality and the conversions that are never done silently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that mean the same unit.
UNIT_ALIASES = {"mg/dl": "mg/dL", "MG/DL": "mg/dL", "mmol/l": "mmol/L", "MMOL/L": "mmol/L", "g/l": "g/L", "G/L": "g/L", "percent": "%", "pct": "%"}


class UnitMismatchError(ValueError):
    """Two units that are not the same and have no conversion."""


def normalized(unit: str) -> str:
    return UNIT_ALIASES.get(unit.strip(), unit.strip())


def normalized_column(unit: Column) -> Column:
    pairs = [F.lit(x) for pair in UNIT_ALIASES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.trim(unit)), F.trim(unit))


def check_units(a: str, b: str) -> None:
    if a and b and normalized(a) != normalized(b):
        raise UnitMismatchError(f"units {a!r} and {b!r} differ")


def converted(value: Column, source: str, target: str, molar_mass: float | None = None, factor: float | None = None) -> Column:
    """value in the target unit; raises while the plan is built if there is no way to convert."""
    a, b = normalized(source), normalized(target)
    if a == b:
        return value
    if factor is not None:
        return value * factor
    if (a, b) == ("mg/dL", "mmol/L") and molar_mass:
        return value * 10.0 / molar_mass
    if (a, b) == ("mmol/L", "mg/dL") and molar_mass:
        return value * molar_mass / 10.0
    if (a, b) == ("g/L", "mg/dL"):
        return value * 100.0
    if (a, b) == ("mg/dL", "g/L"):
        return value / 100.0
    raise UnitMismatchError(f"no conversion from {source!r} to {target!r}")
