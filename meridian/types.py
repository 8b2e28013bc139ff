"""Declared types of calculations and the Spark types that carry them."""

from __future__ import annotations

from dataclasses import dataclass

#: Grains of time and the coarser (or equal) ones that each can be put into.
GRAINS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
_CALENDAR = ("year", "quarter", "month")


def coarser(grain: str) -> list[str]:
    """Grains that a value of this grain can be truncated to."""
    if grain == "week":  # weeks cross months and quarters
        return ["year", "week"]
    if grain in _CALENDAR:
        return list(_CALENDAR[: _CALENDAR.index(grain) + 1])
    return list(GRAINS[: GRAINS.index(grain) + 1])


@dataclass(frozen=True)
class Type:
    name: str
    grain: str | None = None

    @property
    def spark(self) -> str:
        return {"bool": "boolean", "int": "bigint", "float": "double", "str": "string", "datetime": "timestamp_ntz"}[self.name]

    def __str__(self) -> str:
        return f"{self.name}:{self.grain}" if self.grain else self.name


def type_of(declared: str | Type) -> Type:
    """date and datetime are one type of different grain; either may name a grain, as in date:month."""
    if isinstance(declared, Type):
        return declared
    name, _, grain = declared.partition(":")
    if name in ("date", "datetime"):
        grain = grain or {"date": "day", "datetime": "second"}[name]
        if grain not in GRAINS:
            raise ValueError(f"unknown grain {grain!r}")
        return Type("datetime", grain)
    if name == "string":
        name = "str"
    if grain or name not in ("bool", "int", "float", "str"):
        raise ValueError(f"unknown type {declared!r}")
    return Type(name)
