"""User functions: registered with the facts a statement needs, applied like built-in ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from pathloom.functions.scalar import REGISTRY, Function
from pathloom.values import Typed


def register(name: str, build: Callable[[list[Typed]], Typed], least: int, most: int | None = None, pure: bool = True) -> None:
    """Register a function built from columns (a pandas UDF may be called inside ``build``)."""
    REGISTRY[name.lower()] = Function(name.lower(), least, most, build, pure)


def unregister(name: str) -> None:
    """Forget a registered function."""
    REGISTRY.pop(name.lower(), None)


def standard_deviation(a: list[Typed]) -> Typed:
    """Population standard deviation of a list of numbers; null for an empty list."""
    x = F.transform(a[0].col, lambda v: v.cast("double"))
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.nullif(n, F.lit(0))
    return Typed(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / F.nullif(n, F.lit(0))), "float")


register("standard_deviation", standard_deviation, 1, 1)
