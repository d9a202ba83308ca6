"""Functions of bands by name: each takes the columns of the roles it needs and gives a column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BandFunction:
    name: str
    roles: tuple[str, ...]
    of: Callable[..., Column]

    def missing(self, have: set[str]) -> list[str]:
        """Roles that bands of these roles don't fill."""
        return [r for r in self.roles if r not in have]


_KNOWN: dict[str, BandFunction] = {}


def register_band_function(name: str, roles: tuple[str, ...], of: Callable[..., Column]) -> BandFunction:
    """Make a function of bands known by name; a name is taken once."""
    if name in _KNOWN:
        raise ValueError(f"a band function {name!r} is known already")
    if not roles or len(set(roles)) != len(roles):
        raise ValueError(f"band function {name!r}: roles must be given, each once")
    _KNOWN[name] = BandFunction(name, tuple(roles), of)
    return _KNOWN[name]


def band_functions() -> list[BandFunction]:
    return list(_KNOWN.values())


def band_function(name: str, columns: dict[str, Column]) -> Column:
    """The function's column from the columns of roles; roles that are missing are named."""
    f = _KNOWN.get(name)
    if f is None:
        raise KeyError(f"no band function {name!r}; known: {', '.join(_KNOWN)}")
    if lack := f.missing(set(columns)):
        raise ValueError(f"{name} needs {', '.join(lack)}")
    return f.of(*[columns[r] for r in f.roles])


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), null unless the sum is above zero."""
    return F.when(a + b > 0, (a - b).cast("double") / (a + b).cast("double"))


register_band_function("ndvi", ("nir", "red"), normalised_difference)
register_band_function("ndwi", ("green", "nir"), normalised_difference)
register_band_function("cross_ratio", ("co", "cross"), lambda co, cross: F.when((co > 0) & (cross > 0), 10 * F.log10(co.cast("double") / cross.cast("double"))))
