"""Dashboard filters as values that turn into one Catalyst predicate."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcella import schema as S

ANY_TYPE = "any"


def _number(text: str | None) -> float | None:
    if not text:
        return None
    value = float(text)
    return int(value) if value.is_integer() else value


def _show(value: float | None) -> str:
    return "" if value is None else f"{value:g}" if isinstance(value, float) else str(value)


def between(value: Column, low: float | None, high: float | None) -> list[Column]:
    """Predicates for the bounds that are set."""
    bounds = []
    if low is not None:
        bounds.append(value >= low)
    if high is not None:
        bounds.append(value <= high)
    return bounds


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


@dataclass(frozen=True)
class Bbox:
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float

    def predicate(self) -> Column:
        """Rows inside the box; rows without coordinates fall out."""
        return F.col("latitude").between(self.lat_min, self.lat_max) & F.col("longitude").between(
            self.lon_min, self.lon_max
        )

    def clamp(self, other: Bbox) -> Bbox:
        """The part of this box inside ``other``."""
        return Bbox(
            max(self.lat_min, other.lat_min),
            min(self.lat_max, other.lat_max),
            max(self.lon_min, other.lon_min),
            min(self.lon_max, other.lon_max),
        )


# Generous box around metropolitan France and Corsica.
FRANCE = Bbox(40, 52, -7, 11)


def in_bbox(bbox: Bbox | None) -> Column:
    return F.lit(True) if bbox is None else bbox.predicate()


@dataclass(frozen=True)
class BuildingSpec:
    """Bounds that one building of a sale has to meet."""

    type: str = ANY_TYPE
    area_min: float | None = None
    area_max: float | None = None
    rooms_min: float | None = None
    rooms_max: float | None = None

    def matches(self, building: Column) -> Column:
        bounds = [] if self.type == ANY_TYPE else [building["type"] == self.type]
        bounds += between(building["area_m2"], self.area_min, self.area_max)
        bounds += between(building["rooms"], self.rooms_min, self.rooms_max)
        return all_of(bounds)


def building_specs(specs: tuple[BuildingSpec, ...]) -> Column:
    """Each distinct spec needs as many matching buildings as it is repeated.

    Different specs may be met by the same building.
    """
    return all_of(
        [F.size(F.filter("buildings", spec.matches)) >= n for spec, n in Counter(specs).items()]
    )


@dataclass(frozen=True)
class SaleFilter:
    """Conjunction of all dashboard filters; ``None`` leaves a bound open."""

    year_min: int = S.DEFAULT_YEARS[0]
    year_max: int = S.DEFAULT_YEARS[1]
    department: str = "all"
    price_min: float | None = None
    price_max: float | None = None
    area_min: float | None = None
    area_max: float | None = None
    land_area_min: float | None = None
    land_area_max: float | None = None
    building_specs: tuple[BuildingSpec, ...] = field(default=())

    def predicate(self) -> Column:
        parts = [F.col("year").between(self.year_min, self.year_max)]
        if self.department != "all":
            parts.append(F.col("department_code") == self.department)
        parts += between(F.col("price_eur"), self.price_min, self.price_max)
        parts += between(F.col("built_area_m2"), self.area_min, self.area_max)
        parts += between(F.col("land_area_m2"), self.land_area_min, self.land_area_max)
        if self.building_specs:
            parts.append(building_specs(self.building_specs))
        return all_of(parts)

    # The keys of a shareable dashboard address.
    _KEYS = {
        "ymin": "year_min",
        "ymax": "year_max",
        "dept": "department",
        "pmin": "price_min",
        "pmax": "price_max",
        "amin": "area_min",
        "amax": "area_max",
        "lamin": "land_area_min",
        "lamax": "land_area_max",
    }

    @classmethod
    def from_query(cls, text: str) -> SaleFilter:
        """Decode a shareable address (see :meth:`to_query`).

        Leading question marks go, the first value of a repeated key counts, a key without a
        value reads as zero, unknown keys are ignored, and any number of building
        specs is allowed. A bound that is no number raises ``ValueError``.
        """
        given: dict[str, str] = {}
        for key, value in parse_qsl(text.lstrip("?"), keep_blank_values=True):
            given.setdefault(key, value)
        values = {}
        for key, name in cls._KEYS.items():
            if key in given:
                values[name] = given[key] if key == "dept" else _number(given[key] or "0")
        specs = []
        for part in filter(None, given.get("bs", "").split(";")):
            kind, *bounds = (part.split(":") + [""] * 5)[:5]
            kind = kind if kind in (S.HOUSE, S.APARTMENT) else ANY_TYPE
            specs.append(BuildingSpec(kind, *[_number(b) for b in bounds]))
        return cls(**values, building_specs=tuple(specs))

    def to_query(self) -> str:
        """Shareable address holding what differs from the defaults."""
        default = SaleFilter()
        given = {
            key: _show(value) if key != "dept" else value
            for key, name in self._KEYS.items()
            if (value := getattr(self, name)) != getattr(default, name)
        }
        if self.building_specs:
            given["bs"] = ";".join(
                ":".join(
                    [s.type, *map(_show, (s.area_min, s.area_max, s.rooms_min, s.rooms_max))]
                )
                for s in self.building_specs
            )
        return urlencode(given)
