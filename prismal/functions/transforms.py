"""Named coordinate transforms, which have inverses, and the choice of one by a dataset's id."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from . import geo, geodesy

Pair = tuple[Column, Column]


@dataclass(frozen=True)
class Transform:
    """Columns of the old coordinates to the new ones, and back."""

    name: str
    old: tuple[str, str]
    new: tuple[str, str]
    to: Callable[[Column, Column], Pair]
    back: Callable[[Column, Column], Pair] | None = None

    def __call__(self, a: Column, b: Column) -> Pair:
        return self.to(a, b)

    @property
    def inverse(self) -> Transform:
        if self.back is None:
            raise ValueError(f"{self.name} has no inverse")
        return Transform(f"{self.name} inverse", self.new, self.old, self.back, self.to)

    def then(self, other: Transform) -> Transform:
        """One after the other; the inverse undoes them in reverse."""
        both = self.back is not None and other.back is not None
        back = (lambda a, b: self.back(*other.back(a, b))) if both else None
        return Transform(f"{self.name}, {other.name}", self.old, other.new, lambda a, b: other.to(*self.to(a, b)), back)


def _fields(struct: Column, *names: str) -> tuple[Column, ...]:
    return tuple(struct[n] for n in names)


#: Fixed-grid angles, and pixels, of a geostationary view.
GEOSTATIONARY = Transform("geostationary", ("x", "y"), ("lon", "lat"), geo.grid_to_geo, geo.geo_to_grid)
GEOSTATIONARY_INDEX = Transform("geostationary index", ("ix", "iy"), ("x", "y"), lambda ix, iy: geo.index_to_radians(iy, ix)[::-1], lambda x, y: geo.radians_to_index(y, x)[::-1])
#: Metres, and pixels, of a push-broom scene.
PUSHBROOM = Transform("pushbroom", ("x", "y"), ("lon", "lat"), lambda x, y: _fields(geodesy.scene_to_geo(x, y), "lon", "lat"), geodesy.geo_to_scene)
PUSHBROOM_INDEX = Transform("pushbroom index", ("ix", "iy"), ("x", "y"), geo.scene_xy, geo.scene_index)
#: A push-broom scene along a straight track: pixels across it first, then along.
STRAIGHT_TRACK = Transform(
    "straight track", ("ix", "iy"), ("lon", "lat"),
    lambda i, j: _fields(geodesy.xy_to_geo(*geo.rotate(geo.STEP_Y * (i - geo.MIDDLE), geo.STEP_X * j, math.radians(59.0))), "lon", "lat"),
)

#: id prefix -> (transform of pixels to x and y, transform of these to longitude and latitude).
BY_ID: dict[str, tuple[Transform, Transform]] = {"geostationary": (GEOSTATIONARY_INDEX, GEOSTATIONARY), "pushbroom": (PUSHBROOM_INDEX, PUSHBROOM)}


def transform_for(id: str, first: str) -> Transform:
    """The transform to (lon, lat) of a dataset, by the beginning of its id; from pixels if its first coordinate is ix."""
    for prefix, (index, xy) in BY_ID.items():
        if id.startswith(prefix):
            return index.then(xy) if first == "ix" else xy
    raise ValueError(f"no geographic transform for a dataset named {id!r}; ids begin with {sorted(BY_ID)}")
