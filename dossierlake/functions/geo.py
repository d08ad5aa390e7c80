"""Web-Mercator column expressions for parcels and map tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierlake.fixed import WORLD_3857
from dossierlake.functions.numbers import half_even
from dossierlake.functions.text import col


def _mercator(lat) -> Column:
    rad = F.radians(col(lat))
    return F.ln(F.tan(rad) + F.lit(1.0) / F.cos(rad))


def tile_x(lng, zoom: int) -> Column:
    return ((col(lng) + 180.0) / 360.0 * float(2**zoom)).cast("int")


def tile_y(lat, zoom: int) -> Column:
    return ((F.lit(1.0) - _mercator(lat) / math.pi) / 2.0 * float(2**zoom)).cast("int")


def metre_x(lng) -> Column:
    return col(lng) * WORLD_3857 / 180.0


def metre_y(lat) -> Column:
    return _mercator(lat) * WORLD_3857 / math.pi


def tile_grid_bounds(cx, cy, zoom: int, grid: int) -> Column:
    """Extent in metres of a grid x grid block of tiles around one tile."""
    half, side = grid // 2, 2 * WORLD_3857 / (2**zoom)
    cx, cy = col(cx), col(cy)
    return F.struct(
        (F.lit(-WORLD_3857) + (cx - half) * side).alias("minx"),
        (F.lit(WORLD_3857) - (cy + half + 1) * side).alias("miny"),
        (F.lit(-WORLD_3857) + (cx + half + 1) * side).alias("maxx"),
        (F.lit(WORLD_3857) - (cy - half) * side).alias("maxy"),
    )


def square_around(lat, lng, span_m: float) -> Column:
    x, y, s = metre_x(lng), metre_y(lat), span_m / 2.0
    return F.struct(
        (x - s).alias("minx"), (y - s).alias("miny"), (x + s).alias("maxx"), (y + s).alias("maxy")
    )


def outer_rings(kind, polygon, multipolygon) -> Column:
    """First ring of every polygon. The two inputs are ARRAY<ring> and ARRAY<ARRAY<ring>>."""
    single = F.slice(col(polygon), 1, 1)
    many = F.transform(F.filter(col(multipolygon), lambda p: F.size(p) > 0), lambda p: p[0])
    return F.when(col(kind) == "Polygon", single).when(col(kind) == "MultiPolygon", many)


def relative_x(lng, bounds) -> Column:
    """Position across an extent, 0 at the left edge."""
    b = col(bounds)
    width = F.coalesce(F.nullif(b.maxx - b.minx, F.lit(0.0)), F.lit(1.0))
    return half_even((metre_x(lng) - b.minx) / width, 4)


def relative_y(lat, bounds) -> Column:
    """Position down an extent, 0 at the top edge."""
    b = col(bounds)
    height = F.coalesce(F.nullif(b.maxy - b.miny, F.lit(0.0)), F.lit(1.0))
    return half_even((b.maxy - metre_y(lat)) / height, 4)
