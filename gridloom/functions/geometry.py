"""Scalar functions on points, tiles and networks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps in the order in which ties are broken: west, north, east, south; the diagonal ones only for 8 neighbours.
STEPS = ((-1, 0, "W"), (0, -1, "N"), (1, 0, "E"), (0, 1, "S"))
DIAGONALS = ((-1, -1, "NW"), (1, -1, "NE"), (1, 1, "SE"), (-1, 1, "SW"))


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def manhattan(ax, ay, bx, by) -> Column:
    return F.abs(_c(ax) - _c(bx)) + F.abs(_c(ay) - _c(by))


def chebyshev(ax, ay, bx, by) -> Column:
    return F.greatest(F.abs(_c(ax) - _c(bx)), F.abs(_c(ay) - _c(by)))


def euclidean(ax, ay, bx, by) -> Column:
    dx, dy = (_c(ax) - _c(bx)).cast("double"), (_c(ay) - _c(by)).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def heuristic(name: str, ax, ay, bx, by) -> Column:
    """A whole number, as a search uses it; the Euclidean one is cut off."""
    if name == "euclidean":
        return F.floor(euclidean(ax, ay, bx, by))
    return {"manhattan": manhattan, "chebyshev": chebyshev}[name](ax, ay, bx, by)


def same_point(ax, ay, bx, by) -> Column:
    return (_c(ax) == _c(bx)) & (_c(ay) == _c(by))


def cell_index(x, y, width) -> Column:
    return _c(x) + _c(y) * _c(width)


def index_cell(index, width) -> tuple[Column, Column]:
    return F.pmod(_c(index), _c(width)), F.floor(_c(index) / _c(width)).cast("long")


def tile_of(x, size: int) -> Column:
    return F.floor(_c(x) / size).cast("long")


def to_local(x, tile, size: int) -> Column:
    return _c(x) - _c(tile) * size


def to_global(x, tile, size: int) -> Column:
    return _c(x) + _c(tile) * size


def tile_count(extent, size: int) -> Column:
    return F.ceil(_c(extent) / size).cast("long")


def is_wall(ch) -> Column:
    """Any character but a full stop."""
    return _c(ch) != "."


def inside(x, y, width, height) -> Column:
    return _c(x).between(0, _c(width) - 1) & _c(y).between(0, _c(height) - 1)


def strictly_inside(x, y, width, height) -> Column:
    """Off the first row and column too, as a search asks of its ends."""
    return (_c(x) > 0) & (_c(x) < _c(width)) & (_c(y) > 0) & (_c(y) < _c(height))


def inside_tile(x, y, cx, cy, size: int) -> Column:
    return (tile_of(x, size) == _c(cx)) & (tile_of(y, size) == _c(cy))


def packet_loss(workers) -> Column:
    """Percent of packets that the emulated network loses, by the number of workers."""
    return (1 - F.exp(F.lit(-0.2) * _c(workers))) * 100
