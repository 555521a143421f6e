"""Neighbourhoods in cubic blocks with a halo.

Voxels are dealt to blocks of ``side`` positions per axis; only those within ``reach`` of a block's face are copied to
the blocks beyond it.  Inside a task a block is a dense array, at most ``(side + 2 * reach) ** 3`` cells whatever the
image or the number of subjects, and a neighbour is a shifted view.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from volspark.operators.labels import VOXEL

SIDE = 32
_AXES = "xyz"
_BLOCK = [f"_b{a}" for a in _AXES]


def block_of(axis: str, side: int = SIDE) -> Column:
    return F.floor(F.col(axis) / side).cast("int")


def with_halo(voxels: DataFrame, reach: int, side: int = SIDE) -> DataFrame:
    """Every voxel once for its own block and once for each block that it is within reach of.

    Coordinates are those of an image, 0 and up, so no block lies below 0.
    """
    if not 0 <= reach <= side:
        raise ValueError("a halo may be as wide as a block at most")
    rows = voxels
    for a, name in zip(_AXES, _BLOCK, strict=True):
        own = block_of(a, side)
        place = F.col(a) - own * side
        low, high = (place < reach) & (own > 0), place >= side - reach
        beside = (
            F.when(low & high, F.array(own, own - 1, own + 1)).when(low, F.array(own, own - 1)).when(high, F.array(own, own + 1))
        )
        rows = rows.withColumn(name, F.explode(beside.otherwise(F.array(own))))
    return rows


class Block:
    """The voxels of one block and its halo as arrays.

    ``at(name, offset)`` is a value column as seen from every position of the inside, shifted by an offset within reach,
    0 where there is no voxel; ``here(offset)`` says whether there is one.  ``rows`` index the inside for each row.
    """

    def __init__(self, table: pa.Table, corner: Sequence[int], side: int, reach: int, names: Sequence[str], margin: int):
        xyz = np.stack([table.column(a).to_numpy() for a in _AXES], 1).astype(np.int64)
        self.low = xyz.min(0) - margin
        self.shape = tuple(xyz.max(0) + margin + 1 - self.low)
        self.rows = tuple((xyz - self.low).T)
        inside = ((xyz >= np.array(corner)) & (xyz < np.array(corner) + side)).all(1)
        self.own = inside
        self.corner, self.side, self.reach = np.array(corner), side, reach
        wide = tuple(n + 2 * reach for n in self.shape)
        put = tuple(i + reach for i in self.rows)
        self._present = np.zeros(wide, bool)
        self._present[put] = True
        self._values = {}
        for name in names:
            values = table.column(name).to_numpy()
            self._values[name] = np.zeros(wide, values.dtype)
            self._values[name][put] = values

    def _view(self, wide: np.ndarray, offset: Sequence[int]) -> np.ndarray:
        return wide[tuple(slice(self.reach + o, self.reach + o + n) for o, n in zip(offset, self.shape, strict=True))]

    def here(self, offset: Sequence[int] = (0, 0, 0)) -> np.ndarray:
        return self._view(self._present, offset)

    def at(self, name: str, offset: Sequence[int] = (0, 0, 0)) -> np.ndarray:
        return self._view(self._values[name], offset)

    def whole(self, name: str | None = None) -> np.ndarray:
        """A value column (or the presence) with ``reach`` more positions on all sides."""
        return self._present if name is None else self._values[name]

    def own_cells(self, cells: np.ndarray) -> list[np.ndarray]:
        """Coordinates of the true cells that belong to this block."""
        found = np.stack(np.nonzero(cells), 1) + self.low
        found = found[((found >= self.corner) & (found < self.corner + self.side)).all(1)]
        return list(found.T)


def _grouped(voxels: DataFrame, reach: int, side: int, extra: Sequence[str]):
    return with_halo(voxels, reach, side).groupBy(VOXEL[0], *extra, *_BLOCK)


def _part_of(schema: StructType, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {schema[n].dataType.simpleString()}" for n in names)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def map_voxels(
    voxels: DataFrame,
    reach: int,
    names: Sequence[str],
    compute: Callable[[Block], tuple[np.ndarray, dict]],
    out: str = "",
    keep: Sequence[str] = (),
    extra: Sequence[str] = (),
    side: int = SIDE,
) -> DataFrame:
    """Voxels with columns computed from their neighbourhood.

    ``compute`` gives a mask over ``block.rows`` and, per output column, either an array over the block's inside or one
    value per row that the mask picks among the block's own (an Arrow array).  Columns ``names`` (integers or doubles without
    nulls) are read as arrays; ``keep`` are handed through.  ``extra`` columns are part of the key.  A position occurs
    once per key.
    """
    passed = list(dict.fromkeys([*VOXEL, *extra, *keep]))
    needed = list(dict.fromkeys([*passed, *names]))
    schema = _part_of(voxels.schema, passed) + (f", {out}" if out else "")
    arrow = _arrow(schema)
    outputs = [f for f in arrow if f.name not in passed]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        corner = [k.as_py() * side for k in key[-3:]]
        block = Block(table, corner, side, reach, names, 0)
        picked, values = compute(block)
        rows = np.flatnonzero(picked[block.rows] & block.own)
        taken = table.select(passed).take(pa.array(rows))
        at = tuple(i[rows] for i in block.rows)
        for f in outputs:
            column = values[f.name]
            if callable(column):
                column = column(at)
            taken = taken.append_column(f, column if isinstance(column, pa.Array) else pa.array(column[at]).cast(f.type))
        return taken.cast(arrow)

    return _grouped(voxels.select(*needed), reach, side, extra).applyInArrow(run, schema)


def map_cells(
    mask: DataFrame, reach: int, compute: Callable[[Block], np.ndarray], extra: Sequence[str] = (), names: Sequence[str] = (), side: int = SIDE
) -> DataFrame:
    """Positions, whether or not they hold a voxel, that ``compute`` marks; its array spans the voxels and ``reach`` more.

    Columns ``names`` are read as arrays for ``compute``.
    """
    schema = _part_of(mask.schema, [*VOXEL, *extra])
    arrow = _arrow(schema)
    fixed_names = [VOXEL[0], *extra]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table, [k.as_py() * side for k in key[-3:]], side, reach, names, reach)
        xyz = block.own_cells(compute(block))
        fixed = dict(zip(fixed_names, key[:-3], strict=True))
        columns = dict(zip(_AXES, xyz, strict=True))
        n = len(xyz[0])
        return pa.table([pa.repeat(fixed[f.name], n).cast(f.type) if f.name in fixed else pa.array(columns[f.name]).cast(f.type) for f in arrow], schema=arrow)

    return _grouped(mask.select(*VOXEL, *extra, *names), reach, side, extra).applyInArrow(run, schema)


def box_sums(wide: np.ndarray, size: int) -> np.ndarray:
    """Sums over boxes of ``size`` per axis, from prefix sums along each axis; ``size - 1`` positions shorter per axis."""
    for axis in range(wide.ndim):
        total = np.cumsum(wide, axis=axis)
        first = np.take(total, [size - 1], axis=axis)
        n = wide.shape[axis]
        rest = np.take(total, range(size, n), axis=axis) - np.take(total, range(n - size), axis=axis)
        wide = np.concatenate([first, rest], axis=axis)
    return wide
