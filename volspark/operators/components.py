"""Connected components of graphs and voxel masks.

Each round hooks every node to its smallest neighbour, shortcuts the resulting trees to their roots and
contracts the graph to those roots, so the edge table shrinks by a factor every round.  Voxels are labelled inside
blocks first; only components that meet at block faces enter the graph.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from volspark.operators.blocks import SIDE, Block, box_sums, with_halo
from volspark.operators.grid import neighbours
from volspark.operators.labels import VOXEL
from volspark.operators.regions import SUBJECT
from volspark.plans.joins import attach
from volspark.plans.storage import materialize, measured, release

# Parent links followed per pass.
_HOPS = 3


def _both_ways(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    pairs = edges.filter("src <> dst").select(*keys, ends.alias("_e"))
    return pairs.select(*keys, "_e.src", "_e.dst").distinct()


def _to_roots(parents: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """Follow parent links (always to a smaller id) until each node points to its root; with the row count."""
    current, seen = measured(parents, "parents")
    rows = seen["rows"]
    while True:
        table = current.select(*keys, F.col("src").alias("root"), F.col("root").alias("_up"))
        step = current.select(*keys, "src", "root", F.lit(False).alias("_moved"))
        for _ in range(_HOPS):
            step = attach(step, table, [*keys, "root"], rows=rows)
            step = step.select(*keys, "src", F.coalesce("_up", "root").alias("root"), (F.col("_moved") | F.col("_up").isNotNull()).alias("_moved"))
        step, seen = measured(step, "jump", moved=F.count_if("_moved"))
        release(current)
        current = step
        if not seen["moved"]:
            return current.select(*keys, "src", "root"), rows


def graph_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (SUBJECT,)) -> DataFrame:
    """Smallest node id of each node's component: ``keys, id, component``.

    ``nodes`` has ``id``, ``edges`` have ``src`` and ``dst`` in either direction.
    """
    keys = list(keys)
    links, seen = measured(_both_ways(edges, keys), "links")
    out = nodes.select(*keys, "id", F.col("id").alias("component"))
    while seen["rows"]:
        hooks = links.groupBy(*keys, "src").agg(F.min("dst").alias("root")).filter("root < src")
        roots, rows = _to_roots(hooks, keys)
        moved = links
        for end in ("src", "dst"):
            there = roots.select(*keys, F.col("src").alias(end), "root")
            moved = attach(moved, there, [*keys, end], rows=rows)
            moved = moved.withColumn(end, F.coalesce("root", end)).drop("root")
        contracted, seen = measured(moved.filter("src <> dst").distinct(), "links")
        release(links)
        links = contracted
        there = roots.select(*keys, F.col("src").alias("component"), "root")
        out = attach(out, there, [*keys, "component"], rows=rows)
        out = out.withColumn("component", F.coalesce("root", "component")).drop("root")
    return out


def _half(connectivity: int) -> list[tuple[int, int, int]]:
    """One of each opposite pair of neighbours, without the two along z that runs cover."""
    return [o for o in neighbours(connectivity) if o > (0, 0, 0) and o[:2] != (0, 0)]


def _shifted(cells: np.ndarray, offset: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Views of all cells that have a neighbour at an offset, and of that neighbour."""
    here = tuple(slice(max(0, -o), n - max(0, o)) for o, n in zip(offset, cells.shape, strict=True))
    there = tuple(slice(max(0, o), n - max(0, -o)) for o, n in zip(offset, cells.shape, strict=True))
    return cells[here], cells[there]


def joined_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0 .. n - 1 that each is joined to by the pairs (a, b): hook to the smaller root, jump to the roots."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(root, root[root]):
            root = root[root]


def label_cells(mask: np.ndarray, connectivity: int) -> tuple[np.ndarray, np.ndarray]:
    """Component number of each cell (0 outside) and the flat index of each component's first cell, by number.

    Cells become runs along the last axis; touching runs are joined by hooking to the smaller one and jumping to the root.
    """
    before = np.zeros_like(mask)
    before[..., 1:] = mask[..., :-1]
    starts = mask & ~before
    runs = np.cumsum(starts.ravel()).reshape(mask.shape) * mask
    first = np.concatenate([[0], np.flatnonzero(starts)])
    n = len(first)
    touching = []
    for o in _half(connectivity):
        a, b = _shifted(runs, o)
        both = (a > 0) & (b > 0)
        touching.append(np.unique(a[both].astype(np.int64) * n + b[both]))
    a, b = np.divmod(np.unique(np.concatenate(touching)), n)
    return joined_roots(a, b, n)[runs], first


def _place(x, y, z):
    """Orders positions as they lie in the array: x slowest, z fastest."""
    return (x.astype(np.int64) << 40) + (y.astype(np.int64) << 20) + z


# Rows of a block's result: its own voxels, cells that other blocks see too, and how many cells a component has here.
_OWN, _SEEN, _SIZE = 0, 1, 2


def _block_components(mask: DataFrame, connectivity: int, extra: Sequence[str], grow: int) -> DataFrame:
    """Components of each block and its halo: ``kind, x, y, z, id, n``.

    ``id`` is the place of the component's first cell as the block sees it.  With ``grow``, cells are those of the mask grown
    by that many steps of the 26-neighbourhood inside the image (``nx, ny, nz``); only own voxels of the mask itself and
    cells at block faces leave the task.
    """
    keys = [SUBJECT, *extra]
    reach = grow + 1
    sizes = ["nx", "ny", "nz"] if grow else []

    def run(key: tuple, table: pa.Table) -> pa.Table:
        corner = [k.as_py() * SIDE for k in key[-3:]]
        block = Block(table, corner, SIDE, reach, (), grow)
        cells = block.here().copy()
        if grow:
            cells = box_sums(block.whole().astype(np.int16), 2 * grow + 1)
            cells = cells[tuple(slice(1, 1 + n) for n in block.shape)] > 0
            for axis, name in enumerate(sizes):
                at = np.arange(cells.shape[axis]) + block.low[axis]
                outside = (at < 0) | (at >= table.column(name)[0].as_py())
                cells[tuple(outside if i == axis else slice(None) for i in range(3))] = False
            # grown cells further out than the next block's first layer are not whole
            for axis in range(3):
                at = np.arange(cells.shape[axis]) + block.low[axis] - corner[axis]
                cells[tuple(((at < -1) | (at > SIDE)) if i == axis else slice(None) for i in range(3))] = False
        found, first = label_cells(cells, connectivity)
        places = _place(*(i + low for i, low in zip(np.unravel_index(first, cells.shape), block.low, strict=True)))
        at = np.stack(np.nonzero(found), 1)
        inner = at + block.low - np.array(corner)
        ids = places[found[tuple(at.T)]]
        own = ((inner >= 0) & (inner < SIDE)).all(1)
        seen = ((inner <= 0) | (inner >= SIDE - 1)).any(1)
        xyz = at + block.low
        mine = np.flatnonzero(own)
        if grow:
            mine = mine[block.here()[tuple(at[mine].T)]]
            total, counts = np.unique(ids[own], return_counts=True)
        else:
            total, counts = ids[:0], ids[:0]
        faces = np.flatnonzero(seen)
        kind = np.repeat([_OWN, _SEEN, _SIZE], [len(mine), len(faces), len(total)]).astype(np.int32)
        none = np.full(len(total), -1)
        columns = {a: np.concatenate([xyz[mine, i], xyz[faces, i], none]) for i, a in enumerate("xyz")}
        columns |= {"kind": kind, "id": np.concatenate([ids[mine], ids[faces], total]), "n": np.concatenate([np.ones(len(mine) + len(faces), int), counts])}
        fixed = dict(zip(keys, key[:-3], strict=True))
        return pa.table([pa.repeat(fixed[f.name], len(kind)).cast(f.type) if f.name in fixed else pa.array(columns[f.name]).cast(f.type) for f in arrow], schema=arrow)

    kinds = ", ".join(f"`{k}` {mask.schema[k].dataType.simpleString()}" for k in [*keys, "x", "y", "z"])
    schema = f"{kinds}, kind int, id bigint, n bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    rows = with_halo(mask.select(*keys, "x", "y", "z", *sizes), reach)
    for a, n in zip("xyz", sizes):
        # nothing grows beyond the image
        rows = rows.filter(F.col(f"_b{a}") * SIDE < F.col(n))
    return rows.groupBy(*keys, "_bx", "_by", "_bz").applyInArrow(run, schema)


def _joined_blocks(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``component`` to the rows of blocks: the smallest id of all components that share a cell with it."""
    seen = parts.filter(F.col("kind") == _SEEN)
    met = seen.groupBy(*keys, "x", "y", "z").agg(F.collect_set("id").alias("_ids")).filter(F.size("_ids") > 1)
    # a cell is seen by eight blocks at most
    pairs = met.select(*keys, F.array_min("_ids").alias("src"), F.explode("_ids").alias("dst")).filter("src <> dst").distinct()
    kinds = ", ".join(f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, id bigint, component bigint"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("src", "dst")]), return_inverse=True)
        joined = ids[joined_roots(*np.split(ends, 2), len(ids))]
        columns = [*(pa.repeat(k, len(ids)) for k in key), pa.array(ids), pa.array(joined)]
        return pa.table(columns, names=[*keys, "id", "component"])

    # the graph of one image's block faces is bounded by the image
    found = pairs.groupBy(*keys).applyInArrow(run, schema)
    return attach(parts, found, [*keys, "id"]).withColumn("component", F.coalesce("component", "id"))


def voxel_components(mask: DataFrame, connectivity: int = 26, extra: Sequence[str] = ()) -> DataFrame:
    """Components of a mask, or of each value of the ``extra`` columns: voxels with ``component``.

    The component id grows in array order of the components' first voxels.
    """
    keys = [SUBJECT, *extra]
    parts = materialize(_block_components(mask, connectivity, extra, 0), "blocks")
    return _joined_blocks(parts, keys).filter(F.col("kind") == _OWN).select(*keys, "x", "y", "z", "component")


def in_largest_grown(mask: DataFrame, dims: DataFrame, steps: int, connectivity: int = 26) -> DataFrame:
    """Voxels of the mask that lie in the largest component of the mask grown by ``steps`` 26-neighbourhoods in the image.

    The grown mask stays inside the blocks: only its cells at block faces and its sizes leave them.
    """
    sized = attach(mask.select(*VOXEL), dims.select(SUBJECT, "nx", "ny", "nz"), SUBJECT, "inner", costly=False)
    parts = materialize(_block_components(sized, connectivity, (), steps), "blocks")
    parts = materialize(_joined_blocks(parts, [SUBJECT]), "grown")
    sizes = parts.filter(F.col("kind") == _SIZE).groupBy(SUBJECT, "component").agg(F.sum("n").alias("n"))
    best = sizes.groupBy(SUBJECT).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return attach(parts.filter(F.col("kind") == _OWN), best, [SUBJECT, "component"], "inner").select(*VOXEL)


def component_sizes(components: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return components.groupBy(SUBJECT, *extra, "component").agg(F.count(F.lit(1)).alias("n_voxels"))


def largest_ids(components: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The largest component per subject (and ``extra``); of equal ones the first in array order."""
    sizes = component_sizes(components, extra)
    best = F.max_by("component", F.struct("n_voxels", -F.col("component")))
    return sizes.groupBy(SUBJECT, *extra).agg(best.alias("component"))


def keep_largest(mask: DataFrame, connectivity: int = 26, extra: Sequence[str] = ()) -> DataFrame:
    found = materialize(voxel_components(mask, connectivity, extra), "components")
    kept = attach(found, largest_ids(found, extra), [SUBJECT, *extra, "component"], "inner")
    return kept.select(*VOXEL, *extra)


def split_largest(mask: DataFrame, connectivity: int = 26, extra: Sequence[str] = ()) -> DataFrame:
    """All voxels with ``largest``: whether they lie in the largest component (of their class)."""
    found = materialize(voxel_components(mask, connectivity, extra), "components")
    best = largest_ids(found, extra).withColumn("_best", F.lit(True))
    marked = attach(found, best, [SUBJECT, *extra, "component"])
    return marked.select(*VOXEL, *extra, "component", F.coalesce("_best", F.lit(False)).alias("largest"))


def drop_small(mask: DataFrame, max_size: int = 3, connectivity: int = 26) -> DataFrame:
    """Remove components of up to ``max_size`` voxels."""
    found = materialize(voxel_components(mask, connectivity), "components")
    kept = component_sizes(found).filter(F.col("n_voxels") > max_size).select(SUBJECT, "component")
    return attach(found, kept, [SUBJECT, "component"], "inner").select(*VOXEL)
