"""Arrow helpers that filter whole image lines held as arrays (one line per row)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# How positions beyond the image edge are read; names of the numpy padding that does it.
EDGE_MODES = {"constant": "constant", "reflect": "symmetric", "nearest": "edge"}


def box_weights(radius: int) -> list[float]:
    return [1.0] * (2 * radius + 1)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [v / sum(w) for v in w]


def line_filter(weights: Sequence[float], mode: str):
    """Column function (positions, values, length) -> filtered line as an array of ``length`` doubles."""
    taps = np.asarray(weights, dtype=float)
    reach = (len(taps) - 1) // 2
    pad_mode = EDGE_MODES[mode]

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(xs: pa.Array, vs: pa.Array, n: pa.Array) -> pa.Array:
        lengths = n.to_numpy(zero_copy_only=False)
        width = int(lengths.max()) if len(lengths) else 0
        counts = np.diff(xs.offsets.to_numpy())
        rows = np.repeat(np.arange(len(counts)), counts)
        dense = np.zeros((len(counts), width))
        dense[rows, xs.flatten().to_numpy()] = vs.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros_like(dense)
        for size in np.unique(lengths):
            pick = lengths == size
            wide = np.pad(dense[pick, :size], ((0, 0), (reach, reach)), mode=pad_mode)
            part = np.zeros((int(pick.sum()), size))
            for k, w in enumerate(taps):
                part += w * wide[:, k : k + size]
            out[pick, :size] = part
        flat = out[np.arange(width)[None, :] < lengths[:, None]]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return run
