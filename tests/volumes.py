"""Small volumes as DataFrames and dense arrays, and plain numpy versions of neighbourhood operators."""

import itertools

import numpy as np


def frame(spark, arrays, subject=1):
    """One row per voxel; ``arrays`` maps column names to equally shaped arrays."""
    shape = next(iter(arrays.values())).shape
    rows = []
    for x, y, z in itertools.product(*map(range, shape)):
        rows.append((subject, x, y, z, *(a[x, y, z].item() for a in arrays.values())))
    kinds = ["double" if a.dtype.kind == "f" else "int" for a in arrays.values()]
    schema = "subject_id long, x int, y int, z int" + "".join(f", {n} {k}" for n, k in zip(arrays, kinds, strict=True))
    return spark.createDataFrame(rows, schema)


def dims(spark, shape, subject=1):
    return spark.createDataFrame([(subject, *shape)], "subject_id long, nx int, ny int, nz int")


def dense(df, shape, column, fill=0):
    out = np.full(shape, fill, dtype=float)
    for r in df.collect():
        out[r["x"], r["y"], r["z"]] = r[column]
    return out


def points(df):
    return {(r["x"], r["y"], r["z"]) for r in df.collect()}


def offsets(limit):
    return [o for o in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= limit]


def grow(mask, limit=3, times=1):
    for _ in range(times):
        wide = np.pad(mask, 1)
        out = mask.copy()
        for o in offsets(limit):
            out |= wide[tuple(slice(1 + d, 1 + d + n) for d, n in zip(o, mask.shape))]
        mask = out
    return mask


def shrink(mask, limit=3, times=1):
    for _ in range(times):
        wide = np.pad(mask, 1)
        out = mask.copy()
        for o in offsets(limit):
            out &= wide[tuple(slice(1 + d, 1 + d + n) for d, n in zip(o, mask.shape))]
        mask = out
    return mask


def components(mask, limit=3):
    """Component number per voxel in array order, 0 outside."""
    out = np.zeros(mask.shape, int)
    n = 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        stack = [start]
        out[start] = n
        while stack:
            at = stack.pop()
            for o in offsets(limit):
                q = tuple(a + d for a, d in zip(at, o))
                if all(0 <= c < s for c, s in zip(q, mask.shape)) and mask[q] and not out[q]:
                    out[q] = n
                    stack.append(q)
    return out


def largest(mask, limit=3):
    found = components(mask, limit)
    counts = np.bincount(found.ravel())[1:]
    return found == counts.argmax() + 1 if len(counts) else mask


def gaussian(a, sigma, mode):
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in range(3):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        wide = np.pad(a, pad, mode={"reflect": "symmetric", "nearest": "edge"}[mode])
        a = sum(w[k] * np.take(wide, range(k, k + a.shape[axis]), axis) for k in range(2 * r + 1))
    return a
