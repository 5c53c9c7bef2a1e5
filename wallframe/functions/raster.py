"""Polygon fill as an Arrow function: all polygons of a batch at once, no loop per row.

Rule: on every pixel row the crossings of the sloped edges are sorted and paired; a pair fills from
the left crossing rounded half up to the right one rounded half down.  Horizontal edges are filled
too, so the boundary belongs to the shape.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

RUNS = "array<struct<y0:int,y1:int,x0:int,x1:int>>"
# Wider than any coordinate: keeps the running maximum of one pixel row apart from the next.
ROW_STRIDE = 1 << 33


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..count-1 for every count, concatenated."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _merge(owner: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray):
    """Join touching runs of one polygon and row; returns sorted owner, y, x0, x1."""
    order = np.lexsort((x0, y, owner))
    owner, y, x0, x1 = owner[order], y[order], x0[order], x1[order]
    if not len(owner):
        return owner, y, x0, x1
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (y[1:] != y[:-1])]
    shift = np.cumsum(fresh) * ROW_STRIDE
    reach = np.maximum.accumulate(x1 + shift)
    starts = np.r_[True, x0[1:] + shift[1:] > reach[:-1] + 1]
    first = np.flatnonzero(starts)
    last = np.r_[first[1:], len(owner)] - 1
    return owner[first], y[first], x0[first], reach[last] - shift[last]


def fill(polygons: pa.Array) -> pa.Array:
    """list<struct<x, y>> to list<struct<y0, y1, x0, x1>>; a null polygon gives no runs.

    A batch is filled in portions by the pixel rows that its polygons span.
    """
    sizes = pc.fill_null(pc.list_value_length(polygons), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    y = pc.struct_field(polygons.flatten(), "y").to_numpy(zero_copy_only=False).astype(np.int64)
    starts, real = np.cumsum(sizes) - sizes, sizes > 0
    spans = np.ones(len(sizes), np.int64)
    if len(y):
        spans[real] += np.maximum.reduceat(y, starts[real]) - np.minimum.reduceat(y, starts[real])
    parts = [_fill(polygons.slice(start, stop - start)) for start, stop in _portions(spans * np.maximum(sizes, 1))]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts) if parts else _fill(polygons)


def _fill(polygons: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(polygons), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = polygons.flatten()
    ax = pc.struct_field(points, "x").to_numpy(zero_copy_only=False).astype(np.int64)
    ay = pc.struct_field(points, "y").to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    following = np.arange(len(ax)) + 1
    closing = first[owner] + sizes[owner] == following
    following[closing] = first[owner][closing]
    bx, by = ax[following], ay[following]

    filled = np.flatnonzero(sizes)
    bounds = np.zeros((4, len(sizes)), np.int64)
    for row, (extreme, values) in enumerate(
        ((np.minimum, ay), (np.maximum, ay), (np.minimum, ax), (np.maximum, ax))
    ):
        if len(filled):
            bounds[row, filled] = extreme.reduceat(values, first[filled])
    straight = np.bincount(owner, (ax == bx) != (ay == by), len(sizes))
    box = (sizes == 4) & (straight == 4)

    edge = ~box[owner] & (ay != by)
    low, high = np.minimum(ay, by)[edge], np.maximum(ay, by)[edge]
    rows = high - low + 1
    e = np.repeat(np.flatnonzero(edge), rows)
    y = np.repeat(low, rows) + _ramp(rows)
    x = ax[e] + (y - ay[e]) * (bx[e] - ax[e]) / (by[e] - ay[e])
    # An edge that ends here counts twice, so that a ring passing through keeps its parity.
    times = 1 + ((y == np.repeat(high, rows)) & (y < bounds[1, owner[e]]))
    who, y, x = np.repeat(owner[e], times), np.repeat(y, times), np.repeat(x, times)
    order = np.lexsort((x, y, who))
    who, y, x = who[order][::2], y[order][::2], x[order]
    left = np.floor(x[::2] + 0.5).astype(np.int64)
    right = np.ceil(x[1::2] - 0.5).astype(np.int64)
    real = left <= right

    level = ~box[owner] & (ay == by)
    who, y, left, right = _merge(
        np.r_[who[real], owner[level]],
        np.r_[y[real], ay[level]],
        np.r_[left[real], np.minimum(ax, bx)[level]],
        np.r_[right[real], np.maximum(ax, bx)[level]],
    )
    boxes = np.flatnonzero(box)
    who = np.r_[who, boxes]
    order = np.argsort(who, kind="stable")
    columns = {
        "y0": np.r_[y, bounds[0, boxes]],
        "y1": np.r_[y, bounds[1, boxes]],
        "x0": np.r_[left, bounds[2, boxes]],
        "x1": np.r_[right, bounds[3, boxes]],
    }
    runs = pa.StructArray.from_arrays(
        [pa.array(v[order].astype(np.int32)) for v in columns.values()], names=list(columns)
    )
    offsets = np.r_[0, np.cumsum(np.bincount(who, minlength=len(sizes)))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), runs)


def polygon_runs(polygon: Column) -> Column:
    """Filled polygon as disjoint runs; an axis-parallel box is a single run of many rows."""
    return arrow_udf(fill, RUNS)(polygon)


def with_filled(rows: DataFrame, **polygons: Column) -> DataFrame:
    """Add the runs of polygons by name, each filled once per row.

    The runs come out of a generator of one row.  Filters on other columns pass it and reach the
    scan; filters on the runs stay above it, where they do not fill the polygons again.
    """
    names = list(polygons)
    filled = F.struct(*[polygon_runs(polygons[name]).alias(name) for name in names])
    return rows.select("*", F.inline(F.array(filled)).alias(*names))


# Columns or rows of runs expanded at a time.
EXPANDED = 1 << 16
# Above any offset of a coordinate within its row.
LINE_STRIDE = 1 << 33


def _run_fields(runs: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(runs per value, their fields) of a list of runs; null counts as none."""
    sizes = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = runs.flatten()
    return sizes, {n: pc.struct_field(flat, n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("y0", "y1", "x0", "x1")}


def _portions(weights: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive values whose weights sum to about ``EXPANDED``, or one larger value."""
    ends, out, start = np.cumsum(weights), [], 0
    while start < len(weights):
        base = ends[start] - weights[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + EXPANDED, side="right")))
        out.append((start, stop))
        start = stop
    return out


def _weights(sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), lengths, len(sizes)).astype(np.int64)


def column_counts(runs: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """Column-major run lengths of masks, starting with the number of leading zeros: one sort and one merge."""
    sizes, whole = _run_fields(runs)
    wide, high = (np.asarray(side).astype(np.int64) for side in (width, height))
    lists: list[np.ndarray] = []
    for start, stop in _portions(_weights(sizes, whole["x1"] - whole["x0"] + 1)):
        few, r = _run_fields(runs.slice(start, stop - start))
        owner, columns = np.repeat(np.arange(stop - start), few), r["x1"] - r["x0"] + 1
        e = np.repeat(np.arange(len(owner)), columns)
        at = (r["x0"][e] + _ramp(columns)) * high[start:stop][owner[e]]
        who, _, first, last = _merge(owner[e], np.zeros(len(e), np.int64), at + r["y0"][e], at + r["y1"][e])
        fresh = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
        before = np.where(fresh, -1, np.r_[-1, last[:-1]] if len(last) else last)
        pairs = np.stack([first - before - 1, last - first + 1], axis=1).ravel()
        ends = np.cumsum(np.bincount(who, minlength=stop - start))
        total = wide[start:stop] * high[start:stop]
        for k, end in enumerate(ends):
            begin = ends[k - 1] if k else 0
            rest = total[k] - (last[end - 1] + 1 if end > begin else 0)
            lists.append(np.r_[pairs[2 * begin : 2 * end], [rest] if rest > 0 else []].astype(np.int32))
    offsets = np.r_[0, np.cumsum([len(v) for v in lists])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))


def patch_shares(size: int, patch: int):
    """Function of (runs, width, height): the touched cells of each mask as list<struct<patch_id, weight>>.

    Masks are scaled to ``size`` x ``size`` by nearest neighbour and cut into ``patch`` cells.
    """
    side = size // patch

    def run(runs: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        sizes, r = _run_fields(runs)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        wide, high = (pc.fill_null(v, 0).to_numpy(zero_copy_only=False).astype(np.float64)[owner] for v in (width, height))
        real = (wide > 0) & (high > 0)
        first = lambda pixel, length: np.ceil(pixel[real] * size / length[real] - 0.5).astype(np.int64)
        x0, x1 = first(r["x0"], wide), first(r["x1"] + 1, wide) - 1
        y0, y1 = first(r["y0"], high), first(r["y1"] + 1, high) - 1
        owner = owner[real]
        seen = (x0 <= x1) & (y0 <= y1)
        owner, x0, x1, y0, y1 = (v[seen] for v in (owner, x0, x1, y0, y1))
        columns = x1 // patch - x0 // patch + 1
        counts, ids, pixels = np.zeros(len(sizes), np.int64), [], []
        for start, stop in _portions(np.bincount(owner, columns * (y1 // patch - y0 // patch + 1), len(sizes)).astype(np.int64)):
            mine = slice(*np.searchsorted(owner, (start, stop)))
            across = columns[mine]
            cells = across * (y1[mine] // patch - y0[mine] // patch + 1)
            e = np.repeat(np.arange(len(cells)), cells) + mine.start
            place = _ramp(cells)
            px, py = x0[e] // patch + place % columns[e], y0[e] // patch + place // columns[e]
            shared = np.minimum(x1[e], px * patch + patch - 1) - np.maximum(x0[e], px * patch) + 1
            shared *= np.minimum(y1[e], py * patch + patch - 1) - np.maximum(y0[e], py * patch) + 1
            who, cell = owner[e], py * side + px
            order = np.lexsort((cell, who))
            who, cell, shared = who[order], cell[order], shared[order]
            fresh = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (cell[1:] != cell[:-1])][: len(who)])
            counts += np.bincount(who[fresh], minlength=len(sizes))
            ids.append(cell[fresh])
            pixels.append(np.add.reduceat(shared, fresh) if len(fresh) else shared)
        flat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (ids, pixels)]
        shares = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int32)), pa.array(flat[1] / float(patch * patch))], names=["patch_id", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), shares)

    return run


def _rows_of(runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row key of owner and y, x0, x1), one entry per pixel row of each run."""
    sizes, r = _run_fields(runs)
    tall = r["y1"] - r["y0"] + 1
    e = np.repeat(np.arange(len(tall)), tall)
    owner = np.repeat(np.arange(len(sizes)), sizes)[e]
    return owner * (1 << 32) + r["y0"][e] + _ramp(tall) + (1 << 31), r["x0"][e], r["x1"][e]


def common_area(first: pa.Array, second: pa.Array) -> pa.Array:
    """Pixels that two masks share, value by value: a search in sorted rows instead of all pairs of runs."""
    weights = sum(_weights(sizes, r["y1"] - r["y0"] + 1) for sizes, r in map(_run_fields, (first, second)))
    out = np.zeros(len(first), np.int64)
    for start, stop in _portions(weights):
        (row_a, x0, x1), (row_b, u0, u1) = (_rows_of(side.slice(start, stop - start)) for side in (first, second))
        if not len(row_a) or not len(row_b):
            continue
        rows, place = np.unique(np.r_[row_a, row_b], return_inverse=True)
        low = min(int(x0.min()), int(u0.min()))
        key_a, key_b = place[: len(row_a)] * LINE_STRIDE - low, place[len(row_a) :] * LINE_STRIDE - low
        order = np.argsort(key_b + u0, kind="stable")
        starts, lengths = (key_b + u0)[order], (u1 - u0 + 1)[order]
        done = np.cumsum(lengths) - lengths

        def covered(q: np.ndarray, starts=starts, lengths=lengths, done=done) -> np.ndarray:
            """Pixels of the second masks before ``q``, over all rows."""
            k = np.searchsorted(starts, q, side="right") - 1
            return np.where(k < 0, 0, done[k] + np.minimum(q - starts[k], lengths[k]))

        shared = covered(key_a + x1 + 1) - covered(key_a + x0)
        out[start:stop] = np.bincount((row_a >> 32), shared, stop - start).astype(np.int64)
    return pa.array(out)
