"""Pair work inside images.

The number of pairs grows with the square of an image, so pairs are never laid out as rows
before they are judged.  Rows of an image are hashed into blocks of bounded size, every pair of
blocks is one small group, and a NumPy kernel inside it reports only what was asked for: pairs
below a distance, the nearest neighbours, the pairs a model accepts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions import vectors
from ..functions.color import ciede2000_lab
from ..functions.numeric import delta_e, light_gap
from ..store import materialize
from .passes import whole_units

BLOCK = 2048
# Rows of the left block handled per matrix product: bounds the kernel's memory.
STRIP = 512
STRIP_VALUES = 1 << 19
# Pairs that leave a kernel at a time, and pair differences held at a time.
EMIT = 1 << 15
HELD = 1 << 21


# Pivots per large image, and the most slabs along one of them.
PIVOTS = 8
SLABS = 64
# Blocks of an image whose blocks are smaller than ``BLOCK``: their pairs grow with the square of this.
FEW_BLOCKS = 64
# The same where blocks may grow beyond ``BLOCK``, up to so many vector entries in one of them.
WIDE_BLOCKS = 8
WIDE_VALUES = 1 << 21
# The same for kernels that take long for each pair or give many: more groups, which are dealt out evenly.
DENSE_BLOCKS = 16
# Columns that a row is compared with at a time, so that what is held stays in the cache, and colour distances measured at a time.
CACHED = 1 << 10
COLORS = 1 << 14


def _large_images(features: DataFrame, block: int, key: str, vector: str | None = None, wide: int | None = None) -> DataFrame:
    """Images above ``block`` rows: rows of a block and number of blocks.

    Blocks grow with the image up to ``BLOCK`` rows, so that a small ``block`` does not make a number of
    block pairs that grows with the square of the image.  With ``vector`` they grow until ``WIDE_VALUES``.
    """
    few, most, length = FEW_BLOCKS, F.lit(BLOCK), F.lit(1)
    if vector is not None:
        few, most, length = wide or WIDE_BLOCKS, F.greatest(F.lit(BLOCK), F.floor(F.lit(WIDE_VALUES) / F.col("_length"))), F.greatest(F.size(vector), F.lit(1))
    return (
        features.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"), F.max(length).alias("_length"))
        .filter(F.col("_rows") > block)
        .withColumn("_block_rows", F.greatest(F.lit(block), F.least(most, F.ceil(F.col("_rows") / few))))
        .select(key, F.ceil(F.col("_rows") / F.col("_block_rows")).cast("int").alias("_blocks"), "_block_rows")
    )


def blocked(
    features: DataFrame, block: int = BLOCK, key: str = "image_id", index: str = "hold_index", vector: str | None = None, wide: int | None = None
) -> DataFrame:
    """Copy every row to the block pairs (lo, hi) of its image it takes part in.

    An image of n rows has ceil(n / block) hash blocks; most images have one and are not copied.  Kernels
    that hold little per pair name their ``vector``: blocks then grow, and a row has ``wide`` (``WIDE_BLOCKS``)
    copies at most until a block holds ``WIDE_VALUES`` entries.
    """
    large = _large_images(features, block, key, vector, wide)
    blocks = F.coalesce(F.col("_blocks"), F.lit(1))
    mine = F.pmod(F.xxhash64(index), blocks).cast("int")
    placed = features.join(large, key, "left").withColumn("_block", mine)
    return (
        placed.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"_lo": F.least("_block", "_other"), "_hi": F.greatest("_block", "_other")})
        .drop("_blocks", "_block_rows", "_other")
    )


def block_pairs(blocks: DataFrame, key: str = "image_id"):
    """Groups of block pairs.  Few bytes of them make long work, so their partitions are not joined by size."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, key, "_lo", "_hi").groupBy(key, "_lo", "_hi")


def _reach(metric: str, max_distance: float) -> float:
    """The bound as a distance that obeys the triangle inequality: an angle, or a length."""
    if metric == "sq_l2":
        return float(np.sqrt(max(max_distance, 0.0))) + 1e-6
    return float(np.arccos(np.clip(1.0 - max_distance, -1.0, 1.0))) + 1e-6


def _pivot_distances(metric: str):
    """Distances of each vector to the pivots of its image."""

    def run(column: pa.Array, pivots: pa.Array) -> pa.Array:
        rows = matrix(pa.chunked_array([column]))
        many = len(pivots[0]) if len(pivots) else 0
        points = pivots.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), many, -1)
        if metric == "cosine":
            scaled = points / np.maximum(np.linalg.norm(points, axis=2, keepdims=True), vectors.NORM_FLOOR)
            far = np.arccos(np.clip(np.einsum("nd,npd->np", unit_rows(rows), scaled), -1.0, 1.0))
        else:
            far = np.linalg.norm(rows[:, None, :] - points, axis=2)
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * many)
        return pa.ListArray.from_arrays(offsets, pa.array(far.ravel()))

    return arrow_udf(run, "array<double>")


def _slab(value: Column, bounds: Column, slabs: Column) -> Column:
    """Number of the slab of ``value`` among ``slabs`` of about equal size, from quantiles."""
    below = F.size(F.filter(bounds, lambda q: q < value))
    return F.floor(below * slabs / SLABS).cast("int")


def pivot_blocks(
    features: DataFrame, large: DataFrame, block: int, metric: str, key: str, index: str, vector: str
) -> DataFrame:
    """Rows of the ``large`` images with ``_far`` (distances to the image's pivots) and ``_block``.

    Blocks are slabs by the distance to the first pivot, cut again by the second one, so a block
    spans short intervals of both; a slab that stays too large is split by hash.
    """
    rows = features.join(large, key)
    first = Window.partitionBy(key).orderBy(F.xxhash64(index), F.col(index))
    chosen = rows.select(key, index, F.col(vector).cast("array<double>").alias("_p")).withColumn("_n", F.row_number().over(first))
    pivots = chosen.filter(F.col("_n") <= PIVOTS).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_n", "_p")))["_p"].alias("_pivots"))
    measured = rows.join(pivots, key).withColumn("_far", _pivot_distances(metric)(F.col(vector).cast("array<double>"), F.col("_pivots"))).drop("_pivots")
    stored, _ = materialize(measured)
    fractions = [k / SLABS for k in range(1, SLABS)]
    along = F.least(F.ceil(F.sqrt("_blocks")), F.lit(SLABS)).cast("int")
    across = F.least(F.ceil(F.col("_blocks") / along), F.lit(SLABS)).cast("int")
    far = lambda k: F.coalesce(F.get("_far", F.lit(k)), F.lit(0.0))
    bounds = stored.groupBy(key).agg(F.percentile_approx(far(0), fractions).alias("_bounds"))
    slabs = stored.join(bounds, key).withColumn("_slab", _slab(far(0), F.col("_bounds"), along)).drop("_bounds")
    bounds = slabs.groupBy(key, "_slab").agg(F.percentile_approx(far(1), fractions).alias("_bounds"))
    cells = slabs.join(bounds, [key, "_slab"]).withColumn("_cell", F.col("_slab") * SLABS + _slab(far(1), F.col("_bounds"), across)).drop("_bounds", "_slab")
    sizes = cells.groupBy(key, "_cell").agg(F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(block), F.first("_block_rows"))).alias("_parts"))
    part = F.pmod(F.xxhash64(index), F.col("_parts"))
    placed = cells.join(sizes, [key, "_cell"]).withColumn("_block", F.col("_cell").cast("bigint") * (1 << 32) + part)
    return materialize(placed.drop("_cell", "_parts", "_blocks", "_block_rows"))[0]


def meeting_blocks(placed: DataFrame, reach: float, key: str) -> DataFrame:
    """Block pairs ``_lo`` <= ``_hi`` of ``pivot_blocks`` that can hold a pair within ``reach``.

    By the triangle inequality two rows that near differ by at most ``reach`` in their distance to any
    pivot, so the intervals of their blocks come as near for every pivot.
    """
    ends = placed.select(key, "_block", F.posexplode("_far").alias("_k", "_d")).groupBy(key, "_block", "_k").agg(F.min("_d").alias("low"), F.max("_d").alias("high"))
    spans = ends.groupBy(key, "_block").agg(F.sort_array(F.collect_list(F.struct("_k", "low", "high"))).alias("s"))
    spans, _ = materialize(spans)
    left, right = [spans.select(key, F.col("_block").alias(b), F.col("s").alias(s)) for b, s in (("_lo", "x"), ("_hi", "y"))]
    apart = F.exists(F.zip_with("x", "y", lambda x, y: (x["low"] > y["high"] + reach) | (y["low"] > x["high"] + reach)), lambda v: v)
    return left.join(right, key).filter((F.col("_lo") <= F.col("_hi")) & ~apart).select(key, "_lo", "_hi")


def pruned(
    features: DataFrame, large: DataFrame, reach: float, block: int, metric: str, key: str, index: str, vector: str
) -> DataFrame:
    """Like ``blocked`` for the ``large`` images, but without their block pairs that lie too far apart."""
    placed = pivot_blocks(features, large, block, metric, key, index, vector)
    meeting, _ = materialize(meeting_blocks(placed, reach, key))
    sides = meeting.withColumn("_block", F.explode(F.array_distinct(F.array("_lo", "_hi"))))
    return placed.drop("_far").join(sides.hint("merge"), [key, "_block"])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List column of equal lengths to a float64 matrix."""
    values = column.combine_chunks()
    if not len(values):
        return np.zeros((0, 0))
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def unit_rows(values: np.ndarray) -> np.ndarray:
    return values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), vectors.NORM_FLOOR)


def block_sides(table: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    """Left rows, right rows and whether the pair of blocks is a block with itself."""
    lo, hi = table["_lo"][0].as_py(), table["_hi"][0].as_py()
    if lo == hi:
        return table, table, True
    mine = pc.equal(table["_block"], lo)
    return table.filter(mine), table.filter(pc.invert(mine)), False


def _measured(left: np.ndarray | None, right: np.ndarray | None, n: int, m: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row and column sets to compare: all, or those where at least one side is marked."""
    if left is None:
        return [(np.arange(n), np.arange(m))]
    return [(np.flatnonzero(left), np.arange(m)), (np.flatnonzero(~left), np.flatnonzero(right))]


def strips(
    left: pa.Table, right: pa.Table, same: bool, index: str = "hold_index"
) -> Iterator[tuple[slice, np.ndarray]]:
    """Strips of left rows with the mask of unordered pairs they own."""
    ids, others = left[index].to_numpy(), right[index].to_numpy()
    for start in range(0, len(ids), STRIP):
        part = slice(start, min(start + STRIP, len(ids)))
        owned = ids[part, None] < others[None, :] if same else np.ones((part.stop - start, len(others)), bool)
        yield part, owned


def _distances(metric: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    if metric == "cosine":
        return np.clip(1.0 - left @ right.T, 0.0, 2.0)
    if metric == "inner":
        return 1.0 - left @ right.T
    squares = (left * left).sum(1)[:, None] + (right * right).sum(1)[None, :]
    return np.maximum(squares - 2.0 * (left @ right.T), 0.0)


def _streamed(kernel: Callable[[pa.Table], Iterator[pa.Table]]):
    """A kernel over the rows of a group that gives its result in parts, so that no group's pairs are held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            for part in kernel(pa.Table.from_batches(held)):
                yield from part.combine_chunks().to_batches()

    # Spark tells the two forms apart by the types, which have to be at hand where the kernel is read.
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _pair_rows(
    left: pa.Table, right: pa.Table, r: np.ndarray, c: np.ndarray, values: Sequence[np.ndarray], names: Sequence[str], key: str, index: str, carry: Sequence[str]
) -> Iterator[pa.Table]:
    """Rows key, i, j, values, carried columns of the pairs (r, c), at most ``EMIT`` at a time."""
    left, right = (t.select(list(dict.fromkeys([key, index, *carry]))).combine_chunks() for t in (left, right))
    for start in range(0, len(r), EMIT):
        part = slice(start, start + EMIT)
        a, b = left.take(pa.array(r[part])), right.take(pa.array(c[part]))
        # Between different blocks the smaller index may sit on either side.
        swap = pc.greater(a[index], b[index])
        first = lambda name: pc.if_else(swap, b[name], a[name])  # noqa: B023, E731
        second = lambda name: pc.if_else(swap, a[name], b[name])  # noqa: B023, E731
        columns = [a[key], first(index), second(index), *[pa.array(v[part]) for v in values]]
        for name in carry:
            columns += [first(name), second(name)]
        yield pa.table(columns, names=list(names))


def _joined(parts: Sequence[Sequence[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(v) for v in zip(*parts, strict=True)]


def _even_parts(table: pa.Table, ends: Sequence[int], vector: str) -> Iterator[tuple[pa.Table, Sequence[int]]]:
    """The table as it is, or unit by unit where the vectors of its units differ in length."""
    lengths = pc.min_max(pc.list_value_length(table[vector])).as_py()
    if lengths["min"] == lengths["max"]:
        yield table, ends
        return
    for start, end in zip([0, *ends], ends, strict=False):
        yield table.slice(start, end - start), [end - start]


def color_lookup(left: np.ndarray, right: np.ndarray):
    """Colour distances of row pairs (r, c); where colours repeat, each pair of colours is measured once."""
    few, a = np.unique(left, axis=0, return_inverse=True)
    many, b = np.unique(right, axis=0, return_inverse=True)
    if 4 * len(few) * len(many) > min(len(left) * len(right), 2 * HELD):
        return lambda r, c: np.concatenate([np.zeros(0), *[delta_e(left[r[k]], right[c[k]]) for k in _slices(len(r), COLORS)]])
    table = np.concatenate([delta_e(few[k : k + 64, None], many[None]) for k in range(0, len(few), 64)]) if len(few) else np.zeros((0, 0))
    a, b = a.ravel(), b.ravel()
    return lambda r, c: table[a[r], b[c]]


def similarity_join(
    features: DataFrame,
    max_distance: float,
    *,
    metric: str = "cosine",
    carry: Sequence[str] = (),
    strict: bool = False,
    marked: str | None = None,
    block: int = BLOCK,
    key: str = "image_id",
    index: str = "hold_index",
    vector: str = "embedding",
    measures: Sequence[str] = (),
    measure: Callable | None = None,
    using: Sequence[str] = (),
    floor: Callable | None = None,
) -> DataFrame:
    """Unordered pairs i < j of one image within ``max_distance``: key, i, j, dist, measures, carried columns.

    ``metric`` is ``cosine``, ``sq_l2`` or ``inner`` (1 - dot product, no scaling).  Carried columns come back as ``<name>_i`` and ``<name>_j``.  With a boolean column ``marked`` only pairs
    with at least one marked row are measured.

    ``measure(left, right)`` takes the columns ``vector`` and ``using`` of two blocks as matrices by name
    and returns a function of (rows, rows, distances) that gives the new distances, a mask of pairs to
    keep and one array for each name of ``measures``; pairs it drops never leave the kernel.  ``floor`` takes the
    first such column of two sets of rows and gives, for all their pairs, what the distance must leave below
    ``max_distance`` for ``measure`` to keep a pair: pairs without that are not given to it.
    """
    if metric not in {"cosine", "sq_l2", "inner"}:
        raise ValueError(f"unknown metric {metric!r}")
    types = {f.name: f.dataType for f in features.schema.fields}
    fields = [T.StructField(key, types[key]), T.StructField("i", types[index]), T.StructField("j", types[index])]
    fields += [T.StructField(name, T.DoubleType()) for name in ("dist", *measures)]
    fields += [T.StructField(f"{name}_{side}", types[name]) for name in carry for side in "ij"]
    names = [f.name for f in fields]

    def judged(left: pa.Table, right: pa.Table):
        return None if measure is None else measure(*[{name: matrix(t[name]) for name in (vector, *using)} for t in (left, right)])

    def lows(table: pa.Table) -> np.ndarray | None:
        return None if floor is None else matrix(table[using[0]])

    def near_pairs(lv, rv, ids, others, flags, same, low=(None, None)) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, rows and distances of the near pairs of two matrices, by strips."""
        for some, against in _measured(*flags, len(ids), len(others)):
            step = max(1, min(STRIP, STRIP_VALUES // max(1, len(against))))
            for start in range(0, len(some) if len(against) else 0, step):
                part = some[start : start + step]
                d = _distances(metric, lv[part], rv[against])
                near = (d < max_distance) if strict else (d <= max_distance)
                if floor is not None:
                    near &= d + floor(low[0][part], low[1][against]) <= max_distance
                if same:
                    near &= ids[part, None] < others[None, against]
                r, c = np.nonzero(near)
                yield part[r], against[c], d[r, c]

    def rows_of(left, right, judge, r, c, d) -> Iterator[pa.Table]:
        for at in range(0, len(r), EMIT):
            x, y, found = r[at : at + EMIT], c[at : at + EMIT], [d[at : at + EMIT]]
            if judge is not None:
                dist, keep, more = judge(x, y, found[0])
                x, y, found = x[keep], y[keep], [v[keep] for v in (dist, *more)]
            yield from _pair_rows(left, right, x, y, found, names, key, index, carry)

    def kernel(table: pa.Table) -> Iterator[pa.Table]:
        left, right, same = block_sides(table)
        if not len(left) or not len(right):
            return
        lv, rv = matrix(left[vector]), matrix(right[vector])
        judge = judged(left, right)
        if metric == "cosine":
            lv, rv = unit_rows(lv), unit_rows(rv)
        ids, others = left[index].to_numpy(), right[index].to_numpy()
        flags = [None if marked is None else t[marked].to_numpy() for t in (left, right)]
        for r, c, d in near_pairs(lv, rv, ids, others, flags, same, (lows(left), lows(right))):
            yield from rows_of(left, right, judge, r, c, d)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small images, many at a time: their pairs leave together."""
        for whole, ends in whole_units(batches, key, max(BLOCK, block)):
            for table, ends in _even_parts(whole, ends, vector):
                values, ids = matrix(table[vector]), table[index].to_numpy()
                if metric == "cosine":
                    values = unit_rows(values)
                flags = None if marked is None else table[marked].to_numpy()
                judge, low, held, size, start = judged(table, table), lows(table), [], 0, 0
                for end in ends:
                    rows, mine = slice(start, end), None if flags is None else flags[start:end]
                    some = None if low is None else low[rows]
                    for r, c, d in near_pairs(values[rows], values[rows], ids[rows], ids[rows], (mine, mine), True, (some, some)):
                        held.append((r + start, c + start, d))
                        size += len(r)
                        if size >= EMIT:
                            for part in rows_of(table, table, judge, *_joined(held)):
                                yield from part.combine_chunks().to_batches()
                            held, size = [], 0
                    start = end
                for part in rows_of(table, table, judge, *_joined(held)) if size else ():
                    yield from part.combine_chunks().to_batches()

    used = features.select(*dict.fromkeys([key, index, vector, *using, *([marked] if marked else []), *carry]))
    reach = _reach(metric, max_distance)
    # A dot product without scaling obeys no triangle inequality, and no block lies apart from a right angle or more.
    bounded = metric == "sq_l2" or (metric == "cosine" and reach < np.pi / 2)
    large, many = materialize(_large_images(used, block, key))
    schema = T.StructType(fields)
    small = used.join(large, key, "left_anti") if many else used
    found = small.repartition(key).sortWithinPartitions(key).mapInArrow(walk, schema)
    if not many:
        return found
    rest = used.join(large, key, "left_semi")
    if bounded:
        groups = pruned(rest, large, reach, block, metric, key, index, vector).groupBy(key, "_lo", "_hi")
    else:
        groups = block_pairs(blocked(rest, block, key, index, vector, DENSE_BLOCKS), key)
    return found.unionByName(groups.applyInArrow(_streamed(kernel), schema))


def blended_join(
    features: DataFrame, max_distance: float, color_weight: float, *, carry: Sequence[str] = (), block: int = BLOCK
) -> DataFrame:
    """Pairs whose blend of cosine and colour distance is within ``max_distance``.

    Colour distances are never negative, so the embedding part alone may be at most
    ``max_distance * (1 + weight)``, less the gap in lightness: only such pairs get a colour distance, inside the kernel.
    """
    if color_weight == 0:
        return similarity_join(features, max_distance, carry=carry, block=block)
    bound = max_distance * (1.0 + color_weight)

    def measure(left, right):
        color = color_lookup(left["lab"], right["lab"])

        def judge(r, c, d):
            far = color(r, c)
            mixed = (d + color_weight * far) / (1.0 + color_weight)
            return mixed, mixed <= max_distance, (d, far)

        return judge

    def floor(left, right):
        return color_weight * light_gap(left[:, None, 0], right[None, :, 0])

    return similarity_join(
        features, bound + 1e-9, carry=carry, block=block, measures=("d_embedding", "d_color"), measure=measure, using=("lab",),
        floor=floor if color_weight > 0 else None,
    )


def pair_counts(features: DataFrame, key: str = "image_id") -> DataFrame:
    """Number of unordered pairs per image, in closed form."""
    n = F.count(F.lit(1)).cast("bigint")
    return features.groupBy(key).agg(n.alias("holds"), F.floor(n * (n - 1) / 2).alias("pairs"))


def color_pair_features(lab_i: Column, lab_j: Column) -> Column:
    """Colour distance, absolute LAB difference, LAB mean: seven values."""
    lab = lambda v, k: v[k].cast("double")
    return F.concat(
        F.array(ciede2000_lab(lab_i, lab_j)),
        F.array(*[F.abs(lab(lab_i, k) - lab(lab_j, k)) for k in range(3)]),
        F.array(*[(lab(lab_i, k) + lab(lab_j, k)) / 2.0 for k in range(3)]),
    )


def pair_features(pairs: DataFrame) -> DataFrame:
    """``features``: |a - b|, a * b and the colour part.  Needs embedding_i/_j and lab_i/_j."""
    a, b = vectors.doubles(F.col("embedding_i")), vectors.doubles(F.col("embedding_j"))
    return pairs.withColumn(
        "features",
        F.concat(
            F.zip_with(a, b, lambda x, y: F.abs(x - y)),
            F.zip_with(a, b, lambda x, y: x * y),
            color_pair_features(F.col("lab_i"), F.col("lab_j")),
        ),
    )


def feature_sums(left: dict[str, np.ndarray], right: dict[str, np.ndarray]):
    """A measure of ``similarity_join``: per pair the sums of |a - b| and a * b, the colour distance, the gap in light and the mean of b."""

    def judge(r, c, d):
        rows = [_feature_rows(left["embedding"][r[k]], right["embedding"][c[k]], left["lab"][r[k]], right["lab"][c[k]]) for k in _slices(len(r), 4096)]
        size = left["embedding"].shape[1]
        sums = [(x[:, :size].sum(1), x[:, size : 2 * size].sum(1), x[:, 2 * size], x[:, 2 * size + 1], x[:, -1]) for x in rows]
        return d, np.ones(len(r), bool), [np.concatenate(v) for v in zip(*sums, strict=True)] if sums else [np.zeros(0)] * 5

    return judge


def _slices(n: int, step: int) -> list[slice]:
    return [slice(k, k + step) for k in range(0, n, step)]


def _feature_rows(a: np.ndarray, b: np.ndarray, lab_a: np.ndarray, lab_b: np.ndarray) -> np.ndarray:
    distance = delta_e(lab_a, lab_b)
    return np.hstack(
        [np.abs(a - b), a * b, distance[:, None], np.abs(lab_a - lab_b), (lab_a + lab_b) / 2.0]
    )


def score_pairs(
    features: DataFrame,
    weights: dict[str, np.ndarray],
    *,
    threshold: float = 0.5,
    carry: Sequence[str] = (),
    block: int = BLOCK,
    key: str = "image_id",
    index: str = "hold_index",
) -> DataFrame:
    """Pairs a two-layer head accepts: key, i, j, probability.

    ``weights``: w1 (inputs x hidden), b1, w2 (hidden), b2.  The model travels with the task
    closure; pairs live only as strips inside the kernel.  Since |a - b| = 2 max(a, b) - a - b, only the maxima
    and the products take work for each pair, one matrix product per row or unit.  A colour distance lies within
    0 and 1, and is measured only where the head can accept a pair for some value of it.
    """
    types = {f.name: f.dataType for f in features.schema.fields}
    fields = [T.StructField(key, types[key]), T.StructField("i", types[index]), T.StructField("j", types[index])]
    fields.append(T.StructField("probability", T.DoubleType()))
    fields += [T.StructField(f"{name}_{side}", types[name]) for name in carry for side in "ij"]
    names = [f.name for f in fields]
    w1, b1, w2, b2 = (np.asarray(weights[k], dtype=np.float64) for k in ("w1", "b1", "w2", "b2"))
    # Pairs from this logit on are judged by their probability.
    limit = -np.inf if threshold <= 0 else np.log(min(threshold, 0.999) / (1.0 - min(threshold, 0.999))) - 1e-9

    def kernel(table: pa.Table) -> Iterator[pa.Table]:
        left, right, same = (v if isinstance(v, bool) else v.sort_by(index) for v in block_sides(table))
        lv, rv, lc, rc = (matrix(t[c]) for c in ("embedding", "lab") for t in (left, right))
        ids, others = left[index].to_numpy(), right[index].to_numpy()
        if not len(ids) or not len(others):
            return
        size = lv.shape[1]
        product, color, mean = w1[size : 2 * size], w1[2 * size], w1[2 * size + 4 :] / 2.0
        gap = np.concatenate([w1[:size], w1[2 * size + 1 : 2 * size + 4]])
        mine, theirs = np.hstack([lv, lc]), np.hstack([rv, rc])
        row_units = (lc @ mean - mine @ gap + b1).T[:, :, None]
        column_units = (rc @ mean - theirs @ gap).T[:, None, :]
        twice, most = np.ascontiguousarray(2.0 * gap.T), np.where(w2 > 0, np.maximum(color, 0.0), np.minimum(color, 0.0))
        step = max(1, HELD // (4 * CACHED * len(w2)))
        for first in range(0, len(others), CACHED):
            columns = slice(first, first + CACHED)
            across = np.ascontiguousarray(theirs[columns].T)
            held = np.empty_like(across)
            # Inside of a block only later partners are measured.
            many = int(np.searchsorted(ids, others[columns][-1], side="left")) if same else len(ids)
            for start in range(0, many, step):
                part = slice(start, min(start + step, many))
                units = np.empty((len(w2), part.stop - start, across.shape[1]))
                for k, row in enumerate(mine[part]):
                    units[:, k] = twice @ np.maximum(across, row[:, None], out=held)
                best = np.full(units.shape[1:], b2)
                for unit, out in enumerate(units):
                    out += (lv[part] * product[:, unit]) @ across[:size]
                    out += row_units[unit, part]
                    out += column_units[unit, :, columns]
                    best += w2[unit] * np.maximum(out + most[unit], 0.0)
                keep = best >= limit
                if same:
                    keep &= others[None, columns] > ids[part, None]
                r, c = np.nonzero(keep)
                for k in _slices(len(r), COLORS):
                    x, y = r[k], c[k]
                    unit = units[:, x, y] + color[:, None] * delta_e(lc[part][x], rc[columns][y])
                    probability = 1.0 / (1.0 + np.exp(-(w2 @ np.maximum(unit, 0.0) + b2)))
                    found = probability >= threshold
                    yield from _pair_rows(left, right, start + x[found], first + y[found], [probability[found]], names, key, index, carry)

    used = features.select(*dict.fromkeys([key, index, "embedding", "lab", *carry]))
    return block_pairs(blocked(used, block, key, index, "embedding", DENSE_BLOCKS), key).applyInArrow(_streamed(kernel), T.StructType(fields))
