"""Density clustering by hierarchy (HDBSCAN) over cosine and colour distance.

1. Minimum spanning tree of the mutual reachability graph: images of one block are solved inside a
   kernel; larger ones by Boruvka rounds over the edges to near holds.  What those cannot decide is searched
   among all holds, by kernels that report one edge per component and block pair.
2. One ascending pass over the tree edges builds clusters, their stability and the selection.
   Edges go through in chunks of bounded size per image; cluster state is a table between chunks.
3. Points take the topmost selected cluster above the one they left, by pointer jumping.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import delta_e
from ..skew import ranked
from ..store import materialize, union_all
from .grouping import KEY, connected_components
from .pairs import BLOCK, block_pairs, block_sides, blocked, matrix, unit_rows

EDGE_CHUNK = 200_000
# Shortest length used for a density, so that coinciding points have a finite one.
LENGTH_FLOOR = 1e-12
# Distances held at a time by a kernel over two blocks.
STRIP_VALUES = 1 << 18
# Near holds that each hold keeps from each block, at least.
NEAR = 4
# Components that do not know their shortest edge are searched once fewer than one of so many do.
SURE = 4


def _block_distances(lv, rv, lc, rc, weight: float) -> np.ndarray:
    d = np.clip(1.0 - lv @ rv.T, 0.0, 2.0)
    if weight:
        d = (d + weight * delta_e(lc[:, None, :], rc[None, :, :])) / (1.0 + weight)
    return d


def _sides(table: pa.Table, weight: float):
    """Both blocks in the order of their holds, with unit vectors and colours."""
    left, right, same = block_sides(table.sort_by("hold_index"))
    lv, rv = unit_rows(matrix(left["embedding"])), unit_rows(matrix(right["embedding"]))
    lc, rc = (matrix(left["lab"]), matrix(right["lab"])) if weight else (None, None)
    return left, right, same, lv, rv, lc, rc


def _small_tree(min_samples: int, weight: float):
    """Kernel: tree edges of one image, by growing from the first hold.

    Edges are ordered by (w, lo, hi), as in the rounds for large images, so the tree is the same.
    """

    def kernel(table: pa.Table) -> pa.Table:
        ids = table["hold_index"].to_numpy()
        order = np.argsort(ids)
        ids, n = ids[order], len(ids)
        v = unit_rows(matrix(table["embedding"]))[order]
        c = matrix(table["lab"])[order] if weight else None
        d = np.empty((n, n))
        for start in range(0, n, 128):
            part = slice(start, start + 128)
            d[part] = _block_distances(v[part], v, None if c is None else c[part], c, weight)
        np.fill_diagonal(d, 0.0)
        k = min(n - 1, min_samples)
        core = np.partition(d, k, axis=1)[:, k]
        best = np.full(n, np.inf)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
        outside, at = np.ones(n, bool), 0
        lo, hi, w = [], [], []
        for _ in range(n - 1):
            outside[at] = False
            reach = np.maximum(np.maximum(d[at], core[at]), core)
            a, b = np.minimum(ids, ids[at]), np.maximum(ids, ids[at])
            closer = outside & ((reach < best) | ((reach == best) & ((a < low) | ((a == low) & (b < high)))))
            best[closer], low[closer], high[closer] = reach[closer], a[closer], b[closer]
            nearest = np.flatnonzero(outside & (best == best[outside].min()))
            at = int(nearest[np.lexsort((high[nearest], low[nearest]))[0]])
            lo.append(low[at])
            hi.append(high[at])
            w.append(best[at])
        image = pa.array([table[KEY][0].as_py()] * len(w), table.schema.field(KEY).type)
        return pa.table([image, pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(w, pa.float64())], names=[KEY, "lo", "hi", "w"])

    return kernel


def _core_distances(features: DataFrame, min_samples: int, weight: float, block: int) -> DataFrame:
    """image_id, hold_index, core, bound, near: near holds by (d, other), among them all that are nearer than ``bound``."""
    kind = features.schema[KEY].dataType.simpleString()
    most = max(NEAR, min_samples)

    def lists(mine, other, same, a, b, ca, cb):
        """Names, lengths, distances, near holds and bounds of one side, by strips."""
        names, others = mine["hold_index"].to_numpy(), other["hold_index"].to_numpy()
        step = max(1, STRIP_VALUES // max(1, len(others)))
        keep = min(most, len(others))
        for start in range(0, len(names) if keep else 0, step):
            part = slice(start, start + step)
            d = _block_distances(a[part], b, None if ca is None else ca[part], cb, weight)
            if same:
                d[names[part, None] == others[None, :]] = np.inf
            at = np.argpartition(d, keep - 1, axis=1)[:, :keep]
            near = np.take_along_axis(d, at, 1)
            ok = np.isfinite(near)
            last = np.where(ok, near, -np.inf).max(axis=1) if keep < len(others) else np.full(len(near), np.inf)
            some = ok.any(axis=1)
            yield names[part][some], ok.sum(axis=1)[some], near[ok], others[at[ok]], last[some]

    def kernel(table: pa.Table) -> pa.Table:
        left, right, same, lv, rv, lc, rc = _sides(table, weight)
        sides = ((left, right, same, lv, rv, lc, rc), (right, left, same, rv, lv, rc, lc))[: 1 if same else 2]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
        names, many, d, other, last = (np.concatenate(v) for v in zip(none, *[strip for side in sides for strip in lists(*side)], strict=True))
        offsets = pa.array(np.r_[0, np.cumsum(many)].astype(np.int32))
        near = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(d), pa.array(other)], ["d", "other"]))
        image = pa.array([table[KEY][0].as_py()] * len(names), table.schema.field(KEY).type)
        return pa.table([image, pa.array(names), near, pa.array(last)], names=[KEY, "hold_index", "near", "last"])

    schema = f"{KEY} {kind}, hold_index bigint, near array<struct<d:double,other:bigint>>, last double"
    found = block_pairs(blocked(features, block, vector="embedding")).applyInArrow(kernel, schema)
    # Per hold a bounded number of values from each block: sorted arrays of bounded length.
    sides = found.groupBy(KEY, "hold_index").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"), F.min("last").alias("bound"))
    core = F.element_at(F.slice(F.col("near.d"), 1, min_samples), -1)
    first = lambda x, place: (x["d"] < F.col("bound")) | (place <= min_samples)
    return sides.select(KEY, "hold_index", core.alias("core"), "bound", F.filter("near", first).alias("near"))


def _near_edges(cores: DataFrame) -> DataFrame:
    """Edges to near holds: image_id, components a and b, e (w, lo, hi).  Both ends see the same length."""
    near = cores.select(KEY, "hold_index", F.explode("near").alias("x"))
    pair = near.groupBy(KEY, F.least("hold_index", "x.other").alias("lo"), F.greatest("hold_index", "x.other").alias("hi")).agg(F.min("x.d").alias("d"))
    side = lambda name: cores.select(KEY, F.col("hold_index").alias(name), F.col("core").alias(f"core_{name}"))
    joined = pair.join(side("lo"), [KEY, "lo"]).join(side("hi"), [KEY, "hi"])
    return joined.select(KEY, F.col("lo").alias("a"), F.col("hi").alias("b"), F.struct(F.greatest("d", "core_lo", "core_hi").alias("w"), "lo", "hi").alias("e"))


def _shortest(edges: DataFrame) -> DataFrame:
    """The shortest known edge of each component: image_id, component, e."""
    ends = edges.select(KEY, F.explode(F.array("a", "b")).alias("component"), "e")
    return ends.groupBy(KEY, "component").agg(F.min("e").alias("e"))


def _searched(state: DataFrame, weight: float, block: int) -> DataFrame:
    """The shortest edge out of each component over the ``asked`` holds and all others: image_id, component, e."""
    kind = state.schema[KEY].dataType.simpleString()

    def kernel(table: pa.Table) -> pa.Table:
        left, right, same, lv, rv, lc, rc = _sides(table, weight)
        ids, others = left["hold_index"].to_numpy(), right["hold_index"].to_numpy()
        mine, theirs = left["component"].to_numpy(), right["component"].to_numpy()
        core, other_core = left["core"].to_numpy(), right["core"].to_numpy()
        asked = [t["asked"].to_numpy() for t in (left, right)]
        best = [(np.full(len(x), np.inf), np.zeros(len(x), np.int64)) for x in (ids, others)]
        rows, columns = np.arange(len(ids)), np.arange(len(others))
        # Each pair with an asked side is measured once, so that both ends see the same length.
        for some, against in ((rows[asked[0]], columns), (rows[~asked[0]], columns[asked[1]])):
            step = max(1, STRIP_VALUES // max(1, len(against)))
            for start in range(0, len(some) if len(against) else 0, step):
                part = some[start : start + step]
                d = _block_distances(lv[part], rv[against], None if lc is None else lc[part], None if rc is None else rc[against], weight)
                reach = np.maximum(np.maximum(d, core[part, None]), other_core[None, against])
                out = mine[part, None] == theirs[None, against]
                if same:
                    out |= ids[part, None] >= others[None, against]
                reach[out | np.isnan(reach)] = np.inf
                for (far, near), places, names, axis in ((best[0], part, others[against], 1), (best[1], against, ids[part], 0)):
                    # Sides are in the order of their ids, and the smaller partner wins a tie.
                    at = reach.argmin(axis=axis)
                    value, name = np.take_along_axis(reach, np.expand_dims(at, axis), axis).ravel(), names[at]
                    closer = (value < far[places]) | ((value == far[places]) & (name < near[places]))
                    far[places[closer]], near[places[closer]] = value[closer], name[closer]
        found = []
        for (far, near), names, component, ask in zip(best, (ids, others), (mine, theirs), asked, strict=True):
            keep = ask & np.isfinite(far)
            found.append((component[keep], far[keep], np.minimum(names, near)[keep], np.maximum(names, near)[keep]))
        component, w, lo, hi = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.lexsort((hi, lo, w, component))
        heads = order[np.flatnonzero(np.r_[True, np.diff(component[order]) != 0])] if len(order) else order
        image = pa.array([table[KEY][0].as_py()] * len(heads), table.schema.field(KEY).type)
        return pa.table([image, *[pa.array(v[heads]) for v in (component, w, lo, hi)]], names=[KEY, "component", "w", "lo", "hi"])

    offers = block_pairs(blocked(state, block, vector="embedding")).applyInArrow(kernel, f"{KEY} {kind}, component bigint, w double, lo bigint, hi bigint")
    return offers.groupBy(KEY, "component").agg(F.min(F.struct("w", "lo", "hi")).alias("e"))


def _large_tree(features: DataFrame, min_samples: int, weight: float, block: int) -> DataFrame | None:
    """Boruvka rounds for images of several blocks.

    An edge that is in no list of near holds is no shorter than the bound of either end.  So a component knows its
    shortest edge where that is shorter than the bounds of all its holds.  Once few components do, the others but the
    largest of each image search from those of their holds whose bound is not above the shortest edge they know.
    """
    cores, _ = materialize(_core_distances(features, min_samples, weight, block))
    edges, _ = materialize(_near_edges(cores))
    bounds = cores.select(KEY, "hold_index", "core", F.greatest("bound", "core").alias("bound"))
    state, _ = materialize(features.join(bounds, [KEY, "hold_index"]))
    names, _ = materialize(bounds.select(KEY, "hold_index", "bound", F.col("hold_index").alias("component")))
    tree = []
    while True:
        parts = names.groupBy(KEY, "component").agg(F.min("bound").alias("bound"), F.count(F.lit(1)).alias("n"))
        images = parts.groupBy(KEY).agg(F.count(F.lit(1)).alias("_parts"), F.max(F.struct("n", "component"))["component"].alias("_largest"))
        several = images.filter("_parts > 1").drop("_parts")
        known = parts.join(several, KEY).join(_shortest(edges), [KEY, "component"], "left")
        known, left = materialize(known.withColumn("sure", F.coalesce(F.col("e.w") < F.col("bound"), F.lit(False))))
        if not left:
            break
        chosen = known.filter("sure").select(KEY, "component", "e")
        if SURE * chosen.count() < left:
            unsure = known.filter(~F.col("sure") & (F.col("component") != F.col("_largest"))).select(KEY, "component", "e")
            limit = unsure.select(KEY, "component", F.lit(True).alias("_open"), F.col("e.w").alias("_w"))
            open_ = names.join(limit, [KEY, "component"], "left")
            asked = F.col("_open").isNotNull() & (F.col("_w").isNull() | (F.col("bound") <= F.col("_w")))
            marked = open_.select(KEY, "hold_index", "component", asked.alias("asked"))
            found = _searched(state.drop("bound").join(several.select(KEY), KEY, "left_semi").join(marked, [KEY, "hold_index"]), weight, block)
            found = found.withColumnRenamed("e", "_found")
            both = unsure.join(found, [KEY, "component"], "left").select(KEY, "component", F.least("e", "_found").alias("e"))
            chosen = chosen.unionByName(both.filter(F.col("e").isNotNull()))
        chosen, n = materialize(chosen.select(KEY, "e.*").distinct())
        if not n:
            break
        tree.append(chosen)
        place = names.select(KEY, "hold_index", "component")
        ends = chosen.join(place.withColumnsRenamed({"hold_index": "lo", "component": "i"}), [KEY, "lo"]).join(
            place.withColumnsRenamed({"hold_index": "hi", "component": "j"}), [KEY, "hi"]
        )
        merged, _ = materialize(connected_components(known.select(KEY, F.col("component").alias("hold_index")), ends.select(KEY, "i", "j")))
        renamed = lambda df, name: df.join(
            merged.select(KEY, F.col("hold_index").alias(name), F.col("component").alias("_new")), [KEY, name], "left"
        ).withColumn(name, F.coalesce("_new", name)).drop("_new")
        names, _ = materialize(renamed(names, "component").select(*names.columns))
        moved = renamed(renamed(edges, "a"), "b").filter("a <> b")
        edges, _ = materialize(moved.groupBy(KEY, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e")))
    return union_all(tree)


def reachability_tree(features: DataFrame, min_samples: int, color_weight: float = 0.0, block: int = BLOCK) -> DataFrame:
    """image_id, lo, hi, w: minimum spanning tree under mutual reachability."""
    columns = [KEY, "hold_index", "embedding", *(["lab"] if color_weight else [])]
    rows = features.select(*columns).withColumn("hold_index", F.col("hold_index").cast("bigint"))
    sizes, _ = materialize(rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    small = rows.join(sizes.filter(F.col("n") <= block).select(KEY), KEY)
    kind = rows.schema[KEY].dataType.simpleString()
    tree = small.groupBy(KEY).applyInArrow(_small_tree(min_samples, color_weight), f"{KEY} {kind}, lo bigint, hi bigint, w double")
    large = sizes.filter(F.col("n") > block).select(KEY)
    if large.limit(1).count():
        rest = _large_tree(rows.join(large, KEY), min_samples, color_weight, block)
        if rest is not None:
            tree = tree.unionByName(rest.select(KEY, "lo", "hi", "w"))
    return tree


# What the pass over the tree reports: renamed clusters with their state, points leaving a cluster,
# and finished clusters.
_EVENTS = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("node", T.LongType()),
        T.StructField("target", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("spine", T.LongType()),
        T.StructField("density", T.DoubleType()),
        T.StructField("inner", T.DoubleType()),
        T.StructField("selected", T.BooleanType()),
    ]
)


def _chunk_pass(min_size: int):
    """Kernel over one chunk of ascending edges of one image.

    Input rows: n (edge rank), w, and per end its cluster with size, spine, density sum and value of
    the clusters below.  A spine is a cluster of at least ``min_size`` holds, named by the edge that
    made it.
    """

    def kernel(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["n"])
        state, parent = {}, {}
        for r in rows:
            for end in "ab":
                state[r[end]] = [r[f"size_{end}"], r[f"spine_{end}"], r[f"density_{end}"], r[f"inner_{end}"], []]
        elements = list(state)
        small = {e: [e] for e in elements}
        events = []

        def find(x):
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for r in rows:
            a, b = find(r["a"]), find(r["b"])
            density = 1.0 / max(r["w"], LENGTH_FLOOR)
            sa, sb = state[a], state[b]
            size, big = sa[0] + sb[0], [s for s in (sa, sb) if s[0] >= min_size]
            leaving = [x for x, s in ((a, sa), (b, sb)) if s[0] < min_size]
            if len(big) == 2:
                value = 0.0
                for s in big:
                    stability = s[2] - s[0] * density
                    chosen = stability >= s[3]
                    value += max(stability, s[3])
                    events.append(("closed", s[1], r["n"], s[0], None, None, None, chosen))
                merged = [size, r["n"], size * density, value, []]
            elif len(big) == 1:
                merged = [size, big[0][1], big[0][2] + sum(state[x][0] for x in leaving) * density, big[0][3], []]
            elif size >= min_size:
                merged = [size, r["n"], size * density, 0.0, []]
            else:
                merged = [size, None, 0.0, 0.0, []]
            if merged[1] is not None:
                for x in leaving:
                    events += [("left", e, merged[1], None, None, None, None, None) for e in small.pop(x, ())]
            else:
                small[a] = small.pop(a, []) + small.pop(b, [])
            parent[b] = a
            state[a] = merged
        # A spine keeps counting the holds that left it: density holds their sum, size all holds.
        for e in elements:
            root = find(e)
            s = state[root]
            name = e if root == e and s[1] is None else root
            events.append(("renamed", e, name, s[0], s[1], s[2], s[3], None))
        image = pa.array([table[KEY][0].as_py()] * len(events), table.schema.field(KEY).type)
        columns = [pa.array([ev[k] for ev in events], t) for k, t in enumerate(
            [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
        )]
        return pa.table([image, *columns], names=[KEY, *_EVENTS.names])

    return kernel


def condensed(tree: DataFrame, min_size: int, chunk: int = EDGE_CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(left, closed, rest): holds with the spine they left, finished spines with their parent, unfinished ones."""
    kind = tree.schema[KEY].dataType
    edges, _ = materialize(ranked(tree, [KEY], [F.col("w"), F.col("lo"), F.col("hi")], "n"))
    ends = edges.select(KEY, F.explode(F.array("lo", "hi")).alias("hold_index")).distinct()
    clusters, _ = materialize(
        ends.select(
            KEY,
            "hold_index",
            F.col("hold_index").alias("cluster"),
            F.lit(1).cast("bigint").alias("size"),
            F.lit(None).cast("bigint").alias("spine"),
            F.lit(0.0).alias("density"),
            F.lit(0.0).alias("inner"),
        )
    )
    left, closed, start = [], [], 0
    schema = T.StructType([T.StructField(KEY, kind), *_EVENTS.fields])
    while True:
        part, found = materialize(edges.filter(F.col("n").between(start + 1, start + chunk)))
        if not found:
            break
        for mark, column in (("a", "lo"), ("b", "hi")):
            side = clusters.select(
                KEY,
                F.col("hold_index").alias(column),
                F.col("cluster").alias(mark),
                *[F.col(c).alias(f"{c}_{mark}") for c in ("size", "spine", "density", "inner")],
            )
            part = part.join(side, [KEY, column])
        events, _ = materialize(part.groupBy(KEY).applyInArrow(_chunk_pass(min_size), schema))
        closed.append(events.filter("event = 'closed'").select(KEY, F.col("node").alias("spine"), F.col("target").alias("parent"), "selected"))
        gone = events.filter("event = 'left'").select(KEY, F.col("node").alias("cluster"), F.col("target").alias("home"))
        left.append(clusters.filter(F.col("spine").isNull()).select(KEY, "hold_index", "cluster").join(gone, [KEY, "cluster"]).select(KEY, "hold_index", "home"))
        renamed = events.filter("event = 'renamed'").select(
            KEY, F.col("node").alias("cluster"), F.col("target").alias("_c"), *[F.col(c).alias(f"_{c}") for c in ("size", "spine", "density", "inner")]
        )
        touched = F.col("_c").isNotNull()
        clusters, _ = materialize(
            clusters.join(renamed, [KEY, "cluster"], "left").select(
                KEY,
                "hold_index",
                F.coalesce("_c", "cluster").alias("cluster"),
                *[F.when(touched, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("size", "spine", "density", "inner")],
            )
        )
        start += chunk
    return union_all(left), union_all(closed), clusters


def hdbscan(
    features: DataFrame,
    min_cluster_size: int = 2,
    min_samples: int | None = None,
    *,
    color_weight: float = 0.0,
    block: int = BLOCK,
    chunk: int = EDGE_CHUNK,
) -> DataFrame:
    """image_id, hold_index, component: the chosen cluster, null for noise.

    The whole image is never a cluster.
    """
    tree, found = materialize(reachability_tree(features, min_samples or min_cluster_size, color_weight, block))
    nodes = features.select(KEY, F.col("hold_index").cast("bigint").alias("hold_index"))
    if not found:
        return nodes.withColumn("component", F.lit(None).cast("bigint"))
    left, closed, _ = condensed(tree, min_cluster_size, chunk)
    homes, _ = materialize(left)
    # top: topmost chosen cluster met so far; next: where the climb stands.
    climb, open_ = materialize(
        closed.select(KEY, "spine", F.col("parent").alias("next"), F.when(F.col("selected"), F.col("spine")).alias("top"))
    )
    while open_:
        above = climb.select(KEY, F.col("spine").alias("next"), F.col("next").alias("_next"), F.col("top").alias("_top"))
        climb, _ = materialize(
            climb.join(above, [KEY, "next"], "left").select(
                KEY, "spine", F.col("_next").alias("next"), F.coalesce("_top", "top").alias("top")
            )
        )
        open_ = climb.filter(F.col("next").isNotNull()).limit(1).count()
    labels = homes.join(climb.select(KEY, F.col("spine").alias("home"), F.col("top").alias("component")), [KEY, "home"], "left")
    return nodes.join(labels.select(KEY, "hold_index", "component"), [KEY, "hold_index"], "left")
