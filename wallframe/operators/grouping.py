"""Groupings of the holds of an image.

Edges come from threshold joins (``pairs``), so only close pairs exist as rows.  All algorithms
run for every image at once; keys are (image, node), never the image alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import vectors
from ..functions.numeric import delta_e
from ..functions.vectors import mean_vector
from ..skew import hot_keys, ranked, salted_join
from ..store import discard, materialize
from .pairs import BLOCK, blended_join, block_pairs, block_sides, blocked, matrix, similarity_join
from .passes import UNIT_EDGES, split_units, whole_units

KEY = "image_id"
# Distances held at a time where each cluster looks for its nearest.
NEAREST_VALUES = 1 << 20
# Colour distances measured at a time, and what a lower bound may be too high by rounding.
COLOR_PAIRS = 1 << 14
BOUND_SLACK = 1e-9


def _both_ways(edges: DataFrame, a: str = "i", b: str = "j", extra: Sequence[str] = ()) -> DataFrame:
    forward = edges.select(KEY, F.col(a).alias("node"), F.col(b).alias("other"), *extra)
    return forward.unionByName(edges.select(KEY, F.col(b).alias("node"), F.col(a).alias("other"), *extra))


def _smallest_reachable(i: Sequence, j: Sequence) -> dict:
    """Each end of the edges with the smallest end it reaches."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i, j, strict=True):
        root.setdefault(a, a)
        root.setdefault(b, b)
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _component_pass(links: DataFrame) -> DataFrame:
    """image_id, hold_index, component of the edge ends: one pass over the edges of each image."""
    kinds = {f.name: f.dataType.simpleString() for f in links.schema.fields}

    def kernel(batches):
        for table, ends in whole_units(batches, KEY, UNIT_EDGES):
            i, j = table["i"].to_pylist(), table["j"].to_pylist()
            places, nodes, components, start = [], [], [], 0
            for end in ends:
                found = _smallest_reachable(i[start:end], j[start:end])
                places.append(np.full(len(found), start))
                nodes += found.keys()
                components += found.values()
                start = end
            images = table[KEY].take(pa.array(np.concatenate(places)))
            kind = table["i"].type
            columns = [images, pa.array(nodes, kind), pa.array(components, kind)]
            yield from pa.table(columns, names=[KEY, "hold_index", "component"]).to_batches()

    placed = links.repartition(KEY).sortWithinPartitions(KEY)
    return placed.mapInArrow(kernel, f"{KEY} {kinds[KEY]}, hold_index {kinds['i']}, component {kinds['i']}")


def connected_components(nodes: DataFrame, edges: DataFrame, most: int = UNIT_EDGES) -> DataFrame:
    """image_id, hold_index, component: the smallest ``hold_index`` reachable over the edges.

    Images of at most ``most`` edges are passed once each, larger ones go through rounds.  Nodes
    without edges enter neither.
    """
    everyone = nodes.select(KEY, "hold_index")
    links, many = materialize(edges.filter(F.col("i") != F.col("j")).select(KEY, "i", "j"))
    if not many:
        return everyone.withColumn("component", F.col("hold_index"))
    small, large = split_units(links, [KEY], most)
    named, _ = materialize(_component_pass(small))
    if large is not None:
        named = named.unionByName(_component_rounds(large))
    return everyone.join(named, [KEY, "hold_index"], "left").select(
        KEY, "hold_index", F.coalesce("component", "hold_index").alias("component")
    )


def _component_rounds(edges: DataFrame) -> DataFrame:
    """Components of large images: image_id, hold_index, component of the edge ends.

    Every round hooks each node to the neighbour (or itself) with the smallest hash, renames the
    edge ends and drops loops.  Hash order makes long sorted chains shrink by a constant share per
    round.
    """
    hashed = lambda name: F.struct(F.xxhash64(name).alias("h"), F.col(name).alias("n"))
    rounds = []
    frontier, left = materialize(edges.distinct())
    while left:
        best = _both_ways(frontier).groupBy(KEY, "node").agg(F.min(hashed("other")).alias("near"))
        hooks, _ = materialize(best.select(KEY, "node", F.least(F.col("near"), hashed("node"))["n"].alias("root")))
        rounds.append(hooks)
        renamed = (
            frontier.join(hooks.withColumnsRenamed({"node": "i", "root": "a"}), [KEY, "i"])
            .join(hooks.withColumnsRenamed({"node": "j", "root": "b"}), [KEY, "j"])
            .filter(F.col("a") != F.col("b"))
            .select(KEY, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
            .distinct()
        )
        frontier, left = materialize(renamed)
    labels = rounds[0].withColumnRenamed("root", "label")
    for hooks in rounds[1:]:
        labels = labels.join(hooks.withColumnRenamed("node", "label"), [KEY, "label"], "left").select(
            KEY, "node", F.coalesce("root", "label").alias("label")
        )
    labels, _ = materialize(labels)
    smallest = labels.groupBy(KEY, "label").agg(F.min("node").alias("component"))
    return labels.join(smallest, [KEY, "label"]).select(KEY, F.col("node").alias("hold_index"), "component")


def dbscan(nodes: DataFrame, pairs: DataFrame, eps: float = 0.3, min_samples: int = 5) -> DataFrame:
    """image_id, hold_index, is_core, component (smallest core of the cluster; null for noise).

    A node counts itself.  A border node goes to the adjacent cluster that starts first.
    """
    near, _ = materialize(pairs.filter(F.col("dist") <= eps).select(KEY, "i", "j"))
    degrees = _both_ways(near).groupBy(KEY, "node").agg(F.count(F.lit(1)).alias("degree"))
    all_nodes = nodes.select(KEY, "hold_index")
    core, _ = materialize(
        all_nodes.join(degrees.withColumnRenamed("node", "hold_index"), [KEY, "hold_index"], "left")
        .filter(F.coalesce("degree", F.lit(0)) + 1 >= min_samples)
        .select(KEY, "hold_index")
    )
    end = lambda name: core.withColumnRenamed("hold_index", name)
    inner = near.join(end("i"), [KEY, "i"], "left_semi").join(end("j"), [KEY, "j"], "left_semi")
    clusters, _ = materialize(connected_components(core, inner))
    border = (
        _both_ways(near)
        .join(clusters.withColumnRenamed("hold_index", "other"), [KEY, "other"])
        .groupBy(KEY, "node")
        .agg(F.min("component").alias("reached"))
    )
    return (
        all_nodes.join(clusters, [KEY, "hold_index"], "left")
        .join(border.withColumnRenamed("node", "hold_index"), [KEY, "hold_index"], "left")
        .select(
            KEY,
            "hold_index",
            F.col("component").isNotNull().alias("is_core"),
            F.coalesce("component", "reached").alias("component"),
        )
    )


def single_linkage(nodes: DataFrame, pairs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Single linkage cut at ``threshold`` is connectivity below it."""
    return connected_components(nodes, pairs.filter(F.col("dist") < threshold))


def _mutual_nearest(links: DataFrame) -> DataFrame:
    """Cluster pairs (a < b) that are each other's nearest, by (dist, a, b)."""
    edge = F.struct("dist", "a", "b")
    ends = links.select(KEY, edge.alias("edge"), F.explode(F.array("a", "b")).alias("end"))
    nearest = ends.groupBy(KEY, "end").agg(F.min("edge").alias("edge"))
    return (
        nearest.groupBy(KEY, F.col("edge.a").alias("a"), F.col("edge.b").alias("b"))
        .agg(F.count(F.lit(1)).alias("votes"), F.first("edge.dist").alias("dist"))
        .filter(F.col("votes") == 2)
        .select(KEY, "a", "b", "dist")
    )


def _relabel(table: DataFrame, merges: DataFrame, column: str) -> DataFrame:
    """Rename cluster ``b`` of each merge to ``a``."""
    names = merges.select(KEY, F.col("b").alias(column), F.col("a").alias("_new"))
    return table.join(names, [KEY, column], "left").withColumn(
        column, F.coalesce("_new", column)
    ).drop("_new")


def complete_linkage(nodes: DataFrame, pairs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Complete linkage cut at ``threshold``: image_id, hold_index, component.

    Clusters merge only if all their pairs are closer than the threshold, so the sparse pairs
    below it are enough: a cluster pair is alive while its pair count equals |a| * |b|.
    """
    start = pairs.filter(F.col("dist") < threshold).select(
        KEY, F.col("i").alias("a"), F.col("j").alias("b"), "dist", F.lit(1).cast("bigint").alias("n")
    )
    members, _ = materialize(nodes.select(KEY, "hold_index", F.col("hold_index").alias("component")))
    links, left = materialize(start)
    while left:
        merges, _ = materialize(_mutual_nearest(links))
        members, _ = materialize(_relabel(members, merges, "component"))
        sizes = members.groupBy(KEY, "component").agg(F.count(F.lit(1)).alias("size"))
        moved = _relabel(_relabel(links, merges, "a"), merges, "b").filter(F.col("a") != F.col("b"))
        merged = (
            moved.groupBy(KEY, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .agg(F.max("dist").alias("dist"), F.sum("n").alias("n"))
            .join(sizes.withColumnsRenamed({"component": "a", "size": "sa"}), [KEY, "a"])
            .join(sizes.withColumnsRenamed({"component": "b", "size": "sb"}), [KEY, "b"])
            .filter(F.col("n") == F.col("sa") * F.col("sb"))
        )
        links, left = materialize(merged.select(KEY, "a", "b", "dist", "n"))
    return members


def average_linkage(
    features: DataFrame, threshold: float = 0.3, color_weight: float = 0.0, block: int = BLOCK
) -> DataFrame:
    """Average linkage over cosine (and colour) distance cut at ``threshold``.

    An image of at most twice ``block`` holds is one distance matrix.  Larger ones go through rounds
    of mutually nearest clusters, which merge the same way since averages never bring clusters closer.
    """
    large, many = materialize(features.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * block).select(KEY))
    small = features.join(large, KEY, "left_anti") if many else features
    kinds = {f.name: f.dataType.simpleString() for f in features.schema.fields}
    columns = [KEY, "hold_index", vectors.unit(F.col("embedding")).alias("unit"), *([F.col("lab").cast("array<double>").alias("lab")] if color_weight else [])]

    def kernel(table: pa.Table) -> pa.Table:
        table = table.sort_by("hold_index")
        units = matrix(table["unit"])
        distances = 1.0 - units @ units.T
        if color_weight:
            labs = matrix(table["lab"])
            for row, lab in zip(distances, labs, strict=True):
                row += color_weight * delta_e(np.broadcast_to(lab, labs.shape), labs)
            distances /= 1.0 + color_weight
        first = _average_clusters(distances, threshold, np.ones(len(units)))
        return pa.table([table[KEY], table["hold_index"], table["hold_index"].take(pa.array(first))], names=[KEY, "hold_index", "component"])

    schema = f"{KEY} {kinds[KEY]}, hold_index {kinds['hold_index']}, component {kinds['hold_index']}"
    found = small.select(*columns).groupBy(KEY).applyInArrow(kernel, schema)
    if not many:
        return found
    rest = features.join(large, KEY, "left_semi")
    return found.unionByName(_nearest_rounds(rest, threshold, block, color_weight))


def _average_clusters(distances: np.ndarray, threshold: float, sizes: np.ndarray) -> np.ndarray:
    """Smallest member of each row's cluster.  Each row keeps its nearest later row, so a step is linear."""
    n = len(distances)
    label, size = np.arange(n), sizes.astype(np.float64)
    far = distances.copy()
    np.fill_diagonal(far, np.inf)
    near = far.argmin(axis=1)
    least = far[np.arange(n), near]
    while n > 1:
        a = int(least.argmin())
        if not least[a] < threshold:
            break
        a, b = sorted((a, int(near[a])))
        row = (size[a] * far[a] + size[b] * far[b]) / (size[a] + size[b])
        row[[a, b]] = np.inf
        far[a], far[:, a] = row, row
        far[b], far[:, b] = np.inf, np.inf
        size[a] += size[b]
        label[label == b] = a
        least[b] = np.inf
        # Rows whose nearest row was merged look again, others only at the merged one.
        stale = np.flatnonzero(((near == a) | (near == b)) & np.isfinite(least))
        stale = np.union1d(stale, [a])
        near[stale] = far[stale].argmin(axis=1)
        least[stale] = far[stale, near[stale]]
        closer = (row < least) | ((row == least) & (a < near))
        near[closer], least[closer] = a, row[closer]
    return label


def _nearest_rounds(features: DataFrame, threshold: float, block: int, color_weight: float = 0.0) -> DataFrame:
    """Average linkage of large images over cosine (and colour) distance.

    A cluster is the sum of its unit vectors and its size: the mean distance of two clusters is
    1 - <sum a, sum b> / (|a| |b|).  Mean colour distances do not follow from sums, so with a colour weight
    a cluster also has the colours of its members.  A cluster keeps one link, to its nearest cluster below the
    threshold, and looks again only when it or that cluster was merged; averages never bring clusters
    closer, so other links stay and a cluster without one is finished.  Equal vectors (and colours) start as one
    cluster.  An image that is down to twice ``block`` open clusters is ended as one matrix.
    """
    same = ["unit", "lab"] if color_weight else ["unit"]
    lab = [F.col("lab").cast("array<double>").alias("lab")] if color_weight else []
    holds = features.select(KEY, "hold_index", vectors.unit(F.col("embedding")).alias("unit"), *lab)
    # A zero vector is as far from its copies as from any other.
    zero = F.forall("unit", lambda x: x == 0)
    alike = holds.withColumn("alone", F.when(zero | F.lit(threshold <= 0), F.col("hold_index")))
    starts = alike.groupBy(KEY, *same, "alone").agg(F.min("hold_index").alias("component"), F.count(F.lit(1)).alias("size"))
    starts, _ = materialize(starts)
    shared = starts.filter("size > 1").select(KEY, *same, F.col("component").alias("_first"))
    copied = holds.join(shared, [KEY, *same], "left")
    members, _ = materialize(copied.select(KEY, "hold_index", F.coalesce("_first", "hold_index").alias("component")))
    no_link = F.lit(None).cast(_link_type(starts))
    clusters = starts.select(
        KEY, "component", F.transform("unit", lambda x: x * F.col("size")).alias("sum"), "size",
        *([F.concat("lab", F.array(F.col("size").cast("double"))).alias("colors")] if color_weight else []), F.lit(True).alias("stale"), no_link.alias("link"),
    )
    renames, stored = [], [starts]
    while True:
        sizes = clusters.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
        few, some = materialize(sizes.filter(F.col("n") <= 2 * block).select(KEY))
        if some:
            ended, _ = materialize(_ended(clusters.join(few, KEY, "left_semi"), threshold, color_weight, block))
            renames.append(ended)
            clusters = clusters.join(few, KEY, "left_anti")
        linked, left = materialize(_relinked(clusters, threshold, block, color_weight))
        if not left:
            break
        ends = linked.select(KEY, "link")
        mutual = ends.groupBy(KEY, "link.a", "link.b").agg(F.count(F.lit(1)).alias("votes")).filter("votes = 2")
        merges, _ = materialize(mutual.select(KEY, "a", "b"))
        renames.append(merges)
        clusters, _ = materialize(_merged(linked, merges))
        for table in stored:
            discard(table)
        stored = [linked, clusters]
        if len(renames) >= 8:
            members, renames = materialize(_renamed(members, renames))[0], []
    return _renamed(members, renames)


def _renamed(members: DataFrame, renames: Sequence[DataFrame]) -> DataFrame:
    for merges in renames:
        members = _relabel(members, merges, "component")
    return members


def _link_type(clusters: DataFrame) -> str:
    kind = clusters.schema["component"].dataType.simpleString()
    return f"struct<dist:double,a:{kind},b:{kind}>"


class _Colors(NamedTuple):
    """Colours of the members of clusters: rows of L, a, b and weight, and per cluster its first row, rows, weight and mean L."""

    rows: np.ndarray
    first: np.ndarray
    many: np.ndarray
    weight: np.ndarray
    light: np.ndarray

    def some(self, clusters: np.ndarray) -> _Colors:
        return _Colors(self.rows, *[v[clusters] for v in self[1:]])


def _colors(column: pa.ChunkedArray) -> _Colors:
    values = column.combine_chunks()
    many = values.value_lengths().to_numpy() // 4
    rows, first = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 4), np.cumsum(many) - many
    weight, light = [np.add.reduceat(v, first) if len(first) else np.zeros(0) for v in (rows[:, 3], rows[:, 0] * rows[:, 3])]
    return _Colors(rows, first, many, weight, light / weight)


def _color_totals(left: _Colors, right: _Colors, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sums of the colour distances between the members of the cluster pairs (r, c), some member pairs at a time."""
    out = np.zeros(len(r))
    ends = np.cumsum(left.many[r].astype(np.int64) * right.many[c])
    start = 0
    while start < len(r):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + COLOR_PAIRS, side="right")))
        a, b = r[start:end], c[start:end]
        if ends[end - 1] - before > COLOR_PAIRS:
            out[start] = _color_total(*[s.rows[s.first[k] : s.first[k] + s.many[k]] for s, k in ((left, a[0]), (right, b[0]))])
        else:
            many, wide = left.many[a] * right.many[b], right.many[b]
            heads = np.cumsum(many) - many
            pair = np.repeat(np.arange(len(a)), many)
            at = np.arange(len(pair)) - heads[pair]
            x = left.rows[left.first[a][pair] + at // wide[pair]]
            y = right.rows[right.first[b][pair] + at % wide[pair]]
            out[start:end] = np.add.reduceat(delta_e(x[:, :3], y[:, :3]) * x[:, 3] * y[:, 3], heads)
        start = end
    return out


def _color_total(x: np.ndarray, y: np.ndarray) -> float:
    """The same for one pair of clusters, by strips."""
    step = max(1, COLOR_PAIRS // len(y))
    return sum(float(x[k : k + step, 3] @ (delta_e(x[k : k + step, None, :3], y[None, :, :3]) @ y[:, 3])) for k in range(0, len(x), step))


def _light_gaps(left: _Colors, right: _Colors) -> np.ndarray:
    """Lower bounds of the mean colour distances of all cluster pairs, from their mean lightness.

    CIEDE2000 is at least its lightness term |L - L'| / (1 + s), where s grows with the distance of the pair's mean from 50;
    the other terms together are never negative.  The mean of |L - L'| is at least the difference of the means.
    """
    light = np.concatenate([left.rows[:, 0], right.rows[:, 0]])
    light = light[np.isfinite(light)]
    if not len(light):
        return np.zeros((len(left.first), len(right.first)))
    spread = np.abs(light - 50.0).max() ** 2
    slope = 1.0 / (100.0 * (1.0 + 0.015 * spread / np.sqrt(20.0 + spread)))
    # Distances are cut at 1, and so is the bound.
    slope = min(slope, 1.0 / max(np.ptp(light), 1.0))
    with np.errstate(invalid="ignore"):
        gaps = slope * np.abs(left.light[:, None] - right.light[None, :])
    return np.nan_to_num(gaps, nan=0.0, posinf=0.0)


def _nearest_blends(
    d: np.ndarray, colors: list[_Colors], weight: float, threshold: float, mine: np.ndarray, theirs: np.ndarray
) -> np.ndarray:
    """Blended distances of the cluster pairs that may be the nearest of either side, infinite for the others.

    ``mine`` and ``theirs`` are the smallest distances found so far.  A lower bound for each pair comes first: some pairs of
    each row with the smallest bounds are measured, then all others whose bound is not above what both sides have.
    """
    low = (d + weight * _light_gaps(*colors)) / (1.0 + weight) - BOUND_SLACK
    out = np.full(d.shape, np.inf)

    def measure(mask: np.ndarray) -> None:
        r, c = np.nonzero(mask)
        for start in range(0, len(r), COLOR_PAIRS):
            x, y = r[start : start + COLOR_PAIRS], c[start : start + COLOR_PAIRS]
            color = _color_totals(*colors, x, y) / (colors[0].weight[x] * colors[1].weight[y])
            found = (d[x, y] + weight * color) / (1.0 + weight)
            out[x, y] = np.where(np.isnan(found), np.inf, found)

    open_ = low < threshold
    first = open_ & (low <= np.partition(low, low.shape[1] // 32, axis=1)[:, low.shape[1] // 32, None])
    measure(first)
    reach = np.maximum(np.minimum(mine, out.min(axis=1))[:, None], np.minimum(theirs, out.min(axis=0))[None, :])
    measure(open_ & ~first & (low <= reach))
    return out


def _relinked(clusters: DataFrame, threshold: float, block: int, color_weight: float = 0.0) -> DataFrame:
    """Clusters with their nearest one below the threshold, by (dist, a, b); those without are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in clusters.schema.fields}

    def kernel(table: pa.Table) -> pa.Table:
        left, right, same = block_sides(table.sort_by("component"))
        ids, others = left["component"].to_numpy(), right["component"].to_numpy()
        centers = [matrix(t["sum"]) / t["size"].to_numpy()[:, None] for t in (left, right) if len(t)]
        stale = [t["stale"].to_numpy() for t in (left, right)]
        colors = [_colors(t["colors"]) for t in (left, right)] if color_weight else None
        best = [(np.full(len(x), np.inf), np.zeros(len(x), x.dtype)) for x in (ids, others)]
        rows, columns = np.arange(len(ids)), np.arange(len(others))
        # Each pair with a stale side is measured once, so that both sides see the same distance.
        for some, against in ((rows[stale[0]], columns), (rows[~stale[0]], columns[stale[1]])):
            step = max(1, NEAREST_VALUES // max(1, len(against)))
            for start in range(0, len(some) if len(against) else 0, step):
                part = some[start : start + step]
                d = 1.0 - centers[0][part] @ centers[-1][against].T
                if same:
                    d[ids[part, None] >= others[None, against]] = np.inf
                if color_weight:
                    d = _nearest_blends(d, [colors[0].some(part), colors[1].some(against)], color_weight, threshold, best[0][0][part], best[1][0][against])
                for (far, near), mine, theirs, axis in ((best[0], part, others[against], 1), (best[1], against, ids[part], 0)):
                    # Sides are in the order of their ids, and the smaller one wins a tie.
                    at = d.argmin(axis=axis)
                    value, name = np.take_along_axis(d, np.expand_dims(at, axis), axis).ravel(), theirs[at]
                    closer = (value < far[mine]) | ((value == far[mine]) & (name < near[mine]))
                    far[mine[closer]], near[mine[closer]] = value[closer], name[closer]
        found = []
        for (far, near), names, asks in zip(best, (ids, others), stale, strict=True):
            keep = asks & (far < threshold)
            found.append((names[keep], far[keep], np.minimum(names, near)[keep], np.maximum(names, near)[keep]))
        columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
        image = pa.array([table[KEY][0].as_py()] * len(columns[0]), table.schema.field(KEY).type)
        return pa.table([image, *columns], names=[KEY, "component", "dist", "a", "b"])

    kind = kinds["component"]
    schema = f"{KEY} {kinds[KEY]}, component {kind}, dist double, a {kind}, b {kind}"
    carried = ["colors"] if color_weight else []
    asked = blocked(clusters.select(KEY, "component", "sum", "size", "stale", *carried), block, index="component", vector="sum")
    found = asked.groupBy(KEY, "_lo", "_hi").applyInArrow(kernel, schema)
    nearest = found.groupBy(KEY, "component").agg(F.min(F.struct("dist", "a", "b")).alias("_found"))
    link = F.when(F.col("stale"), F.col("_found")).otherwise(F.col("link"))
    linked = clusters.join(nearest, [KEY, "component"], "left").withColumn("link", link).drop("_found")
    return linked.filter(F.col("link").isNotNull())


def _merged(linked: DataFrame, merges: DataFrame) -> DataFrame:
    """Clusters after the merges; stale are merged ones and those whose nearest was merged.

    Rounding may leave an image without a merge, where old and new links differ; all of it is then stale.
    """
    ends = merges.select(KEY, F.explode(F.array("a", "b")).alias("_end"), F.col("a").alias("_into"))
    other = F.when(F.col("link.a") == F.col("component"), F.col("link.b")).otherwise(F.col("link.a"))
    mine = ends.withColumnsRenamed({"_end": "component"})
    theirs = ends.select(KEY, F.col("_end").alias("_other"), F.lit(True).alias("_moved"))
    moving = merges.select(KEY, F.lit(True).alias("_moving")).distinct()
    placed = (
        linked.withColumn("_other", other)
        .join(mine, [KEY, "component"], "left")
        .join(theirs, [KEY, "_other"], "left")
        .join(moving, KEY, "left")
    )
    stale = F.col("_moved").isNotNull() | F.col("_moving").isNull()
    carried = ["colors"] if "colors" in linked.columns else []
    kept = placed.filter(F.col("_into").isNull()).select(KEY, "component", "sum", "size", *carried, stale.alias("stale"), "link")
    pair = placed.filter(F.col("_into").isNotNull()).groupBy(KEY, "_into").agg(
        F.collect_list("sum").alias("both"), F.sum("size").alias("size"), F.first("link").alias("link"),
        *[F.flatten(F.collect_list(name)).alias(name) for name in carried],
    )
    grown = pair.select(
        KEY, F.col("_into").alias("component"), F.zip_with(F.col("both")[0], F.col("both")[1], lambda x, y: x + y).alias("sum"),
        "size", *carried, F.lit(True).alias("stale"), "link",
    )
    return kept.unionByName(grown)


def _ended(clusters: DataFrame, threshold: float, color_weight: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Merges (b into a) of images whose open clusters are one matrix each."""
    kinds = {f.name: f.dataType.simpleString() for f in clusters.schema.fields}

    def ended(table: pa.Table, totals: pa.Table | None = None) -> pa.Table:
        table = table.sort_by("component")
        size = table["size"].to_numpy()
        centers = matrix(table["sum"]) / size[:, None]
        distances = 1.0 - centers @ centers.T
        if totals is not None:
            color = np.zeros(distances.shape)
            for place, first, values in zip(totals["place"].to_pylist(), totals["first"].to_pylist(), totals["totals"], strict=True):
                color[place, first : first + len(values)] = values.values.to_numpy()
            color += color.T
            distances += color_weight * color / (size[:, None] * size[None, :])
            distances /= 1.0 + color_weight
            distances[np.isnan(distances)] = np.inf
        first = _average_clusters(distances, threshold, size)
        return pa.table([table[KEY], table["component"].take(pa.array(first)), table["component"]], names=[KEY, "a", "b"])

    def kernel(table: pa.Table) -> pa.Table:
        return ended(table)

    def colored(table: pa.Table, totals: pa.Table) -> pa.Table:
        return ended(table, totals)

    kind = kinds["component"]
    schema, grouped = f"{KEY} {kinds[KEY]}, a {kind}, b {kind}", clusters.select(KEY, "component", "sum", "size").groupBy(KEY)
    if not color_weight:
        return grouped.applyInArrow(kernel, schema)
    return grouped.cogroup(_color_matrix(clusters, max(1, block // 8)).groupBy(KEY)).applyInArrow(colored, schema)


def _color_matrix(clusters: DataFrame, part: int) -> DataFrame:
    """Sums of colour distances of all cluster pairs: image_id, place, first, totals.

    Clusters are numbered from 0 in the order of their names; a row has the sums of one with a run of ``part`` clusters
    from ``first``, those up to itself being 0.  Each pair of runs is a group of its own.
    """
    kinds = {f.name: f.dataType.simpleString() for f in clusters.schema.fields}
    number = Window.partitionBy(KEY).orderBy("component")
    placed = clusters.select(KEY, (F.row_number().over(number) - 1).alias("place"), F.count(F.lit(1)).over(Window.partitionBy(KEY)).alias("_n"), "colors")
    runs = placed.withColumn("_block", F.floor(F.col("place") / part).cast("int"))
    sides = (
        runs.withColumn("_other", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / part).cast("int"))))
        .withColumns({"_lo": F.least("_block", "_other"), "_hi": F.greatest("_block", "_other")})
        .drop("_other", "_n")
    )

    def kernel(table: pa.Table) -> pa.Table:
        left, right, same = block_sides(table.sort_by("place"))
        colors = [_colors(t["colors"]) for t in (left, right)]
        columns, totals = np.arange(len(right)), []
        for k in range(len(left)):
            later = columns[k + 1 :] if same else columns
            found = _color_totals(*colors, np.full(len(later), k), later)
            totals.append(np.r_[np.zeros(len(columns) - len(later)), found])
        image = pa.array([table[KEY][0].as_py()] * len(left), table.schema.field(KEY).type)
        first = pa.array([right["place"][0].as_py()] * len(left), pa.int32())
        return pa.table([image, left["place"].cast(pa.int32()), first, pa.array(totals, pa.list_(pa.float64()))], names=[KEY, "place", "first", "totals"])

    return block_pairs(sides, KEY).applyInArrow(kernel, f"{KEY} {kinds[KEY]}, place int, first int, totals array<double>")


def _cluster_links(
    clusters: DataFrame, known: DataFrame | None, members: DataFrame, bound: float, color_weight: float, block: int
) -> DataFrame:
    """Cluster pairs within the bound: image_id, a, b, embedding distance d, colour sum, blended dist.

    Tables of cluster pairs are far larger than what they are made from, which is what Spark judges
    them by, so they are merged and never broadcast.
    """
    centers = clusters.withColumn("center", F.transform("sum", lambda x: x / F.col("size")))
    close = similarity_join(
        centers, bound, metric="inner", strict=True, marked="fresh", carry=["size"], block=block, index="component", vector="center"
    ).select(KEY, F.col("i").alias("a"), F.col("j").alias("b"), F.col("dist").alias("d"), (F.col("size_i") * F.col("size_j")).alias("n"))
    if not color_weight:
        found = close.select(KEY, "a", "b", "d", F.lit(0.0).alias("color"), F.col("d").alias("dist"))
        if known is None:
            return found
        return found.unionByName(known.filter(~F.col("touched")).select(KEY, "a", "b", "d", "color", F.col("d").alias("dist")))
    blended = lambda df: df.select(
        KEY, "a", "b", "d", "color", vectors.blend(F.col("d"), F.col("color") / F.col("n"), color_weight).alias("dist")
    )
    if known is None:
        stored, _ = materialize(close)
        return blended(stored.join(_color_sums(stored, members).hint("merge"), [KEY, "a", "b"]))
    whole = known.filter(F.col("touched") & F.col("whole")).select(KEY, "a", "b", "color")
    sized, _ = materialize(close.join(whole.hint("merge"), [KEY, "a", "b"], "left"))
    asked = sized.filter(F.col("color").isNull()).drop("color")
    measured = asked.join(_color_sums(asked, members).hint("merge"), [KEY, "a", "b"])
    size = lambda name: clusters.select(KEY, F.col("component").alias(name), F.col("size").alias(f"_{name}"))
    rest = known.filter(~F.col("touched")).select(KEY, "a", "b", "d", "color").join(size("a"), [KEY, "a"]).join(size("b"), [KEY, "b"])
    rest = rest.withColumn("n", F.col("_a") * F.col("_b")).drop("_a", "_b")
    return blended(sized.filter(F.col("color").isNotNull()).unionByName(measured).unionByName(rest))


def _color_sums(pairs: DataFrame, members: DataFrame, part: int = 1024) -> DataFrame:
    """Sum of the colour distances between the members of each cluster pair: image_id, a, b, color.

    Members' colours travel in parts of about ``part``; a kernel sums each pair of parts, so no pair
    of members is a row and no large cluster is one value.
    """
    ends = pairs.select(KEY, F.explode(F.array("a", "b")).alias("component")).distinct()
    wanted = members.select(KEY, "component", "hold_index", F.col("lab").cast("array<double>").alias("lab")).join(ends, [KEY, "component"], "left_semi")
    sizes = wanted.groupBy(KEY, "component").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts"))
    parts = (
        wanted.join(sizes, [KEY, "component"])
        .groupBy(KEY, "component", F.pmod(F.xxhash64("hold_index"), F.col("_parts")).alias("_part"))
        .agg(F.flatten(F.collect_list("lab")).alias("labs"))
    )
    side = lambda name: parts.select(KEY, F.col("component").alias(name), F.col("labs").alias(f"labs_{name}"))
    summed = pairs.select(KEY, "a", "b").join(side("a"), [KEY, "a"]).join(side("b"), [KEY, "b"])
    total = arrow_udf(_summed_delta, "double")(F.col("labs_a"), F.col("labs_b"))
    return summed.select(KEY, "a", "b", total.alias("color")).groupBy(KEY, "a", "b").agg(F.sum("color").alias("color"))


def _summed_delta(first: pa.Array, second: pa.Array) -> pa.Array:
    """Sum of CIEDE2000 over all pairs of two lists of colours, per row."""
    out = []
    for k in range(len(first)):
        x, y = (np.asarray(side[k].values, np.float64).reshape(-1, 3) for side in (first, second))
        total = 0.0
        for start in range(0, len(x), 256):
            strip = x[start : start + 256]
            total += float(delta_e(np.repeat(strip, len(y), axis=0), np.tile(y, (len(strip), 1))).sum())
        out.append(total)
    return pa.array(out, pa.float64())


def agglomerative(
    features: DataFrame, threshold: float = 0.3, linkage: str = "average", color_weight: float = 0.0
) -> DataFrame:
    if linkage == "average":
        return average_linkage(features, threshold, color_weight)
    pairs = blended_join(features, threshold, color_weight)
    if linkage == "single":
        return single_linkage(features, pairs, threshold)
    if linkage == "complete":
        return complete_linkage(features, pairs, threshold)
    raise ValueError("linkage must be average, complete or single")


def finalize_groups(labels: DataFrame) -> DataFrame:
    """Dense group ids per image: labels in ascending order, then each noise hold by itself.

    ``labels``: image_id, hold_index, label (null or -1 for noise).
    """
    noise = F.coalesce(F.col("label") == -1, F.lit(True))
    keyed = labels.select(
        KEY,
        "hold_index",
        noise.alias("is_noise"),
        F.when(noise, F.col("hold_index")).otherwise(F.col("label")).cast("bigint").alias("group_key"),
    )
    groups = keyed.select(KEY, "is_noise", "group_key").distinct()
    numbered = ranked(groups, [KEY], [F.col("is_noise"), F.col("group_key")], "n")
    return keyed.join(numbered, [KEY, "is_noise", "group_key"]).select(
        KEY, "hold_index", (F.col("n") - 1).cast("bigint").alias("route_id")
    )


def first_appearance_ids(labels: DataFrame) -> DataFrame:
    """Dense group ids per image in the order of each group's first hold."""
    firsts = labels.groupBy(KEY, "label").agg(F.min("hold_index").alias("first_hold"))
    numbered = ranked(firsts, [KEY], [F.col("first_hold")], "n")
    return labels.join(numbered, [KEY, "label"]).select(
        KEY, "hold_index", (F.col("n") - 1).cast("bigint").alias("route_id")
    )


def replay_routes(holds: DataFrame) -> DataFrame:
    """Routes as annotated: rows with an integer ``route_id``."""
    return holds.filter(F.col("route_id").isNotNull()).select(
        KEY, "hold_index", F.col("route_id").cast("bigint").alias("route_id")
    )


def order_holds(groups: DataFrame, by: Sequence[Column], name: str = "position") -> DataFrame:
    """Position of each hold within its route, e.g. by (centroid y, centroid x)."""
    return ranked(groups, [KEY, "route_id"], [*by, F.col("hold_index")], name)


def _seeds(features: DataFrame, k: int, seed: int) -> DataFrame:
    """The k holds of each image with the smallest md5(seed, image, hold) as initial centres."""
    lottery = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(KEY), F.col("hold_index")))
    order = Window.partitionBy(KEY).orderBy("_lot", "hold_index")
    return (
        features.withColumn("_lot", lottery)
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= k)
        .select(KEY, (F.col("n") - 1).alias("c"), F.col("features").alias("center"))
    )


def kmeans(features: DataFrame, k: int = 6, seed: int = 0, max_iter: int | None = None) -> DataFrame:
    """Lloyd rounds for all images at once, until they converge: image_id, hold_index, label (0..k-1).

    With ``max_iter`` rounds stop there, and a column ``converged`` says for each image whether it was done.

    ``features``: array<double>.  Images stop on their own once their centres agree with the last
    ones up to 1e-8 + 1e-5 * |centre|; an empty cluster keeps its centre.
    """
    rows, _ = materialize(features.select(KEY, "hold_index", "features"))
    hot, n_hot = materialize(hot_keys(rows, [KEY]))
    stacked = lambda t: t.groupBy(KEY).agg(  # noqa: E731  at most k rows per image
        F.array_sort(F.collect_list(F.struct("c", "center"))).alias("centers")
    )
    centers, _ = materialize(stacked(_seeds(rows, k, seed)).withColumn("done", F.lit(False)))

    def assigned(current: DataFrame) -> DataFrame:
        scored = F.transform(
            "centers",
            lambda c: F.struct(
                F.aggregate(
                    F.zip_with("features", c["center"], lambda x, y: (x - y) * (x - y)),
                    F.lit(0.0),
                    lambda acc, v: acc + v,
                ).alias("d"),
                c["c"].alias("c"),
            ),
        )
        if n_hot:
            both = salted_join(rows, current, [KEY], ["hold_index"], hot=hot)
        else:
            both = rows.join(current, KEY)
        return both.withColumn("label", F.array_min(scored)["c"])

    for _ in count() if max_iter is None else range(max_iter):
        moving = assigned(centers.filter(~F.col("done")))
        means = (
            moving.groupBy(KEY, "label")
            .agg(mean_vector("features").alias("mean"))
            .groupBy(KEY)
            .agg(F.map_from_entries(F.collect_list(F.struct("label", "mean"))).alias("means"))
        )
        fresh = F.transform(
            "centers",
            lambda c: F.struct(
                c["c"].alias("c"), F.coalesce(F.try_element_at("means", c["c"]), c["center"]).alias("center")
            ),
        )
        steady = F.forall(
            F.zip_with("fresh", "centers", lambda u, o: F.forall(
                F.zip_with(u["center"], o["center"], lambda x, y: F.abs(x - y) <= 1e-8 + 1e-5 * F.abs(y)),
                lambda ok: ok,
            )),
            lambda ok: ok,
        )
        stepped = centers.join(means, KEY, "left").withColumn("fresh", F.when(F.col("done"), F.col("centers")).otherwise(fresh)).withColumn("steady", steady)
        centers, _ = materialize(
            stepped.select(
                KEY,
                F.when(F.col("steady"), F.col("centers")).otherwise(F.col("fresh")).alias("centers"),
                F.col("steady").alias("done"),
            )
        )
        if centers.filter(~F.col("done")).limit(1).count() == 0:
            break
    if max_iter is None:
        return assigned(centers).select(KEY, "hold_index", "label")
    return assigned(centers).select(KEY, "hold_index", "label", F.col("done").alias("converged"))
