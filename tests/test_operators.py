"""Distributed operators against plain sequential versions on small random inputs."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from wallframe import skew
from wallframe.functions import raster
from wallframe.functions.numeric import delta_e
from wallframe.operators import grouping as g
from wallframe.operators import pairs as pr
from wallframe.operators.hierarchy import hdbscan
from wallframe.operators.leader import leader
from wallframe.operators.masks import with_runs
from wallframe.operators.matching import match_greedy
from wallframe.operators.overlap import nms, span_iou
from wallframe.operators.pair_sample import balanced_pairs
from wallframe.operators.passes import whole_units
from wallframe.plans import detection
from wallframe.plans.detection import average_precision


def groups_of(rows, column):
    """image -> sorted partition of hold ids."""
    out: dict = {}
    for r in rows:
        out.setdefault(r["image_id"], {}).setdefault(r[column], set()).add(r["hold_index"])
    return {k: sorted(map(frozenset, v.values()), key=min) for k, v in out.items()}


def cosine(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.clip(1 - u @ u.T, 0, 2)


@pytest.fixture
def several_partitions(spark):
    """Small inputs keep all their shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def clouds(spark):
    """Three images of clustered vectors; the last one is large compared to the block sizes used."""
    rng = np.random.default_rng(4)
    data = {}
    for image, n in (("a", 9), ("b", 17), ("c", 40)):
        centers = rng.normal(size=(4, 6))
        data[image] = centers[rng.integers(0, 4, n)] + rng.normal(scale=0.35, size=(n, 6))
    rows = [
        (image, k, [float(v) for v in x], [float(50 + 10 * x[0]), float(10 * x[1]), float(10 * x[2])], int(k % 3))
        for image, m in data.items()
        for k, x in enumerate(m)
    ]
    df = spark.createDataFrame(rows, "image_id string, hold_index bigint, embedding array<double>, lab array<double>, route_id bigint")
    return data, df


def test_similarity_join_blocks_agree(clouds):
    data, df = clouds
    for block in (7, 2048):
        found = {(r.image_id, r.i, r.j): r.dist for r in pr.similarity_join(df, 0.4, block=block).collect()}
        expected = {
            (image, i, j): d[i, j]
            for image, x in data.items()
            for d in [cosine(x)]
            for i in range(len(x))
            for j in range(i + 1, len(x))
            if d[i, j] <= 0.4
        }
        assert found.keys() == expected.keys()
        assert all(abs(found[k] - v) < 1e-9 for k, v in expected.items())


def test_blended_join_and_head_blocks_agree(clouds):
    _, df = clouds
    from wallframe.operators.model import random_head

    one = {tuple(r) for r in pr.blended_join(df, 0.3, 1.0).select("image_id", "i", "j").collect()}
    assert one and one == {tuple(r) for r in pr.blended_join(df, 0.3, 1.0, block=7).select("image_id", "i", "j").collect()}
    head = random_head(19, 8)
    for threshold in (0.0, 0.5):
        big = {tuple(r)[:3] for r in pr.score_pairs(df, head, threshold=threshold).collect()}
        assert big == {tuple(r)[:3] for r in pr.score_pairs(df, head, threshold=threshold, block=7).collect()}
    assert len(big) < 9 * 8 / 2 + 17 * 16 / 2 + 40 * 39 / 2


def test_kernels_give_pairs_in_parts(monkeypatch):
    """Pairs leave a kernel in bounded parts, and judged pairs that fail never leave it."""
    import pyarrow as pa

    monkeypatch.setattr(pr, "EMIT", 10)
    table = pa.table({"image_id": [1] * 6, "hold_index": list(range(6)), "lab": [[1.0, 2.0, 3.0]] * 6})
    r, c = np.triu_indices(6, 1)
    parts = list(pr._pair_rows(table, table, r, c, [np.arange(15.0)], ["image_id", "i", "j", "dist", "lab_i", "lab_j"], "image_id", "hold_index", ["lab"]))
    assert [len(p) for p in parts] == [10, 5] and parts[1]["dist"].to_pylist() == [10.0, 11.0, 12.0, 13.0, 14.0]
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3, (40, 3)) * 20.0, rng.integers(0, 3, (50, 3)) * 20.0
    for left, right in ((a, b), (a + rng.random((40, 3)), b + rng.random((50, 3)))):
        x, y = rng.integers(0, 40, 200), rng.integers(0, 50, 200)
        assert np.allclose(pr.color_lookup(left, right)(x, y), delta_e(left[x], right[y]), atol=1e-15)


def test_small_blocks_grow_with_the_image(spark):
    """The number of block pairs does not grow with the square of the rows while blocks are small."""
    sizes = {k: 64 * 4 ** (k + 1) for k in range(4)}
    df = spark.range(16384).selectExpr("explode(sequence(0, 3)) AS image_id", "id AS hold_index").filter("hold_index < 64 * pow(4, image_id + 1)")
    large = {r.image_id: r._blocks for r in pr._large_images(df, 4, "image_id").collect()}
    assert large.keys() == sizes.keys() and all(n <= pr.FEW_BLOCKS for n in large.values())


def test_head_of_any_width_matches_plain_features(clouds):
    """Scores from matrix products agree with the features of every pair."""
    from wallframe.operators.model import random_head

    data, df = clouds
    head = random_head(19, 5)
    got = {(r.image_id, r.i, r.j): r.probability for r in pr.score_pairs(df, head, threshold=0.0, block=11).collect()}
    for image, x in data.items():
        lab = np.stack([50 + 10 * x[:, 0], 10 * x[:, 1], 10 * x[:, 2]], axis=1)
        i, j = np.triu_indices(len(x), 1)
        logit = np.maximum(pr._feature_rows(x[i], x[j], lab[i], lab[j]) @ head["w1"] + head["b1"], 0.0) @ head["w2"] + head["b2"]
        for a, b, p in zip(i.tolist(), j.tolist(), 1 / (1 + np.exp(-logit)), strict=True):
            assert got.pop((image, a, b)) == pytest.approx(p, abs=1e-9)
    assert not got


def test_head_measures_colors_only_where_they_decide(spark, monkeypatch):
    """Pairs that the head refuses for any colour distance are not given to CIEDE2000, and a row has a bounded number of copies."""
    from wallframe.operators.model import random_head

    rng = np.random.default_rng(21)
    x, lab = rng.normal(size=(150, 4)), rng.uniform(0, 90, (150, 3))
    rows = [(k // 110, k, [float(v) for v in x[k]], [float(v) for v in lab[k]]) for k in rng.permutation(150).tolist()]
    df = spark.createDataFrame(rows, "image_id int, hold_index bigint, embedding array<double>, lab array<double>").coalesce(1)
    head = random_head(15, 3)
    i, j = (v for v in np.triu_indices(150, 1))
    i, j = i[i // 110 == j // 110], j[i // 110 == j // 110]
    logit = np.maximum(pr._feature_rows(x[i], x[j], lab[i], lab[j]) @ head["w1"] + head["b1"], 0.0) @ head["w2"] + head["b2"]
    chance, copies, asked, blocked = 1 / (1 + np.exp(-logit)), [], spark.sparkContext.accumulator(0), pr.blocked
    monkeypatch.setattr(pr, "blocked", lambda *args: copies.append(blocked(*args)) or copies[-1])

    def counted(a, b):
        asked.add(len(a))
        return delta_e(a, b)

    for threshold in (np.quantile(chance, 0.9), 0.0, 1.0):
        monkeypatch.setattr(pr, "delta_e", counted)
        before = asked.value
        got = {(r.i, r.j): r.probability for r in pr.score_pairs(df, head, threshold=float(threshold), block=3).collect()}
        want = {(a, b): p for a, b, p in zip(i.tolist(), j.tolist(), chance, strict=True) if p >= threshold}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(p, abs=1e-9) for k, p in want.items())
        if 0 < threshold < 1:
            assert len(want) <= asked.value - before < 0.5 * len(i)
    assert max(r["count"] for r in copies[0].groupBy("hold_index").count().collect()) <= pr.DENSE_BLOCKS


def test_blend_bounds_copies_and_colors(spark, monkeypatch):
    """Where no block lies apart a row has a bounded number of copies, and pairs too far apart in lightness get no colour distance."""
    from wallframe.functions.numeric import light_gap

    rng = np.random.default_rng(22)
    a, b = (np.stack([rng.uniform(-200, 300, 4000), *rng.uniform(-90, 90, (2, 4000))], axis=1) for _ in range(2))
    assert (light_gap(a[:, 0], b[:, 0]) <= delta_e(a, b) + 1e-12).all()
    x, lab = rng.normal(size=(150, 4)), rng.uniform(0, 90, (150, 3))
    rows = [(k // 110, k, [float(v) for v in x[k]], [float(v) for v in lab[k]]) for k in rng.permutation(150).tolist()]
    df = spark.createDataFrame(rows, "image_id int, hold_index bigint, embedding array<double>, lab array<double>")
    i, j = (v for v in np.triu_indices(150, 1))
    i, j = i[i // 110 == j // 110], j[i // 110 == j // 110]
    d, color = cosine(x)[i, j], delta_e(lab[i], lab[j])
    copies, asked, blocked = [], spark.sparkContext.accumulator(0), pr.blocked
    monkeypatch.setattr(pr, "blocked", lambda *args: copies.append(blocked(*args)) or copies[-1])

    def counted(left, right):
        measure = color_lookup(left, right)
        return lambda r, c: asked.add(len(r)) or measure(r, c)

    color_lookup = pr.color_lookup
    monkeypatch.setattr(pr, "color_lookup", counted)
    for block in (3, 2048):
        before = asked.value
        got = {(r.i, r.j): r.dist for r in pr.blended_join(df, 0.4, 2.0, block=block).collect()}
        want = {(p, q): v for p, q, v in zip(i.tolist(), j.tolist(), (d + 2 * color) / 3, strict=True) if v <= 0.4}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
        assert len(want) <= asked.value - before <= (d + 2 * light_gap(lab[i, 0], lab[j, 0]) <= 1.2 + 1e-6).sum() < 0.9 * (d <= 1.2).sum()
    assert max(r["count"] for r in copies[0].groupBy("hold_index").count().collect()) <= pr.DENSE_BLOCKS


def test_filters_pass_the_fill(spark, tmp_path):
    """A filter on the image reaches the scan below the fill; one on the runs does not fill polygons twice."""
    ring = [(0, 0), (6, 2), (3, 5)]
    holds = spark.createDataFrame([(k % 4, k, ring) for k in range(8)], "image_id bigint, hold_index bigint, polygon array<struct<x:int,y:int>>")
    holds.write.parquet(str(tmp_path / "holds"))
    masks = with_runs(spark.read.parquet(str(tmp_path / "holds"))).filter("image_id = 2 AND size(runs) > 1 AND area > 3")
    plan = masks._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(image_id,2)" in plan and plan.count("ArrowEvalPython") == 1
    assert sorted(r.hold_index for r in masks.collect()) == [2, 6]


def test_masks_are_not_broadcast(spark):
    """Pieces of masks are larger than their plan says: no side of the join is broadcast, and no pair of runs is a row."""
    rng = np.random.default_rng(6)
    rows = [(k % 2, k, [(x, y - 7), (x + 9, y), (x, y + 7), (x - 9, y)]) for k, (x, y) in enumerate(rng.integers(-20, 60, (40, 2)).tolist())]
    holds = spark.createDataFrame(rows, "image_id bigint, hold_index bigint, polygon array<struct<x:int,y:int>>")
    masks = with_runs(holds)
    found = span_iou(masks, masks, ordered_pairs=True, tile=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
    pixels = {
        r.hold_index: (r.image_id, {(y, x) for run in r.runs for y in range(run.y0, run.y1 + 1) for x in range(run.x0, run.x1 + 1)}) for r in masks.collect()
    }
    expected = {
        (i, j): len(a & b) / len(a | b)
        for i, (image, a) in pixels.items() for j, (other, b) in pixels.items() if i < j and image == other and a & b
    }
    assert {(r.pred_idx, r.ann_idx): pytest.approx(r.iou) for r in found.collect()} == expected and len(expected) > 20


def test_balanced_pairs(spark, clouds):
    data, df = clouds
    one = sorted(tuple(r) for r in balanced_pairs(df, 5, 3).collect())
    assert one == sorted(tuple(r) for r in balanced_pairs(df.repartition(5), 5, 3).collect())
    assert one != sorted(tuple(r) for r in balanced_pairs(df, 5, 4).collect())
    for image in data:
        labels = [r[3] for r in one if r[0] == image]
        assert labels.count(0) == labels.count(1) == 5


def test_balanced_pairs_take_every_pair_once(spark):
    """With a cap above the smaller class all its pairs are drawn; holds without a route are like no other."""
    routes = {"p": [1, 1, 2, 2, 2, 7, None, None], "q": [3] * 9 + [4], "one": [5], "same": [6, 6, 6], "other": [1, 2, None], None: [1, 1, 2]}
    rows = [(image, 10 * k, route) for image, all_routes in routes.items() for k, route in enumerate(all_routes)]
    df = spark.createDataFrame(rows, "image_id string, hold_index bigint, route_id bigint")
    pairs = {(a[0], a[1], b[1]): int(a[2] is not None and a[2] == b[2]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]}
    for cap in (1, 3, 1000):
        got = [tuple(r) for r in balanced_pairs(df, cap, 1).collect()]
        assert len(got) == len(set(got)) and {g[0] for g in got} == {"p", "q"}
        assert all(pairs[g[:3]] == g[3] for g in got)
        for image in ("p", "q"):
            sizes = [sum(1 for k, v in pairs.items() if k[0] == image and v == label) for label in (0, 1)]
            assert [sum(1 for g in got if g[0] == image and g[3] == label) for label in (0, 1)] == [min(cap, *sizes)] * 2


def test_balanced_pairs_reach_all_pairs(spark):
    """Each pair of a class is drawn about as often as any other, over many seeds."""
    df = spark.range(12).selectExpr("0 AS image_id", "id AS hold_index", "id % 3 AS route_id")
    images = spark.range(300).select(F.col("id").alias("image_id")).crossJoin(df.drop("image_id"))
    times = {(r["i"], r["j"]): r["n"] for r in balanced_pairs(images, 6, 9).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(times) == 66 and all(60 < n < 145 for (i, j), n in times.items() if i % 3 == j % 3)
    assert all(15 < n < 70 for (i, j), n in times.items() if i % 3 != j % 3)


def test_linkages(clouds):
    data, df = clouds
    near = pr.similarity_join(df, 0.3)
    for how, found in (
        ("single", g.single_linkage(df, near, 0.3)),
        ("complete", g.complete_linkage(df, near, 0.3)),
        ("average", g.average_linkage(df, 0.3)),
        ("average", g.average_linkage(df, 0.3, block=5)),
    ):
        got = groups_of(found.collect(), "component")
        for image, x in data.items():
            assert got[image] == brute.linkage(cosine(x), 0.3, how), (how, image)


def test_average_linkage_keeps_one_link_per_cluster(spark, monkeypatch):
    """Close vectors and many copies: no table of cluster pairs, and copies do not take a round each."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=6) + rng.normal(scale=0.6, size=(70, 6))
    x[40:] = x[:3].repeat(10, axis=0)
    df = spark.createDataFrame([("a", k, [float(v) for v in row]) for k, row in enumerate(x)], "image_id string, hold_index bigint, embedding array<double>")
    rows, materialize = [], g.materialize
    monkeypatch.setattr(g, "materialize", lambda df: rows.append(materialize(df)) or rows[-1])
    got = groups_of(g.average_linkage(df, 0.2, block=4).collect(), "component")
    assert got["a"] == brute.linkage(cosine(x), 0.2, "average")
    assert max(n for _, n in rows) <= len(x) and len(rows) < 50


def test_wide_blocks_bound_the_copies(spark):
    rows = spark.range(4000).selectExpr("1L AS image_id", "id AS hold_index", "array(1.0D, double(id)) AS embedding")
    copies = pr.blocked(rows, 20, vector="embedding").groupBy("hold_index").count()
    assert copies.agg(F.max("count")).first()[0] <= pr.WIDE_BLOCKS


def test_average_linkage_with_color(clouds):
    data, df = clouds

    for block in (5, 2048):
        got = groups_of(g.average_linkage(df, 0.25, 1.0, block=block).collect(), "component")
        for image, x in data.items():
            lab = np.stack([50 + 10 * x[:, 0], 10 * x[:, 1], 10 * x[:, 2]], axis=1)
            d = (cosine(x) + delta_e(lab[:, None], lab[None])) / 2
            assert got[image] == brute.linkage(d, 0.25, "average")


def test_average_linkage_with_color_keeps_one_link_per_cluster(spark, monkeypatch):
    """Vectors at all angles, copies among them: no table of cluster pairs, and most colour distances are never measured."""
    rng = np.random.default_rng(9)
    x, lab = rng.normal(size=(90, 6)), np.stack([rng.uniform(0, 100, 90), *rng.uniform(-50, 50, (2, 90))], axis=1)
    x[70:], lab[70:] = x[:2].repeat(10, axis=0), lab[:2].repeat(10, axis=0)
    rows = [("a", k, [float(v) for v in x[k]], [float(v) for v in lab[k]]) for k in range(90)]
    df = spark.createDataFrame(rows, "image_id string, hold_index bigint, embedding array<double>, lab array<double>")
    stored, materialize = [], g.materialize
    monkeypatch.setattr(g, "materialize", lambda df: stored.append(materialize(df)) or stored[-1])
    d = (cosine(x) + delta_e(lab[:, None], lab[None])) / 2
    for threshold in (0.3, 0.55):
        got = groups_of(g.average_linkage(df, threshold, 1.0, block=4).collect(), "component")
        assert got["a"] == brute.linkage(d, threshold, "average")
    assert max(n for _, n in stored) <= len(x)


def test_nearest_blends_are_exact():
    """Pairs left out by their lower bound are the nearest of neither side, for clusters of several colours, any L and cut distances."""
    import pyarrow as pa

    rng = np.random.default_rng(10)
    for low, high in ((0, 100), (-300, 500)):
        sides = []
        for n in (40, 70):
            many = rng.integers(1, 5, n)
            labs = [np.stack([rng.uniform(low, high, m), *rng.uniform(-60, 60, (2, m)), rng.integers(1, 4, m)], axis=1) for m in many]
            sides.append((labs, g._colors(pa.chunked_array([pa.array([v.ravel() for v in labs])]))))
        (labs, left), (others, right) = sides
        mean = np.array([[(delta_e(x[:, None, :3], y[None, :, :3]) * x[:, 3, None] * y[None, :, 3]).sum() / (x[:, 3].sum() * y[:, 3].sum()) for y in others] for x in labs])
        assert (g._light_gaps(left, right) <= mean + 1e-12).all()
        d = rng.uniform(0.5, 1.2, mean.shape)
        exact = (d + 2.0 * mean) / 3.0
        open_ = [np.full(n, np.inf) for n in d.shape]
        found = g._nearest_blends(d, [left, right], 2.0, 0.6, *open_)
        assert np.allclose(found[np.isfinite(found)], exact[np.isfinite(found)], atol=1e-12)
        for axis in (0, 1):
            near, best = found.min(axis=axis), exact.min(axis=axis)
            assert np.allclose(near[best < 0.6], best[best < 0.6], atol=1e-12)


def test_cluster_pairs_are_not_broadcast(clouds):
    """Colour sums meet cluster pairs by a merge: the pairs would not fit the driver."""
    _, df = clouds
    rows = df.withColumn("component", F.col("hold_index"))
    members = rows.select("image_id", "hold_index", "component", "lab")
    clusters = rows.selectExpr("image_id", "component", "embedding AS sum", "1L AS size", "true AS fresh")
    found = g._cluster_links(clusters, None, members, 1.1, 1.0, 7)
    last = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in last
    assert found.count() > 0


def test_far_blocks_are_not_paired(spark):
    """A third of all rows in one image of four narrow groups: the same pairs from fewer pairs of blocks."""
    rng = np.random.default_rng(11)
    centers = np.eye(6)[:4]
    rows = [(k % 3 and 1 + k % 7, k, [float(v) for v in centers[k % 4] + rng.normal(size=6) * 0.05]) for k in range(900)]
    rows += [(0, 1000, [0.0] * 6), (0, 1001, rows[0][2])]
    df = spark.createDataFrame(rows, "image_id int, hold_index int, embedding array<double>")
    for metric, limit in (("cosine", 0.01), ("sq_l2", 0.02)):
        near = {tuple(r)[:3] for r in pr.similarity_join(df, limit, metric=metric, block=20).collect()}
        assert near and near == {tuple(r)[:3] for r in pr.similarity_join(df, limit, metric=metric).collect()}
    large = pr._large_images(df, 20, "image_id")
    placed = pr.pivot_blocks(df, large, 20, "cosine", "image_id", "hold_index", "embedding")
    sizes = {(r.image_id, r._block): r["count"] for r in placed.groupBy("image_id", "_block").count().collect()}
    blocks = sum(image == 0 for image, _ in sizes)
    formed = pr.meeting_blocks(placed, pr._reach("cosine", 0.01), "image_id").filter("image_id = 0").count()
    assert formed < 0.6 * blocks * (blocks + 1) / 2
    assert sum(sizes.values()) == placed.count() == df.join(large, "image_id").count()


def test_colors_of_cluster_pairs_stay_in_parts(spark):
    """Sums over pairs of members, whatever the size of the parts, and no row per pair of members in the plan."""
    rng = np.random.default_rng(8)
    labs = rng.uniform(-40, 60, (40, 3))
    members = spark.createDataFrame([(1, k % 3, k, [float(v) for v in lab]) for k, lab in enumerate(labs)], "image_id int, component int, hold_index int, lab array<double>")
    pairs = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "image_id int, a int, b int")
    for part in (2, 1024):
        found = {(r.a, r.b): r.color for r in g._color_sums(pairs, members, part).collect()}
        for a, b in ((0, 1), (1, 2)):
            assert abs(found[a, b] - delta_e(labs[a::3][:, None], labs[b::3][None]).sum()) < 1e-9


def test_dbscan(clouds):
    data, df = clouds
    rows = g.dbscan(df, pr.similarity_join(df, 0.12), 0.12, 4).collect()
    for image, x in data.items():
        near = cosine(x) <= 0.12
        core = near.sum(1) >= 4
        label = {}
        for i in range(len(x)):
            if core[i] and i not in label:
                stack = [i]
                while stack:
                    a = stack.pop()
                    if a in label:
                        continue
                    label[a] = i
                    if core[a]:
                        stack += [b for b in range(len(x)) if near[a, b] and b not in label]
        mine = {r.hold_index: r.component for r in rows if r.image_id == image}
        assert mine == {i: label.get(i) for i in range(len(x))}


def test_components_of_a_long_path(spark):
    n = 300
    nodes = spark.range(n).select(F.lit(1).alias("image_id"), F.col("id").alias("hold_index"))
    edges = spark.range(n - 1).select(F.lit(1).alias("image_id"), F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    found = g.connected_components(nodes, edges.filter("i != 149")).groupBy("component").count().collect()
    assert sorted(tuple(r) for r in found) == [(0, 150), (150, 150)]


@pytest.mark.parametrize("sizes", [{}, {"first_block": 6, "next_block": 5, "look": 1}])
def test_leader(clouds, sizes):
    data, df = clouds
    unit = df.withColumn("embedding", F.expr("transform(embedding, v -> v / sqrt(aggregate(embedding, 0D, (a, x) -> a + x * x)))"))
    for median_t, max_t in ((0.7, 2.65), (0.3, 0.9)):
        rows = leader(unit, median_t, max_t, **sizes).collect()
        for image, x in data.items():
            mine = [r.route_id for r in sorted((r for r in rows if r.image_id == image), key=lambda r: r.hold_index)]
            assert mine == brute.leader(2 * cosine(x), median_t, max_t)


def test_leader_in_few_rounds(spark, monkeypatch):
    """Groups that gain members inside a block or are above a part; a block is walked to its end."""
    from wallframe.operators import leader as ld

    rng = np.random.default_rng(11)
    x = rng.normal(size=(160, 8)) + 2 * np.eye(8)[rng.integers(0, 8, 160)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(1, k, [float(v) for v in row]) for k, row in enumerate(x)], "image_id int, hold_index int, embedding array<double>")
    walked, summaries = [], ld._summaries
    monkeypatch.setattr(ld, "_summaries", lambda *args: walked.append(1) or summaries(*args))
    for sizes in ({"look": 3, "small": 2, "part": 5}, {}):
        walked.clear()
        found = leader(df, 1.0, 2.0, first_block=40, next_block=60, **sizes).orderBy("hold_index").collect()
        assert [r.route_id for r in found] == brute.leader(np.maximum(2 - 2 * x @ x.T, 0), 1.0, 2.0)
    assert len(walked) == 2


@pytest.mark.parametrize("sizes", [{}, {"block": 6}, {"chunk": 4}])
@pytest.mark.parametrize("min_size", [2, 4])
def test_hdbscan(clouds, sizes, min_size):
    data, df = clouds
    rows = hdbscan(df, min_size, **sizes).filter("component IS NOT NULL").collect()
    got = groups_of(rows, "component")
    for image, x in data.items():
        assert got.get(image, []) == brute.hdbscan(cosine(x), min_size, min_size)


def test_kmeans(clouds):
    data, df = clouds
    features = df.select("image_id", "hold_index", F.col("lab").alias("features"))
    seeds = {}
    for r in g._seeds(features, 3, 0).orderBy("image_id", "c").collect():
        seeds.setdefault(r.image_id, []).append(r.center)
    got = groups_of(g.kmeans(features, 3).collect(), "label")
    for image, x in data.items():
        lab = np.stack([50 + 10 * x[:, 0], 10 * x[:, 1], 10 * x[:, 2]], axis=1)
        labels = brute.kmeans(lab, np.array(seeds[image]))
        expected = sorted((frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels)), key=min)
        assert got[image] == expected


def test_matching_and_average_precision(spark):
    rng = np.random.default_rng(9)
    cases, edges, preds, anns = [], [], [], []
    for image in range(12):
        n, m = rng.integers(1, 7, 2)
        conf = {p: float(rng.integers(0, 4)) / 4 for p in range(n)}
        iou = {(p, a): float(rng.integers(1, 11)) / 10 for p in range(n) for a in range(m) if rng.random() < 0.6}
        cases.append((conf, iou))
        edges += [("d", "clean", image, p, a, v) for (p, a), v in iou.items()]
        preds += [("d", "clean", image, p, c) for p, c in conf.items()]
        anns += [("clean", image, a) for a in range(m)]
    table = spark.createDataFrame(edges, "implementation_id string, condition string, image_id int, pred_idx int, ann_idx int, iou double")
    matched = {(r.image_id, r.pred_idx): r.ann_idx for r in match_greedy(table, 0.5).collect()}
    assert matched == {(k, p): a for k, (_, iou) in enumerate(cases) for p, a in brute.greedy_match(iou, 0.5).items()}
    ap = average_precision(
        spark.createDataFrame(preds, "implementation_id string, condition string, image_id int, pred_idx int, confidence double"),
        spark.createDataFrame(anns, "condition string, image_id int, ann_idx int"),
        table,
        (0.5, 0.75),
    )
    for r in ap.collect():
        assert abs(r.ap - brute.average_precision(cases, len(anns), r.threshold)) < 1e-9
    # The same cases in another order: equal confidences follow it.
    ap = average_precision(
        spark.createDataFrame([(*p, (p[2] * 5 + 3) % 12) for p in preds], "implementation_id string, condition string, image_id int, pred_idx int, confidence double, case_index int"),
        spark.createDataFrame(anns, "condition string, image_id int, ann_idx int"),
        table,
        (0.5, 0.75),
    )
    moved = [case for _, case in sorted(((k * 5 + 3) % 12, case) for k, case in enumerate(cases))]
    found = {r.threshold: r.ap for r in ap.collect()}
    assert all(abs(v - brute.average_precision(moved, len(anns), t)) < 1e-9 for t, v in found.items())
    assert any(abs(v - brute.average_precision(cases, len(anns), t)) > 1e-9 for t, v in found.items())


def test_nms(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        x, y = (int(v) for v in rng.integers(0, 12, 2))
        rows.append((1, k, float(rng.integers(0, 5)), [(x, y), (x + 9, y), (x + 9, y + 8), (x, y + 8)]))
    df = spark.createDataFrame(rows, "image_id int, hold_index int, confidence double, polygon array<struct<x:int,y:int>>")
    masks = with_runs(df)
    close = {frozenset((r.pred_idx, r.ann_idx)) for r in span_iou(masks, masks, min_iou=0.5, ordered_pairs=True, tile=4).collect()}
    order = [k for _, k in sorted((-r[2], r[1]) for r in rows)]
    assert {r.hold_index for r in nms(masks, 0.5).collect()} == brute.nms(order, close)


def test_ranked_and_running_values(spark, several_partitions):
    df = spark.range(5000).select((F.col("id") % 10 == 0).cast("int").alias("g"), F.xxhash64("id").alias("v"), (F.col("id") % 7).alias("w"))
    order = [F.col("v")]
    chunks = skew.chunked(df, ["g"], order)
    full = skew.running_sum(skew.row_numbers(chunks, ["g"], order, "n"), ["g"], order, F.col("w"), "total")
    full = skew.suffix_max(full, ["g"], order, F.col("w"), "peak")
    rows = full.collect()
    assert chunks.select("_chunk").distinct().count() > 1
    for key in (0, 1):
        mine = sorted((r for r in rows if r.g == key), key=lambda r: r.v)
        total = np.cumsum([r.w for r in mine])
        peak = np.maximum.accumulate([r.w for r in mine][::-1])[::-1]
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))
        assert [r.total for r in mine] == total.tolist() and [r.peak for r in mine] == peak.tolist()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, several_partitions, how):
    left = spark.range(900).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 11 + 2).alias("k"), F.col("id").alias("v"))
    right = spark.range(8).select((F.col("id") + 1).alias("k"), F.col("id").alias("u"))
    plain = sorted(map(str, left.join(right, "k", how).collect()))
    salted = skew.salted_join(left, right, ["k"], ["v"], how, rows_per_task=50)
    assert sorted(map(str, salted.select(left.join(right, "k", how).columns).collect())) == plain


def test_tree_order_does_not_depend_on_size(spark):
    """Tied integer vectors: the tree of the in-block kernel is that of the rounds for large images."""
    from wallframe.operators.hierarchy import reachability_tree

    rng = np.random.default_rng(12)
    rows = [(image, k, [float(x) for x in rng.integers(-1, 2, 2) + 0.0]) for image in range(6) for k in range(14)]
    rows = [(i, k, v if any(v) else [1.0, 0.0]) for i, k, v in rows]
    features = spark.createDataFrame(rows, "image_id bigint, hold_index bigint, embedding array<double>")
    edges = lambda block: {(r.image_id, r.lo, r.hi) for r in reachability_tree(features, 2, block=block).collect()}
    assert edges(5) == edges(2048)


def test_tree_copies_rows_a_bounded_number_of_times(spark, monkeypatch):
    from wallframe.operators import hierarchy as h

    rng = np.random.default_rng(13)
    x = rng.normal(size=(120, 3))
    features = spark.createDataFrame([(1, k, [float(v) for v in row]) for k, row in enumerate(x)], "image_id bigint, hold_index bigint, embedding array<double>")
    copies, blocked = [], h.blocked
    monkeypatch.setattr(h, "blocked", lambda *args, **kw: copies.append(blocked(*args, **kw)) or copies[-1])
    cores = {r.hold_index: r.core for r in h._core_distances(features, 2, 0.0, 4).collect()}
    d = cosine(x)
    assert np.allclose([cores[k] for k in range(120)], np.sort(d + 9 * np.eye(120), axis=1)[:, 1])
    assert copies[0].count() <= 120 * pr.WIDE_BLOCKS


def test_tree_rounds_search_few_holds(spark, monkeypatch):
    """Rounds go over edges to near holds: only holds that these cannot decide are searched, and the tree is that of one kernel."""
    from wallframe.operators import hierarchy as h

    rng = np.random.default_rng(14)
    x = np.concatenate([rng.normal(size=(150, 5)), rng.normal(size=5) + 0.05 * rng.normal(size=(40, 5)), np.eye(5)[rng.integers(0, 5, 20)]])
    rows = [(image, k, [float(v) for v in row], [float(20 * k % 90), float(k % 7), 5.0]) for image in (1, 2) for k, row in enumerate(x[image:])]
    features = spark.createDataFrame(rows, "image_id bigint, hold_index bigint, embedding array<double>, lab array<double>")
    edges = lambda weight, block: {(r.image_id, r.lo, r.hi): r.w for r in h.reachability_tree(features, 2, weight, block).collect()}
    searched, search = [], h._searched
    monkeypatch.setattr(h, "_searched", lambda state, *args: searched.append(state.filter("asked").count()) or search(state, *args))
    for weight in (0.0, 1.0):
        small, large = edges(weight, 2048), edges(weight, 30)
        assert len(large) == len(small) == len(rows) - 2
        # The same edges wherever lengths differ, and the same lengths where copies tie.
        assert np.allclose(sorted(small.values()), sorted(large.values()), atol=1e-12)
        assert sum(searched) < 2 * len(rows)
        searched.clear()


def test_null_groups_keep_their_ranks(spark):
    from wallframe.skew import ranked

    rows = spark.createDataFrame([(None, 3), (None, 1), (1, 2)], "g bigint, x bigint")
    got = {(r.g, r.x, r["rank"]) for r in ranked(rows, ["g"], [F.col("x")]).collect()}
    assert got == {(None, 1, 1), (None, 3, 2), (1, 2, 1)}


def test_failing_groupers_are_error_rows(spark):
    from wallframe.registry import register_grouper, run_groupers

    register_grouper("late", lambda features, config: features.select("image_id", "hold_index", F.raise_error(F.lit("late")).cast("bigint").alias("route_id")))
    features = spark.createDataFrame([(1, 1), (1, 2)], "image_id bigint, hold_index bigint")
    groups, errors = run_groupers(features, [("late", {}), ("no_such", {})])
    assert groups.count() == 0 and {r["name"] for r in errors.collect()} == {"late", "no_such"}


def test_broken_coco_rows_are_rejected(spark):
    from wallframe.sources.documents import coco_rejects, parse_coco

    good = '{"images":[{"id":1,"file_name":"a"}],"annotations":[{"image_id":1,"segmentation":[[1,1,5,1,1,5]]},{"image_id":1,"segmentation":[]},{"image_id":1,"segmentation":[[]]},{"image_id":1,"segmentation":[[1,2,3]]}]}'
    docs = spark.createDataFrame([("p", good), ("q", "{broken")], "path string, value string")
    images, holds = parse_coco(docs)
    assert images.count() == 1 and [r.hold_index for r in holds.collect()] == [0]
    got = {(r.path, r.hold_index, r.reason) for r in coco_rejects(docs).collect()}
    assert got == {("p", 1, "no ring"), ("p", 2, "no ring"), ("p", 3, "odd ring"), ("q", None, "document")}


@pytest.mark.parametrize("most", [1, 12, 10_000])
def test_passes_do_not_depend_on_unit_size(spark, monkeypatch, most):
    """Rounds, components and whole units give the sequential matching, on a chain and on random edges."""
    from wallframe.operators import passes

    monkeypatch.setattr(passes, "UNIT_EDGES", most)
    rng = np.random.default_rng(5)
    chain = [(0, (k + 1) // 2, k // 2, 1.0 - k / 20) for k in range(13)]
    some = [(1, int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 20, 25), rng.integers(0, 20, 25), rng.random(25), strict=True)]
    rows = list({(i, a, b): (i, a, b, w) for i, a, b, w in chain + some}.values())
    iou = spark.createDataFrame(rows, "image_id bigint, pred_idx bigint, ann_idx bigint, iou double")
    got = {(r.image_id, r.pred_idx, r.ann_idx) for r in match_greedy(iou, 0.0).collect()}
    used, want = set(), set()
    for image, a, b, _ in sorted(rows, key=lambda r: (r[3], r[1], r[2]), reverse=True):
        if not {(image, "p", a), (image, "a", b)} & used:
            used |= {(image, "p", a), (image, "a", b)}
            want.add((image, a, b))
    assert got == want


def test_patch_cells_are_counted_on_the_row(spark):
    """Runs of one mask that share a cell are added up, without a shuffle of cells."""
    from wallframe.operators.masks import patch_coverage

    runs = {1: [(0, 0, 0, 6), (1, 1, 1, 2), (1, 1, 4, 4), (3, 6, 5, 7)], 2: [], 3: [(7, 7, 7, 7)]}
    masks = spark.createDataFrame([(1, k, r, 8, 8) for k, r in runs.items()], "image_id bigint, hold_index bigint, runs array<struct<y0:int,y1:int,x0:int,x1:int>>, width int, height int")
    found = patch_coverage(masks, 16, 4)
    want = {}
    for k, boxes in runs.items():
        canvas = np.zeros((8, 8))
        for y0, y1, x0, x1 in boxes:
            canvas[y0 : y1 + 1, x0 : x1 + 1] = 1
        shares = canvas.repeat(2, 0).repeat(2, 1).reshape(4, 4, 4, 4).mean(axis=(1, 3)).ravel()
        want.update({(k, int(c)): shares[c] for c in np.flatnonzero(shares)})
    assert {(r.hold_index, r.patch_id): r.weight for r in found.collect()} == want
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_small_images_share_a_kernel_call(spark):
    """Many small images, of vectors of two lengths, go through one walk over sorted rows."""
    rng = np.random.default_rng(9)
    data = {k: rng.normal(size=(int(rng.integers(1, 7)), 3 + k % 2)) for k in range(40)}
    rows = [(k, n, [float(v) for v in x]) for k, m in data.items() for n, x in enumerate(m)]
    found = pr.similarity_join(spark.createDataFrame(rows, "image_id bigint, hold_index bigint, embedding array<double>"), 0.6)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    expected = {(k, i, j) for k, m in data.items() for i in range(len(m)) for j in range(i + 1, len(m)) if cosine(m)[i, j] <= 0.6}
    assert {(r["image_id"], r["i"], r["j"]) for r in found.collect()} == expected


def test_units_are_cut_whole():
    batch = lambda values: pa.record_batch([pa.array(values)], names=["unit"])
    batches = [batch([None, 1, 1]), batch([1, 2]), batch([3, 3, 3, 3, 3, 3]), batch([3, 4, 5])]
    parts = [(t["unit"].to_pylist(), ends) for t, ends in whole_units(iter(batches), "unit", 4)]
    assert [v for values, _ in parts for v in values] == [None, 1, 1, 1, 2, *[3] * 7, 4, 5]
    assert all(len(values) <= 4 or len(set(values)) == 1 for values, _ in parts)
    for values, ends in parts:
        assert ends == [k + 1 for k in range(len(values)) if k + 1 == len(values) or values[k] != values[k + 1]]


def test_components_of_small_images_take_no_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    edges = [(image, int(a), int(b)) for image in range(6) for a, b in rng.integers(0, 60, (40, 2))]
    edges += [(9, k, k + 1) for k in range(300)]
    nodes = spark.createDataFrame([(k, n) for k in range(6) for n in range(60)] + [(9, n) for n in range(301)], "image_id bigint, hold_index bigint")
    links = spark.createDataFrame(edges, "image_id bigint, i bigint, j bigint")
    in_rounds = sorted(map(tuple, g.connected_components(nodes, links, most=2).collect()))
    stored = []
    monkeypatch.setattr(g, "materialize", lambda df, real=g.materialize: stored.append(1) or real(df))
    assert sorted(map(tuple, g.connected_components(nodes, links).collect())) == in_rounds
    assert len(stored) == 2
    assert {c for k, _, c in in_rounds if k == 9} == {0}


def test_iou_carries_columns_of_the_prediction(spark):
    box = "array(struct({x} AS x, 0 AS y), struct({x} + 9 AS x, 0 AS y), struct({x} + 9 AS x, 99 AS y), struct({x} AS x, 99 AS y)) AS polygon"
    masks = lambda n, x: with_runs(spark.range(n).selectExpr("1L AS image_id", "id AS hold_index", "concat('d', id) AS detector", box.format(x=x)))
    found = span_iou(masks(4, "CAST(id * 5 AS INT)"), masks(1, "0"), carry=("detector",)).collect()
    assert sorted((r["pred_idx"], r["detector"]) for r in found) == [(0, "d0"), (1, "d1")]


def test_small_units_are_passed_without_a_join(spark):
    edges = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.8), (2, 1, 0, 0.7)], "image_id bigint, pred_idx bigint, ann_idx bigint, iou double")
    matches = match_greedy(edges)
    assert "Join" not in matches._jdf.queryExecution().toString()
    assert sorted((r["image_id"], r["pred_idx"], r["ann_idx"]) for r in matches.collect()) == [(1, 0, 0), (2, 1, 0)]


def test_precision_curve_sorts_only_detections(spark, monkeypatch):
    """Ranks are taken along, so hits are neither joined with them nor range-partitioned; small chunks give the same curve."""
    predictions = spark.createDataFrame([("d", "clean", 1, k, 1.0 - k / 50) for k in range(40)], "implementation_id string, condition string, image_id bigint, pred_idx bigint, confidence double")
    annotations = spark.createDataFrame([("clean", 1, k) for k in range(20)], "condition string, image_id bigint, ann_idx bigint")
    iou = spark.createDataFrame([("d", "clean", 1, 2 * k + k % 2, k, 0.5 + k / 40) for k in range(20)], "implementation_id string, condition string, image_id bigint, pred_idx bigint, ann_idx bigint, iou double")
    calls = []
    monkeypatch.setattr(skew, "chunked", lambda *a, real=skew.chunked: calls.append(1) or real(*a))
    run = lambda: sorted(map(tuple, average_precision(predictions, annotations, iou).collect()))
    whole = run()
    assert len(calls) == 1 and whole[0][3] > 0
    monkeypatch.setattr(detection, "CHUNK_RANKS", 3)
    assert np.allclose([r[3] for r in run()], [r[3] for r in whole])


def test_fill_works_in_portions(monkeypatch):
    """A batch of polygons takes the memory of a portion, and portions give the runs of the whole."""
    rng = np.random.default_rng(5)
    rings = [[{"x": int(x), "y": int(y)} for x, y in rng.integers(-20, 60, (rng.integers(0, 7), 2))] for _ in range(300)] + [None, []]
    polygons = pa.array(rings, pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))
    whole = raster._fill(polygons).to_pylist()
    monkeypatch.setattr(raster, "EXPANDED", 64)
    assert raster.fill(polygons).to_pylist() == whole
    assert raster.fill(polygons.slice(7, 90)).to_pylist() == whole[7:97]
    assert raster.fill(polygons.slice(0, 0)).to_pylist() == []
    monkeypatch.undo()
    many = pa.concat_arrays([polygons] * 100)
    tracemalloc.start()
    raster.fill(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20


def test_pairs_of_boxes_are_not_merged_in_python(spark):
    """Boxes and triangles: pairs of boxes leave the merge of runs out, and no mask is cut or shuffled twice."""
    box = "array(struct(x AS x, 0 AS y), struct(x + 9 AS x, 0 AS y), struct(x + 9 AS x, 99 AS y), struct(x AS x, 99 AS y))"
    ring = f"CASE WHEN id % 3 = 0 THEN array(struct(x AS x, 0 AS y), struct(x + 40 AS x, 0 AS y), struct(x AS x, 40 AS y)) ELSE {box} END"
    masks = with_runs(spark.range(12).selectExpr("id", "CAST(id * 4 AS INT) AS x").selectExpr("1L AS image_id", "id AS hold_index", f"{ring} AS polygon"))
    pairs = span_iou(masks, masks)
    found = {(r["pred_idx"], r["ann_idx"]): r["iou"] for r in pairs.collect()}
    pixels = {r["hold_index"]: {(y, x) for q in r["runs"] for y in range(q["y0"], q["y1"] + 1) for x in range(q["x0"], q["x1"] + 1)} for r in masks.collect()}
    expected = {(i, j): len(a & b) / len(a | b) for i, a in pixels.items() for j, b in pixels.items() if a & b}
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-12 for k in expected)
    executed = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Union" in executed and "ReusedExchange" in executed
