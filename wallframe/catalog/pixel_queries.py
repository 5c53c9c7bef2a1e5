"""Queries on colours, pixel features and distortions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.color import hls_to_rgb, rgb_to_hls, rgb_to_lab
from ..functions.geometry import box_polygon
from ..operators import augment as au
from ..operators import color_features as cf
from ..operators import masks as m
from ..operators.scanlines import to_hls, unpack_pixels
from . import views as w
from .views import PIXELS_SQL, r6

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def lab_sql(source: str) -> str:
    """8-bit CIELAB columns l8, a8, b8 for rows with r, g, b."""
    linear = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END"
    f = lambda v: f"CASE WHEN {v} > 0.008856 THEN cbrt({v}) ELSE 7.787 * {v} + 16 / 116.0::DOUBLE END"
    byte = lambda e: f"CAST(least(255, greatest(0, round_even({e}, 0))) AS INTEGER)"
    return f"""
c1 AS (SELECT *, {linear('r')} AS lr, {linear('g')} AS lg, {linear('b')} AS lb FROM {source}),
c2 AS (SELECT *, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 AS xx, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb AS yy,
  (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 AS zz FROM c1),
c3 AS (SELECT *, {f('xx')} AS fx, {f('yy')} AS fy, {f('zz')} AS fz, CASE WHEN yy > 0.008856 THEN 116 * cbrt(yy) - 16 ELSE 903.3 * yy END AS ll FROM c2),
lab AS (SELECT *, {byte('ll * 255 / 100')} AS l8, {byte('500 * (fx - fy) + 128')} AS a8, {byte('200 * (fy - fz) + 128')} AS b8 FROM c3)
"""


def hls_sql(source: str) -> str:
    byte = lambda e: f"CAST(least(255, greatest(0, round_even({e}, 0))) AS INTEGER)"
    return f"""
s1 AS (SELECT *, r / 255.0::DOUBLE AS rf, g / 255.0::DOUBLE AS gf, b / 255.0::DOUBLE AS bf FROM {source}),
s2 AS (SELECT *, greatest(rf, gf, bf) AS top, least(rf, gf, bf) AS low FROM s1),
s3 AS (SELECT *, top - low AS sp, top + low AS bo FROM s2),
s4 AS (SELECT *, CASE WHEN sp <= 0 THEN 0 WHEN bo < 1 THEN sp / bo ELSE sp / (2 - bo) END AS sat, CASE WHEN sp <= 0 THEN 0 WHEN top = rf THEN (gf - bf) / sp * 60
  WHEN top = gf THEN (bf - rf) / sp * 60 + 120 ELSE (rf - gf) / sp * 60 + 240 END AS hue FROM s3),
hls AS (SELECT *, {byte('CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2')} AS h, {byte('bo / 2 * 255')} AS l, {byte('sat * 255')} AS s FROM s4)
"""


def masks(spark, sf):
    return m.with_runs(w.pixel_holds(spark, sf))


def _channels():
    return [F.col(c) for c in ("r", "g", "b")]


@query("col_lab", f"WITH {PIXELS_SQL}, {lab_sql('px')} SELECT image_id, y, x, l8, a8, b8 FROM lab")
def _(spark, sf):
    l8, a8, b8 = rgb_to_lab(*_channels())
    return w.pixels(spark, sf).select("image_id", "y", "x", l8.alias("l8"), a8.alias("a8"), b8.alias("b8"))


@query("col_hls", f"WITH {PIXELS_SQL}, {hls_sql('px')} SELECT image_id, y, x, h, l, s FROM hls")
def _(spark, sf):
    h, l, s = rgb_to_hls(*_channels())
    return w.pixels(spark, sf).select("image_id", "y", "x", h.alias("h"), l.alias("l"), s.alias("s"))


BACK_SQL = """
t1 AS (SELECT *, l / 255.0::DOUBLE AS lf, s / 255.0::DOUBLE AS sf FROM hls),
t2 AS (SELECT *, CASE WHEN lf <= 0.5 THEN lf * (sf + 1) ELSE lf + sf - lf * sf END AS hi FROM t1),
t3 AS (SELECT *, lf * 2 - hi AS lo, h * 2 / 60.0::DOUBLE AS k FROM t2),
t4 AS (SELECT *, (k + 2) % 6 AS k1, k % 6 AS k2, (k + 4) % 6 AS k3 FROM t3)
"""


def _back(k: str) -> str:
    v = f"CASE WHEN {k} < 1 THEN lo + (hi - lo) * {k} WHEN {k} < 3 THEN hi WHEN {k} < 4 THEN lo + (hi - lo) * (4 - {k}) ELSE lo END"
    return f"CAST(least(255, greatest(0, round_even(255 * ({v}), 0))) AS INTEGER)"


@query("col_hls_back", f"WITH {PIXELS_SQL}, {hls_sql('px')}, {BACK_SQL} SELECT image_id, y, x, {_back('k1')} AS r2, {_back('k2')} AS g2, {_back('k3')} AS b2 FROM t4")
def _(spark, sf):
    h, l, s = rgb_to_hls(*_channels())
    coded = w.pixels(spark, sf).select("image_id", "y", "x", h.alias("h"), l.alias("l"), s.alias("s"))
    r, g, b = hls_to_rgb(F.col("h"), F.col("l"), F.col("s"))
    return coded.select("image_id", "y", "x", r.alias("r2"), g.alias("g2"), b.alias("b2"))


@query("col_median_lab", f"""WITH {PIXELS_SQL}, {lab_sql('inside')} SELECT image_id, hold_index, round(median(l8) * 100 / 255, 6) AS l, round((median(a8) - 128) * 100 / 255, 6) AS a,
  round((median(b8) - 128) * 100 / 255, 6) AS b FROM lab GROUP BY 1, 2""")
def _(spark, sf):
    return cf.median_lab(w.lines(spark, sf), masks(spark, sf)).select("image_id", "hold_index", r6("l"), r6("a"), r6("b"))


@query("col_mean_rgb", f"WITH {PIXELS_SQL} SELECT image_id, hold_index, round(avg(r), 6) AS c0, round(avg(g), 6) AS c1, round(avg(b), 6) AS c2 FROM inside GROUP BY 1, 2")
def _(spark, sf):
    return cf.mean_color(w.lines(spark, sf), masks(spark, sf)).select("image_id", "hold_index", r6("c0"), r6("c1"), r6("c2"))


@query("col_mean_lab", f"WITH {PIXELS_SQL}, {lab_sql('inside')} SELECT image_id, hold_index, round(avg(l8), 6) AS c0, round(avg(a8), 6) AS c1, round(avg(b8), 6) AS c2 FROM lab GROUP BY 1, 2")
def _(spark, sf):
    return cf.mean_color(w.lines(spark, sf), masks(spark, sf), "lab").select("image_id", "hold_index", r6("c0"), r6("c1"), r6("c2"))


@query("col_median_rgb", f"""WITH {PIXELS_SQL} SELECT image_id, hold_index, CAST(round_even(median(r), 0) AS INTEGER) AS r, CAST(round_even(median(g), 0) AS INTEGER) AS g,
  CAST(round_even(median(b), 0) AS INTEGER) AS b FROM inside GROUP BY 1, 2 UNION ALL SELECT DISTINCT image_id, 99, 1, 2, 3 FROM px""")
def _(spark, sf):
    known = masks(spark, sf)
    # A mask outside the picture has no pixels: its stored colour counts.
    corner = F.lit(500)
    blank = known.filter("hold_index = 0").withColumn("polygon", box_polygon(corner, corner, corner + 3, corner + 3))
    blank = m.with_runs(blank.withColumn("hold_index", F.lit(99).cast("bigint")).drop("runs", "area"))
    stored = blank.selectExpr("image_id", "hold_index", "1 AS sr", "2 AS sg", "3 AS sb")
    return cf.median_rgb(w.lines(spark, sf), known.unionByName(blank), stored)


@query("col_sample_hex", f"""WITH {PIXELS_SQL}, ck AS (SELECT image_id, hold_index AS click_id, CASE WHEN hold_index < 4 THEN hold_index END AS hold_index, (image_id * 3 + hold_index * 7) % 50 AS cx, (image_id * 5 + hold_index * 4) % 30 AS cy FROM pm),
  ar AS (SELECT i.image_id, i.hold_index, avg(i.r) AS r, avg(i.g) AS g, avg(i.b) AS b FROM inside i JOIN pm USING (image_id, hold_index) WHERE i.x < pm.r AND i.y < pm.b GROUP BY 1, 2),
  v AS (SELECT ck.image_id, ck.click_id, ck.hold_index, CASE WHEN ck.hold_index IS NULL THEN px.r ELSE ar.r END AS r, CASE WHEN ck.hold_index IS NULL THEN px.g ELSE ar.g END AS g,
    CASE WHEN ck.hold_index IS NULL THEN px.b ELSE ar.b END AS b FROM ck LEFT JOIN ar ON ar.image_id = ck.image_id AND ar.hold_index = ck.hold_index JOIN px ON px.image_id = ck.image_id AND px.x = cx AND px.y = cy)
  SELECT image_id, click_id, hold_index, printf('#%02x%02x%02x', CAST(floor(r + 0.5) AS BIGINT), CAST(floor(g + 0.5) AS BIGINT), CAST(floor(b + 0.5) AS BIGINT)) AS color FROM v""")
def _(spark, sf):
    holds = w.pixel_holds(spark, sf)
    clicks = holds.selectExpr(
        "image_id", "hold_index AS click_id", "CASE WHEN hold_index < 4 THEN hold_index END AS hold_index",
        "CAST((image_id * 3 + hold_index * 7) % 50 AS DOUBLE) AS x", "CAST((image_id * 5 + hold_index * 4) % 30 AS DOUBLE) AS y",
    )
    return cf.sample_hex(w.lines(spark, sf), holds, clicks)


# ---- embeddings of masks ---------------------------------------------------------------------
# A 2 x 2 grid of patches per image: the first four vectors of each image are its patch tokens.
POOL_SQL = f"""{PIXELS_SQL}, im AS (SELECT DISTINCT image_id FROM px),
bx AS (SELECT image_id, hold_index, l, t, r, b FROM pm),
cell AS (SELECT bx.*, q AS patch_id, q % 2 AS qx, CAST(floor(q / 2) AS BIGINT) AS qy FROM bx, range(4) AS s(q)),
gx AS (SELECT *, CAST(ceil(l * 32 / 50.0::DOUBLE - 0.5) AS BIGINT) AS x0, CAST(ceil((r + 1) * 32 / 50.0::DOUBLE - 0.5) AS BIGINT) - 1 AS x1,
  CAST(ceil(t * 32 / 30.0::DOUBLE - 0.5) AS BIGINT) AS y0, CAST(ceil((b + 1) * 32 / 30.0::DOUBLE - 0.5) AS BIGINT) - 1 AS y1 FROM cell),
wt AS (SELECT image_id, hold_index, patch_id, greatest(0, least(x1, qx * 16 + 15) - greatest(x0, qx * 16) + 1) * greatest(0, least(y1, qy * 16 + 15) - greatest(y0, qy * 16) + 1) / 256.0::DOUBLE AS wt FROM gx),
tk AS (SELECT image_id, p AS patch_id, CAST(embedding AS DOUBLE[]) AS e FROM im, range(4) AS s(p), embeddings WHERE vec_id = (image_id * 4 + p) % (SELECT count(*) FROM embeddings)),
el AS (SELECT wt.image_id, wt.hold_index, wt.wt, k, tk.e[k] AS v FROM wt JOIN tk ON tk.image_id = wt.image_id AND tk.patch_id = wt.patch_id, range(1, 65) AS z(k) WHERE wt.wt > 0)"""


def _pool_sql(weight: str) -> str:
    return f"""WITH {POOL_SQL}, mn AS (SELECT image_id, hold_index, k, sum({weight} * v) / sum({weight}) AS v FROM el GROUP BY 1, 2, 3),
  nn AS (SELECT image_id, hold_index, sqrt(sum(v * v)) AS n FROM mn GROUP BY 1, 2)
  SELECT image_id, hold_index, k AS dim, round(v / n, 6) AS value FROM mn JOIN nn USING (image_id, hold_index)"""


def pooled(spark, sf, pooling):
    vectors = w.table(spark, sf, "embeddings")
    tokens = (
        w.pixel_images(spark, sf)
        .withColumn("patch_id", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .withColumn("vec_id", (F.col("image_id") * 4 + F.col("patch_id")) % vectors.count())
        .join(vectors.select("vec_id", F.col("embedding").alias("token")), "vec_id")
    )
    coverage = m.patch_coverage(masks(spark, sf), size=32, patch=16)
    found = cf.pool_embeddings(tokens.select("image_id", "patch_id", "token"), coverage, pooling)
    return found.select("image_id", "hold_index", F.posexplode("embedding").alias("pos", "v")).select(
        "image_id", "hold_index", (F.col("pos") + 1).cast("bigint").alias("dim"), F.round("v", 6).alias("value")
    )


@query("emb_pool_weighted", _pool_sql("wt"))
def _(spark, sf):
    return pooled(spark, sf, "weighted")


@query("emb_pool_mean", _pool_sql("1"))
def _(spark, sf):
    return pooled(spark, sf, "mean")


@query("emb_stale", """SELECT CASE WHEN vec_id % 6 = 0 THEN 'stale' ELSE 'cached' END AS state, count(*) AS n FROM embeddings GROUP BY 1""")
def _(spark, sf):
    rows = w.vectors(spark, sf).select(F.col("hold_index").alias("key"), "route_id", "embedding")
    current = rows.select("key", cf.signature("key", "route_id").alias("signature"), "embedding")
    # The cache knows an older label for every sixth vector.
    old = rows.withColumn("route_id", F.when(F.col("key") % 6 == 0, -1).otherwise(F.col("route_id")))
    cache = old.select("key", cf.signature("key", "route_id").alias("signature"), "embedding")
    fresh = cf.stale_features(current, cache)
    merged = cf.merge_features(cache, fresh)
    state = merged.join(fresh.select("key", F.lit("stale").alias("state")), "key", "left")
    return state.groupBy(F.coalesce("state", F.lit("cached")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


# ---- distortions -----------------------------------------------------------------------------
@query("aug_lighting", f"""WITH {PIXELS_SQL} SELECT image_id, y, x, CAST(floor(least(255, greatest(0, r * (1 + s)))) AS INTEGER) AS r, CAST(floor(least(255, greatest(0, g * (1 + s)))) AS INTEGER) AS g,
  CAST(floor(least(255, greatest(0, b * (1 + s)))) AS INTEGER) AS b FROM (SELECT *, CASE image_id % 3 WHEN 0 THEN -0.25::DOUBLE WHEN 1 THEN -0.5 ELSE 0.75 END AS s FROM px)""")
def _(spark, sf):
    strength = F.when(F.col("image_id") % 3 == 0, -0.25).when(F.col("image_id") % 3 == 1, -0.5).otherwise(0.75)
    return unpack_pixels(au.lighting(w.lines(spark, sf), strength))


def _targets(spark, sf):
    return masks(spark, sf).selectExpr(
        "*", "CAST(hold_index * 40 AS INT) AS tr", "CAST(200 - hold_index * 30 AS INT) AS tg", "CAST(90 AS INT) AS tb", "CAST(hold_index AS DOUBLE) / 5 AS strength"
    )


@query("aug_recolor_single", f"""WITH {PIXELS_SQL}, {hls_sql('px')}, tg AS (SELECT 80 AS r, 140 AS g, 90 AS b),
  mk AS (SELECT * FROM pm WHERE hold_index = 2), md AS (SELECT h.image_id, median(h.l) AS mid FROM hls h JOIN mk ON mk.image_id = h.image_id AND h.x BETWEEN mk.l AND mk.r AND h.y BETWEEN mk.t AND mk.b GROUP BY 1)
  SELECT h.image_id, h.y, h.x, CASE WHEN mk.image_id IS NOT NULL THEN 65 ELSE h.h END AS h2,
  CASE WHEN mk.image_id IS NOT NULL THEN CAST(floor(least(255, greatest(0, h.l - md.mid + 110))) AS INTEGER) ELSE h.l END AS l2 FROM hls h JOIN md ON md.image_id = h.image_id
  LEFT JOIN mk ON mk.image_id = h.image_id AND h.x BETWEEN mk.l AND mk.r AND h.y BETWEEN mk.t AND mk.b""")
def _(spark, sf):
    done = au.recolor_hls(to_hls(w.lines(spark, sf)), _targets(spark, sf).filter("hold_index = 2"))
    return unpack_pixels(done, ("h2", "l2", "s2")).drop("s2")


# The goal colour of each target in HLS, and one step per target in its order.
GOALS_SQL = f"""
gc AS (SELECT k AS hold_index, k * 40 AS r, 200 - k * 30 AS g, 90 AS b FROM range(6) AS s(k)),
{hls_sql('gc').replace('s1 AS', 'u1 AS').replace('s2 AS', 'u2 AS').replace('s3 AS', 'u3 AS').replace('s4 AS', 'u4 AS').replace('FROM s', 'FROM u').replace('hls AS', 'goal AS')}
"""


def _recolor_sql(source: str, holds: list[int], out: str) -> str:
    """``out``: pixels of ``source`` (image_id, x, y, h, l, s) after recolouring ``holds`` in order."""
    parts, last = [], source
    for k in holds:
        inside = f"m.image_id = v.image_id AND m.hold_index = {k} AND v.x BETWEEN m.l AND m.r AND v.y BETWEEN m.t AND m.b"
        parts.append(f"""{out}_m{k} AS (SELECT v.image_id, median(v.l) AS mid FROM {last} v JOIN pm m ON {inside} GROUP BY 1),
{out}_{k} AS (SELECT v.image_id, v.x, v.y, CASE WHEN m.hold_index IS NULL THEN v.h ELSE o.h END AS h,
  CASE WHEN m.hold_index IS NULL THEN v.l ELSE CAST(floor(least(255, greatest(0, v.l + (o.l - d.mid)))) AS INTEGER) END AS l,
  CASE WHEN m.hold_index IS NULL THEN v.s ELSE o.s END AS s
  FROM {last} v LEFT JOIN pm m ON {inside} LEFT JOIN {out}_m{k} d ON d.image_id = v.image_id LEFT JOIN goal o ON o.hold_index = {k})""")
        last = f"{out}_{k}"
    back = BACK_SQL.replace("FROM hls", f"FROM {last}")
    return ",\n".join(parts) + f""",
{back},
{out} AS (SELECT image_id, y, x, {_back('k1')} AS r, {_back('k2')} AS g, {_back('k3')} AS b FROM t4)"""


@query("aug_recolor", f"WITH {PIXELS_SQL}, {hls_sql('px')}, {GOALS_SQL}, {_recolor_sql('hls', list(range(6)), 'rc')} SELECT image_id, y, x, r, g, b FROM rc")
def _(spark, sf):
    return unpack_pixels(au.recolor(w.lines(spark, sf), _targets(spark, sf)))


def _chalk_sql(source: str, holds: list[int], seed: int, out: str) -> str:
    """``out``: pixels of ``source`` after chalk on ``holds`` in order, with strength hold / 5."""
    a = "(-0.75::DOUBLE)"
    far = lambda d: f"((({d} * {a} - 5.0 * {a}) * {d} + 8.0 * {a}) * {d} - 4.0 * {a})"
    near = lambda d: f"((({d} * ({a} + 2.0) - ({a} + 3.0)) * {d}) * {d} + 1.0)"
    weight = lambda t: f"CASE k WHEN 0 THEN {far(f'({t} + 1.0)')} WHEN 1 THEN {near(t)} WHEN 2 THEN {near(f'(1.0 - {t})')} ELSE {far(f'(2.0 - {t})')} END"
    # 50 x 30 pixels have two cells side by side and one above the other.
    steps = f"""{out}_n0 AS (SELECT image_id, hold_index, c, xor(0, {seed}) AS v FROM (SELECT DISTINCT image_id FROM px), range(6) AS s(hold_index), range(2) AS q(c))"""
    for k, value in enumerate(("image_id", "hold_index", "0", "c", "1", "NULL"), 1):
        step = f"(v * {au.MULTIPLIER}::BIGINT + {au.INCREMENT}) % {au.MASK + 1}"
        hashed = f"xor({step}, ({step}) >> 15)"
        follow = "" if value == "NULL" else f"xor({hashed}, {value})"
        steps += f""",
{out}_n{k} AS (SELECT image_id, hold_index, c, {follow or hashed} AS v FROM {out}_n{k - 1})"""
    axis = lambda at, cells, size: f"(({at} + 0.5::DOUBLE) * {cells} / {size} - 0.5)"
    parts = [steps]
    parts.append(f"""{out}_x AS (SELECT x, floor({axis('x', 2, 50)}) AS base, {axis('x', 2, 50)} - floor({axis('x', 2, 50)}) AS t FROM range(50) AS s(x)),
{out}_wx AS (SELECT x, k, CAST(least(greatest(base + k - 1, 0), 1) AS BIGINT) AS c, {weight('t')} AS w FROM {out}_x, range(4) AS q(k)),
{out}_y AS (SELECT y, {axis('y', 1, 30)} - floor({axis('y', 1, 30)}) AS t FROM range(30) AS s(y)),
{out}_wy AS (SELECT y, sum(w) AS w FROM (SELECT y, {weight('t')} AS w FROM {out}_y, range(4) AS q(k)) GROUP BY 1),
{out}_d AS (SELECT n.image_id, n.hold_index, y, x, pow(least(greatest(wy.w * wx.v, 0.0), 1.0), 2) AS d
  FROM (SELECT n.image_id, n.hold_index, x, sum(w * v / {au.MASK + 1}::DOUBLE) AS v FROM {out}_wx JOIN {out}_n6 n USING (c) GROUP BY ALL) wx
  JOIN (SELECT DISTINCT image_id, hold_index FROM {out}_n6) n USING (image_id, hold_index), {out}_wy wy),
{out}_s AS (SELECT image_id, x, y, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM {source})""")
    last = f"{out}_s"
    for k in holds:
        alpha = f"coalesce(d.d * least(greatest(((v.r * 0.2126::DOUBLE + v.g * 0.7152::DOUBLE + v.b * 0.0722::DOUBLE) / 255.0 - 0.1) / 0.3, 0.0), 1.0) * ({k}::DOUBLE / 5), 0.0)"
        parts.append(f"""{out}_{k} AS (SELECT image_id, x, y, r + (255.0 - r) * alpha AS r, g + (255.0 - g) * alpha AS g, b + (255.0 - b) * alpha AS b
  FROM (SELECT v.*, {alpha} AS alpha FROM {last} v LEFT JOIN pm m ON m.image_id = v.image_id AND m.hold_index = {k} AND v.x BETWEEN m.l AND m.r AND v.y BETWEEN m.t AND m.b
  LEFT JOIN {out}_d d ON d.image_id = v.image_id AND d.hold_index = m.hold_index AND d.x = v.x AND d.y = v.y))""")
        last = f"{out}_{k}"
    cut = lambda c: f"CAST(floor(least(255.0, greatest(0.0, {c}))) AS INTEGER) AS {c}"
    parts.append(f"{out} AS (SELECT image_id, y, x, {cut('r')}, {cut('g')}, {cut('b')} FROM {last})")
    return ",\n".join(parts)


@query("aug_chalk", f"WITH {PIXELS_SQL}, {_chalk_sql('px', list(range(1, 6)), 3, 'ck')} SELECT image_id, y, x, r, g, b FROM ck")
def _(spark, sf):
    return unpack_pixels(au.chalk(w.lines(spark, sf), _targets(spark, sf), seed=3))


@query("aug_plan", f"""WITH {PIXELS_SQL}, {hls_sql('px')}, {GOALS_SQL}, {_recolor_sql('hls', [0, 1, 2, 3], 'rc')}, {_chalk_sql('rc', [2, 3, 4, 5], au.step_seed(1, 1), 'ck')}
  SELECT image_id, y, x, CAST(floor(r * 0.75) AS INTEGER) AS r, CAST(floor(g * 0.75) AS INTEGER) AS g, CAST(floor(b * 0.75) AS INTEGER) AS b FROM ck""")
def _(spark, sf):
    targets = _targets(spark, sf)
    plan = [("color", targets.filter("hold_index < 4")), ("chalk", targets.filter("hold_index >= 2")), ("lighting", -0.25)]
    return unpack_pixels(au.apply_plan(w.lines(spark, sf), plan, seed=1))


@query("aug_requests", f"""WITH {PIXELS_SQL}, rq AS (SELECT *, CASE WHEN hold_index % 2 = 0 THEN hold_index * 40 END AS cr FROM pm)
  SELECT image_id, 0 AS step, 'color' AS kind, hold_index, NULL::DOUBLE AS strength, cr AS r FROM rq WHERE cr IS NOT NULL UNION ALL SELECT image_id, 1, 'chalk', hold_index, round(hold_index * 15 / 100.0::DOUBLE, 6), NULL FROM rq
  UNION ALL SELECT image_id, 2, 'lighting', NULL, round((image_id % 3 - 1) / 4.0::DOUBLE, 6), NULL FROM (SELECT DISTINCT image_id FROM px) WHERE image_id % 3 <> 1""")
def _(spark, sf):
    requests = w.pixel_holds(spark, sf).selectExpr(
        "image_id", "hold_index", "hold_index * 15 AS chalk_percent", "CASE WHEN hold_index % 2 = 0 THEN CAST(hold_index * 40 AS INT) END AS r", "10 AS g", "20 AS b"
    )
    lights = w.pixel_images(spark, sf).selectExpr(
        "image_id", "CAST(image_id % 3 - 1 AS DOUBLE) / 4 AS lighting", "CAST(NULL AS STRING) AS source_pixel_hash", "sha2(CAST(image_id AS STRING), 256) AS pixel_hash"
    )
    return au.plan_from_requests(requests, lights).select("image_id", "step", "kind", "hold_index", r6("strength"), F.col("r").cast("bigint").alias("r"))


@query("join_recipes", f"""WITH {PIXELS_SQL} SELECT 'bound' AS part, count(*) AS n FROM pm WHERE hold_index < 4 UNION ALL SELECT 'orphan', count(*) FROM pm WHERE hold_index >= 4""")
def _(spark, sf):
    holds = w.pixel_holds(spark, sf)
    requests = holds.selectExpr("image_id", "CASE WHEN hold_index < 4 THEN hold_index ELSE hold_index + 100 END AS hold_index", "hold_index * 15 AS chalk_percent")
    bound, orphaned = au.bind_recipes(requests, holds.select("image_id", "hold_index", "polygon"))
    part = lambda df, name: df.select(F.lit(name).alias("part"))
    return part(bound, "bound").unionByName(part(orphaned, "orphan")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
