"""Balanced pair samples drawn by rank: a draw costs its own size, whatever the number of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import chunked, ranked, running_sum
from ..store import materialize

CLASS = ["_image", "label"]


def _hashed(seed: int, *parts: str) -> Column:
    """60 bits of a digest, as a non-negative number; SQL engines agree on it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _drawn_ranks(classes: DataFrame, cap: int, seed: int) -> DataFrame:
    """_image, label, _at: distinct ranks, one at random from each of ``quota`` equal parts of the class's pairs."""
    of = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("_pairs"))), F.lit(0))
    totals = classes.groupBy("_image").agg(of(1).alias("_same"), of(0).alias("_other"))
    totals = totals.withColumn("_quota", F.least(F.lit(cap).cast("bigint"), "_same", "_other")).filter("_quota > 0")
    both = F.array(*[F.struct(F.lit(label).alias("label"), F.col(name).alias("_all")) for label, name in ((1, "_same"), (0, "_other"))])
    draws = totals.select("_image", "_quota", F.explode(both).alias("c")).select("_image", "_quota", "c.*")
    draws = draws.withColumn("_k", F.explode(F.expr("sequence(0L, _quota - 1)")))
    # The first ``_all % _quota`` parts are one longer.
    draws = draws.withColumns({"_part": F.expr("_all div _quota"), "_longer": F.col("_all") % F.col("_quota")})
    width = F.col("_part") + (F.col("_k") < F.col("_longer")).cast("bigint")
    start = F.col("_k") * F.col("_part") + F.least("_k", "_longer")
    return draws.select(*CLASS, (start + _hashed(seed, *CLASS, "_k") % width).alias("_at"))


def balanced_pairs(
    features: DataFrame, cap: int, seed: int, *, label: str = "route_id", key: str = "image_id", index: str = "hold_index"
) -> DataFrame:
    """Per image the same number of same-route and cross-route pairs, at most ``cap`` each: key, i, j, label.

    The holds of an image stand in order of route and index.  The pairs of a class are numbered by
    their later and then their earlier hold, which prefix sums over the routes turn back into two
    places, so only drawn pairs become rows.  Images that lack a class give no rows; a hold without
    a route is like no other; rows without an image are left out.  ``index`` must differ within an image.
    """
    alone = F.when(F.col(label).isNull(), F.col(index))
    holds = features.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_image"), F.col(index).alias("_hold"), F.col(label).alias("_route"), alone.alias("_alone")
    )
    holds, _ = materialize(ranked(holds, ["_image"], [F.col("_route"), F.col("_hold")], "_place"))
    routes = holds.groupBy("_image", "_route", "_alone").agg(
        (F.min("_place") - 1).alias("_skip"), F.count(F.lit(1)).alias("_members")
    )
    counted = {1: "_members * (_members - 1) div 2", 0: "_members * _skip"}
    sizes = F.array(*[F.struct(F.lit(c).alias("label"), F.expr(n).alias("_pairs")) for c, n in counted.items()])
    classes = routes.select("_image", "_skip", F.explode(sizes).alias("c")).select("_image", "_skip", "c.*").filter("_pairs > 0")
    chunks = chunked(classes, CLASS, [F.col("_skip")])
    ends = running_sum(chunks, CLASS, [F.col("_skip")], F.col("_pairs"), "_end")

    # Routes and draws in one order; the number of routes up to a draw names the route it falls into.
    firsts = ends.select(*CLASS, (F.col("_end") - F.col("_pairs")).alias("_at"), "_skip")
    line = firsts.unionByName(_drawn_ranks(chunks, cap, seed).withColumn("_skip", F.lit(None).cast("bigint")))
    order = [F.col("_at"), F.col("_skip").isNull()]
    line = running_sum(chunked(line, CLASS, order), CLASS, order, F.col("_skip").isNotNull().cast("bigint"), "_n")
    starts = line.filter("_skip is not null").select(*CLASS, "_n", "_skip", F.col("_at").alias("_first"))
    found = line.filter("_skip is null").select(*CLASS, "_n", "_at").join(starts, [*CLASS, "_n"])

    found = found.withColumn("_u", F.col("_at") - F.col("_first"))
    guess = F.floor((F.lit(1) + F.sqrt(F.lit(1) + 8 * F.col("_u"))) / 2).cast("bigint")
    found = found.withColumn("_g", guess)
    # The root of a large number may be off by one.
    row = F.expr("_g - int(_g * (_g - 1) div 2 > _u) + int(_g * (_g + 1) div 2 <= _u)")
    found = found.withColumn("_g", row)
    same = F.col("label") == 1
    places = found.select(
        *CLASS,
        (F.col("_skip") + 1 + F.when(same, F.col("_g")).otherwise(F.expr("_u div greatest(_skip, 1)"))).alias("_later"),
        F.when(same, F.expr("_skip + 1 + _u - _g * (_g - 1) div 2")).otherwise(F.expr("1 + _u % greatest(_skip, 1)")).alias("_earlier"),
    )
    at = lambda place, name: holds.select("_image", F.col("_place").alias(place), F.col("_hold").alias(name))
    pairs = places.join(at("_later", "_b"), ["_image", "_later"]).join(at("_earlier", "_a"), ["_image", "_earlier"])
    return pairs.select(F.col("_image").alias(key), F.least("_a", "_b").alias("i"), F.greatest("_a", "_b").alias("j"), "label")
