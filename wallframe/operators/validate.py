"""Row validation, filters and value normalisation.

Every validator splits its input in two: rows that pass, and rejected rows with a ``reason``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import is_valid_polygon

CONDITIONS = ("clean", "augmented")


def _first_failure(checks: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first check that does not hold (null counts as not holding)."""
    return F.coalesce(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks])


def _split(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("reason", _first_failure(checks))
    return (
        marked.filter(F.col("reason").isNull()).drop("reason"),
        marked.filter(F.col("reason").isNotNull()),
    )


def _filled(name: str) -> Column:
    return F.length(F.trim(F.col(name))) > 0


def _filled_or_null(name: str) -> Column:
    return F.col(name).isNull() | _filled(name)


def validate_holds(holds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Polygons need three distinct points with non-negative coordinates."""
    return _split(holds, [("polygon", is_valid_polygon(F.col("polygon")))])


def validate_colors(colors: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(colors, [(c, F.col(c).between(0, 255)) for c in ("r", "g", "b")])


def validate_images(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids and split non-empty, condition known; ``source_id`` defaults to ``image_id``."""
    ok, rejected = _split(
        images,
        [
            ("image_id", _filled("image_id")),
            ("split", _filled_or_null("split")),
            ("source_id", _filled_or_null("source_id")),
            ("parent_image_id", _filled_or_null("parent_image_id")),
            ("condition", F.col("condition").isin(*CONDITIONS)),
        ],
    )
    return ok.withColumn("source_id", F.coalesce("source_id", "image_id")), rejected


def validate_recipes(recipes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns: kind, targets (array), strengths (array<double>), colors (array<struct<r,g,b>>), strength."""
    kind = F.col("kind")
    chalk, color, light = kind == "chalk", kind == "color", kind == "lighting"
    channels = F.forall(
        F.col("colors"),
        lambda c: c["r"].between(0, 255) & c["g"].between(0, 255) & c["b"].between(0, 255),
    )
    return _split(
        recipes,
        [
            ("kind", chalk | color | light),
            (
                "alignment",
                F.when(chalk, F.size("targets") == F.size("strengths"))
                .when(color, F.size("targets") == F.size("colors"))
                .otherwise(F.lit(True)),
            ),
            (
                "range",
                F.when(chalk, F.forall(F.col("strengths"), lambda s: s.between(0.0, 1.0)))
                .when(color, channels)
                .otherwise(F.col("strength").between(-1.0, 1.0)),
            ),
        ],
    )


def drop_volumes(holds: DataFrame) -> DataFrame:
    """Keep everything but volumes; an unknown type passes."""
    return holds.filter(~F.col("hold_type").eqNullSafe("volume"))


def route_eligible(holds: DataFrame) -> DataFrame:
    return drop_volumes(holds).filter(F.col("route_id").isNotNull())


def normalized_label(label: Column) -> Column:
    return F.when(F.lower(label) == "unknown", F.lit("Unknown")).otherwise(label)


def route_id_of(label: Column) -> Column:
    """Integer of a ``route_<n>`` label; null for any other label."""
    return F.regexp_extract(label, "^route_([0-9]+)$", 1).try_cast("int")


def normalize_route_label(holds: DataFrame) -> DataFrame:
    label = normalized_label(F.col("route_label"))
    return holds.withColumn("route_label", label).withColumn("route_id", route_id_of(label))


def finite(value: Column) -> Column:
    """True for a present number that is neither NaN nor infinite."""
    v = value.cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))


def with_confidence(holds: DataFrame, fallback: float = 1.0) -> DataFrame:
    """Finite confidences are kept, others replaced; the origin goes to ``confidence_source``."""
    known = finite(F.col("confidence"))
    return holds.withColumns(
        {
            "confidence_source": F.when(known, "attribute").otherwise("fallback"),
            "confidence": F.when(known, F.col("confidence")).otherwise(F.lit(float(fallback))),
        }
    )


def score_filter(holds: DataFrame, min_score: float = 0.4, classes: Sequence[int] = (0,)) -> DataFrame:
    return holds.filter((F.col("confidence") >= min_score) & F.col("class_id").isin(*classes))


def normalize_scores(holds: DataFrame, score: str = "score") -> tuple[DataFrame, DataFrame]:
    """Scores outside [0, 1] go through a sigmoid; non-finite scores are rejected."""
    ok, rejected = _split(holds, [("score", finite(F.col(score)))])
    value = F.col(score)
    squashed = F.when(value.between(0.0, 1.0), value).otherwise(1.0 / (1.0 + F.exp(-value)))
    return ok.withColumn(score, squashed), rejected


def orphans(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only: what a batch-alignment error would report."""
    keys = list(keys)
    l, r = left.select(*keys).distinct(), right.select(*keys).distinct()
    return (
        l.join(r, keys, "left_anti")
        .withColumn("side", F.lit("left"))
        .unionByName(r.join(l, keys, "left_anti").withColumn("side", F.lit("right")))
    )
