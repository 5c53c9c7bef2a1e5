"""Splits, derived records and their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import ranked

# Share of each split before renormalising over the chosen ones.
SPLIT_WEIGHTS = {"train": 0.8, "val": 0.1, "test": 0.1}
LIGHTING_ARMS = {"dark_025": -0.25, "dark_050": -0.50, "dark_075": -0.75}


def unit_hash(seed: int, source: Column) -> Column:
    """First eight bytes of sha256("seed:source") as a fraction of 2^64."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), source), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)


def hash_split(
    images: DataFrame, seed: int = 0, splits: Sequence[str] = ("train", "val", "test")
) -> tuple[DataFrame, DataFrame]:
    """(images with split, rejected): a preset split wins, an unknown preset is rejected."""
    total = sum(SPLIT_WEIGHTS[s] for s in splits)
    value = unit_hash(seed, F.coalesce("source_id", "image_id"))
    drawn, boundary = None, 0.0
    for name in splits:
        boundary += SPLIT_WEIGHTS[name] / total
        drawn = F.when(value < boundary, name) if drawn is None else drawn.when(value < boundary, name)
    drawn = drawn.otherwise(splits[-1])
    unknown = F.col("split").isNotNull() & ~F.col("split").isin(*splits)
    ok = images.filter(~unknown).withColumn("split", F.coalesce("split", drawn))
    return ok, images.filter(unknown).withColumn("reason", F.lit("split"))


def ratio_split(images: DataFrame, ratio: float, seed: int) -> DataFrame:
    """``train``/``val`` by position in md5 order; val gets max(1, round(n * ratio)), none if n <= 1."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must be between 0 and 1")
    n = images.count()
    held_out = max(1, round(n * ratio)) if n > 1 else 0
    lottery = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("image_id").cast("string")))
    shuffled = ranked(images.withColumn("_lot", lottery), [], [F.col("_lot"), F.col("image_id")], "position")
    return shuffled.withColumn(
        "split", F.when(F.col("position") <= held_out, "val").otherwise("train")
    ).drop("_lot")


def derive(images: DataFrame, dataset_id: str, seed: int, recipes: Sequence[tuple[str, str]]) -> DataFrame:
    """Augmented records of a plan.  ``recipes``: (kind, parameters as text) in order.

    The id carries the first 12 hex digits of a hash over source, dataset and plan.
    """
    if not recipes:
        return images.limit(0)
    plan = ";".join(f"{kind}={value}" for kind, value in recipes)
    print_of = F.sha2(F.concat_ws("|", "source_id", F.lit(dataset_id), F.lit(str(seed)), F.lit(plan)), 256)
    metadata = {"dataset_id": dataset_id, "seed": str(seed), "augmentations": ",".join(k for k, _ in recipes)}
    return images.withColumns(
        {
            "parent_image_id": F.col("image_id"),
            "image_id": F.concat("image_id", F.lit(":aug:"), F.substring(print_of, 1, 12)),
            "condition": F.lit("augmented"),
            "augmentation_metadata": F.create_map(*[F.lit(v) for item in metadata.items() for v in item]),
        }
    )


def iter_split(clean: DataFrame, derived: DataFrame, split: str, splits: Sequence[str]) -> DataFrame:
    """Records of one split ordered by source, each clean record before its derived ones."""
    if split not in splits:
        raise ValueError(f"unknown split {split!r}")
    both = clean.unionByName(derived, allowMissingColumns=True).filter(F.col("split") == split)
    return both.orderBy("source_id", F.col("condition") != "clean", "image_id")


def lighting_arms(
    images: DataFrame, arms: dict[str, float] = LIGHTING_ARMS, seed: int = 0, dataset_id: str = "evaluation"
) -> DataFrame:
    """Clean records paired with every lighting arm: arm, strength, condition."""
    def levels(df: DataFrame) -> DataFrame:
        table = F.array(*[F.struct(F.lit(n).alias("arm"), F.lit(float(s)).alias("strength")) for n, s in arms.items()])
        return df.withColumn("_arm", F.explode(table)).withColumns(
            {"arm": F.col("_arm.arm"), "strength": F.col("_arm.strength")}
        ).drop("_arm")

    clean = levels(images.withColumn("condition", F.lit("clean")))
    print_of = F.sha2(
        F.concat_ws("|", "source_id", F.lit(dataset_id), F.lit(str(seed)), "arm"), 256
    )
    dark = levels(images).withColumns(
        {
            "parent_image_id": F.col("image_id"),
            "image_id": F.concat("image_id", F.lit(":aug:"), F.substring(print_of, 1, 12)),
            "condition": F.lit("augmented"),
        }
    )
    return clean.unionByName(dark, allowMissingColumns=True)


def dataset_counts(images: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return images.groupBy(*keys).agg(
        F.count_if(F.col("condition") == "clean").alias("clean_record_count"),
        F.count_if(F.col("condition") == "augmented").alias("distorted_record_count"),
        F.count(F.lit(1)).alias("record_count"),
    )


def one_arm(images: DataFrame, arm: str) -> DataFrame:
    """Clean records together with a single distortion arm."""
    return images.filter((F.col("arm") == arm))
