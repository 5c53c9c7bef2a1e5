"""Groupers by name.

A grouper is ``(features, config) -> groups``: features has image_id, hold_index and whatever the
grouper reads (embedding, lab, rgb, route_id); groups has image_id, hold_index, route_id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import grouping
from .operators.pairs import blended_join, score_pairs
from .store import materialize

Grouper = Callable[[DataFrame, dict], DataFrame]
_GROUPERS: dict[str, Grouper] = {}


def register_grouper(name: str, grouper: Grouper) -> None:
    _GROUPERS[name] = grouper


def grouper_names() -> list[str]:
    return sorted(_GROUPERS)


def get_grouper(name: str) -> Grouper:
    if name not in _GROUPERS:
        raise ValueError(f"unknown grouper {name!r}; choose one of {', '.join(grouper_names())}")
    return _GROUPERS[name]


def _labelled(components: DataFrame) -> DataFrame:
    return components.select("image_id", "hold_index", F.col("component").alias("label"))


def _clustering(features: DataFrame, config: dict) -> DataFrame:
    method, weight = config.get("method", "hdbscan"), float(config.get("color_weight", 1.0))
    if method == "dbscan":
        eps = float(config.get("eps", 0.3))
        found = grouping.dbscan(features, blended_join(features, eps, weight), eps, int(config.get("min_samples", 5)))
    elif method == "agglomerative":
        found = grouping.agglomerative(
            features, float(config.get("distance_threshold", 0.3)), config.get("linkage", "average"), weight
        )
    elif method == "hdbscan":
        from .operators.hierarchy import hdbscan

        found = hdbscan(
            features, int(config.get("min_cluster_size", 2)), config.get("min_samples"), color_weight=weight
        )
    else:
        raise ValueError("method must be hdbscan, dbscan or agglomerative")
    return grouping.finalize_groups(_labelled(found))


def _color(features: DataFrame, config: dict) -> DataFrame:
    space = config.get("color_space", "lab")
    if space not in {"lab", "rgb"}:
        raise ValueError("color_space must be rgb or lab")
    rows = features.select("image_id", "hold_index", F.col(space).cast("array<double>").alias("features"))
    found = grouping.kmeans(rows, int(config.get("n_clusters", 6)), int(config.get("random_state", 0)))
    return grouping.first_appearance_ids(found)


def _pair_head(features: DataFrame, config: dict) -> DataFrame:
    accepted = score_pairs(features, config["weights"], threshold=float(config.get("threshold", 0.5)))
    return grouping.finalize_groups(_labelled(grouping.connected_components(features, accepted)))


def _leader(features: DataFrame, config: dict) -> DataFrame:
    from .operators.leader import leader

    return leader(features, float(config.get("median_threshold", 0.7)), float(config.get("max_threshold", 2.65)))


def _annotated(features: DataFrame, config: dict) -> DataFrame:
    return grouping.replay_routes(features)


register_grouper("embedding_clustering", _clustering)
register_grouper("color_kmeans", _color)
register_grouper("pair_head", _pair_head)
register_grouper("leader", _leader)
register_grouper("annotated", _annotated)


def slug(name: str, config: dict) -> str:
    """File-safe name of a configured component."""
    parts = [name.lower().replace(" ", "_"), *[f"{k}-{config[k]}" for k in sorted(config)]]
    return "-".join(parts).strip("-").replace(".", "_")


def run_groupers(features: DataFrame, specs: Sequence[tuple[str, dict]]) -> tuple[DataFrame, DataFrame]:
    """(groups with a ``grouper`` column, errors): a component that fails becomes an error row.

    Each component's groups are stored inside its ``try``, so one whose job fails later than its plan
    is an error row as well.  If all fail, the groups are empty.
    """
    spark, errors = features.sparkSession, []
    kind = features.schema["image_id"].dataType.simpleString()
    merged = spark.createDataFrame([], f"image_id {kind}, hold_index bigint, route_id bigint, grouper string")
    for name, config in specs:
        label = slug(name, {k: v for k, v in config.items() if k != "weights"})
        try:
            groups = get_grouper(name)(features, config).withColumn("grouper", F.lit(label))
            part, _ = materialize(groups.select("image_id", "hold_index", "route_id", "grouper"))
        except Exception as error:  # noqa: BLE001 - one bad component must not end the run
            errors.append(("grouper", name, label, f"{type(error).__name__}: {error}".splitlines()[0]))
            continue
        merged = merged.unionByName(part)
    return merged, spark.createDataFrame(errors, "component_type string, name string, slug string, error string")
