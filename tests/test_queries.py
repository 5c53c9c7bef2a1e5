"""Registered queries at the smallest scale, next to their SQL where there is one."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

import oracle_check
from __spark_entry__ import entry, oracle_sql, queries

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not present")


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(str(SF))


# One query per family; WALLFRAME_ALL_QUERIES=1 runs all of them.
FAMILIES = (
    "flt_geometry", "geo_hit_test", "msk_spans", "iou_slanted", "iou_nms", "evl_match", "evl_map", "evl_conditions",
    "win_envelope", "ord_candidates", "join_transfer", "join_map_back", "pair_blend", "pair_balanced", "grp_dbscan",
    "grp_finalize", "col_median_lab", "emb_pool_weighted", "aug_recolor_single", "ds_hash_split", "src_coco_holds",
    "src_via_json", "src_resolve_paths", "set_missing", "snk_metric_rows", "udf_errors", "run_matrix",
)
NAMES = sorted(queries()) if os.environ.get("WALLFRAME_ALL_QUERIES") else FAMILIES


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = queries()[name](spark, str(SF))
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0 and df.columns
    else:
        assert oracle_check.compare(df, con, sql) == ""


def test_entry(spark):
    assert entry(spark).count() > 0
