"""Registered queries against their SQL at the smallest scale. ``check_oracle.py`` runs all of them at any scale."""

import os

import pytest

import check_oracle
from workload.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
NAMES = [
    "file_features", "exif_fields", "filename_dates", "group_roles", "scan_summary", "compare_roles", "merge_plan",
    "organise_plan", "trash_manifest", "collision_free_names", "video_groups", "files_to_read", "nearest_folder",
    "calibration_score", "review_ground_truth", "csv_export",
]


@pytest.fixture(scope="module")
def connection():
    return check_oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, connection, name):
    error, rows = check_oracle.compare(spark, connection, name, QUERIES[name], SQL[name], SF_DIR)
    assert error is None
    assert rows > 0


def test_registry():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) - len(SQL) <= 4
