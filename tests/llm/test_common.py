"""Where intermediate tables go, and that they are removed."""

import os

import pytest

from massgrid.llm import common


def test_removed(tmp_path):
    for uri in (str(tmp_path / "a"), f"file://{tmp_path / 'b'}"):
        path = uri.removeprefix("file://")
        os.makedirs(f"{path}/x.parquet")
        common.removed(uri)
        common.removed(uri)
        assert not os.path.exists(path)
    with pytest.warns(UserWarning, match="stays"):
        common.removed("nostore:///x")


def test_saved_tables_share_a_folder(spark, tmp_path):
    rows = spark.range(5)
    folder = f"{tmp_path}/work"
    one, two = common.saved(rows, "t", folder), common.saved(rows.where("id > 2"), "t", folder)
    assert (one.count(), two.count()) == (5, 2) and len(os.listdir(folder)) == 2
    assert common.shared_folder(spark, "t") != common.shared_folder(spark, "t")
