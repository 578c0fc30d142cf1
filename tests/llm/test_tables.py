import os
from types import SimpleNamespace

import pytest

from kalibra.llm import tables


def test_a_cluster_needs_a_shared_folder():
    there = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(RuntimeError):
        tables.shared_root(there)


def test_tables_are_removed_and_no_setting_is_left(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    kept = tables.materialise(spark.range(5), "five")
    folder = tables.shared_root(spark).removeprefix("file:").replace("//", "/")
    assert kept.count() == 5 and os.listdir(folder)
    tables.release(spark)
    assert not os.path.exists(folder)
    assert spark.conf.get("spark.checkpoint.dir", None) == before
