"""The shared folder: where it is, and that a run's tables go."""

import os

import pytest

from cohortspark.scratch import default_folder, materialise, run_folder, shared_dir


def test_machine_local_folders_are_refused_on_a_cluster():
    for warehouse in ("file:/home/me/spark-warehouse", "/home/me/spark-warehouse"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            default_folder("spark://host:7077", warehouse)
        assert os.path.isdir(default_folder("local[4]", warehouse))
    assert default_folder("yarn", "hdfs://name/warehouse") == "hdfs://name/warehouse/_checkpoints"


def test_tables_of_a_run_are_deleted(spark):
    before = shared_dir(spark)
    with run_folder(spark) as own:
        assert materialise(spark.range(100)).count() == 100
        at = own.removeprefix("file:")
        assert os.listdir(at) and shared_dir(spark) == own
    assert not os.path.exists(at) and shared_dir(spark).startswith(before.rstrip("/")) and materialise(spark.range(3)).count() == 3
