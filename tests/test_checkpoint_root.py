"""Where scratch tables go when the cluster names a folder, and when nothing does."""

from types import SimpleNamespace as Bag

import pytest

from kestrel.session import checkpoint_root


def session(master, configured=None, own=None):
    def refuse(*_):
        raise AssertionError("the setting can't be changed in a running session")
    context = Bag(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: own)
    return Bag(conf=Bag(get=lambda key, default=None: configured, set=refuse), sparkContext=context)


def test_named_folders_come_first():
    assert checkpoint_root(session("yarn", "hdfs://a/b/")) == "hdfs://a/b"
    assert checkpoint_root(session("yarn", None, "hdfs://own")) == "hdfs://own"


def test_a_local_run_has_one_folder_of_its_own():
    spark = session("local[2]")
    assert checkpoint_root(spark) == checkpoint_root(spark)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        checkpoint_root(session("spark://host"))
