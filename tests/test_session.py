"""The shared checkpoint folder: taken from the session, a private folder only in local mode."""

import pytest

from prefspark.session import checkpoint_root


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master):
        self.master = master
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Session:
    def __init__(self, master, conf):
        self.sparkContext = _Context(master)
        self.conf = _Conf(conf)


def test_uses_configured_shared_folder():
    s = _Session("spark://cluster:7077", {"spark.checkpoint.dir": "hdfs://nn/shared/ckpt"})
    assert checkpoint_root(s) == "hdfs://nn/shared/ckpt"


def test_refuses_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(_Session("yarn", {}))


def test_private_folder_only_in_local_mode():
    s = _Session("local[4]", {})
    root = checkpoint_root(s)
    assert root and s.sparkContext.getCheckpointDir() == root
