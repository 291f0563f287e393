"""The shared folder is required on clusters."""

import pytest

from storelens.session import ensure_checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, master, values):
        self.conf, self.sparkContext = _Conf(values), _Context(master)


def test_cluster_without_shared_folder_is_an_error():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(_Session(master, {}))


def test_named_folder_is_used():
    s = _Session("yarn", {"spark.checkpoint.dir": "hdfs:///shared"})
    assert ensure_checkpoint_dir(s) == "hdfs:///shared" and s.sparkContext.folder == "hdfs:///shared"
