"""Checkpoint folder policy: use the configured shared folder; invent a local
one only on a local master."""

import pytest

from quarry.session import ensure_checkpoint_dir


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)

    def set(self, key, value):
        self[key] = value


class _Context:
    def __init__(self, master, configured=None):
        self.master, self._dir, self._conf = master, None, _Conf()
        if configured:
            self._conf["spark.checkpoint.dir"] = configured

    def getCheckpointDir(self):
        return self._dir

    def getConf(self):
        return self._conf

    def setCheckpointDir(self, d):
        self._dir = d


class _Session:
    def __init__(self, master, configured=None):
        self.sparkContext = _Context(master, configured)
        self.conf = _Conf()


def test_configured_shared_folder_is_used():
    s = _Session("spark://cluster:7077", "hdfs://shared/ckpt")
    assert ensure_checkpoint_dir(s) == "hdfs://shared/ckpt"


def test_cluster_without_setting_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Session("yarn"))


def test_local_master_gets_a_private_folder():
    s = _Session("local[4]")
    d = ensure_checkpoint_dir(s)
    assert d and "quarry-ckpt-" in d and s.conf["spark.checkpoint.dir"] == d
