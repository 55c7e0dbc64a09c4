"""Shared-folder resolution: read from the session, own folder only when unset."""

import os

import pytest

from turnstile import session


class _Conf:
    def __init__(self, v=None):
        self.v = v

    def get(self, k, d=None):
        return self.v if k == session.CHECKPOINT_CONF and self.v else d


class _SC:
    def __init__(self, conf_value=None):
        self._conf, self.dir, self.master = _Conf(conf_value), None, "local[2]"

    def getConf(self):
        return self._conf

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, p):
        self.dir = p


class _Spark:
    def __init__(self, conf_value=None):
        self.conf, self.sparkContext = _Conf(conf_value), _SC(conf_value)


def test_setting_from_session_is_used():
    s = _Spark("/shared/ckpt")
    assert session.shared_dir(s) == "/shared/ckpt"
    assert s.sparkContext.dir == "/shared/ckpt"


def test_local_master_gets_its_own_folder_once():
    s = _Spark(None)
    p = session.shared_dir(s)
    assert os.path.isdir(p) and s.sparkContext.dir == p
    assert session.shared_dir(s) == p
    assert session.scratch_path(s, "x").startswith(p.rstrip("/") + "/turnstile/x-")


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_other_masters_need_the_setting(master):
    s = _Spark(None)
    s.sparkContext.master = master
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(s)
