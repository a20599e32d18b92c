"""Stages go to the folder that the session names."""

import pytest

from tagsight.plans import lineage


class _Conf:
    def get(self, key, default=None):
        return default


class _Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, path):
        self.folder = path


class _Session:
    def __init__(self, master):
        self.conf, self.sparkContext = _Conf(), _Context(master)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_dir(_Session(master))


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_local_mode_makes_one_folder(master):
    session = _Session(master)
    assert lineage.shared_dir(session) == lineage.shared_dir(session)


def test_the_named_folder_is_used(spark):
    assert lineage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
