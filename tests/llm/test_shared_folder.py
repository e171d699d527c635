"""The folder for intermediate tables."""

import pytest

from codexa.llm import common


def test_shared_folder_must_be_set_on_a_cluster():
    conf = lambda master: type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda k, d=None: {"spark.master": master}.get(k, d)), "set": staticmethod(lambda k, v: None)})()})()
    assert common.shared_dir(conf("local[4]"))
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://x:7077"):
        with pytest.raises(ValueError):
            common.shared_dir(conf(master))
