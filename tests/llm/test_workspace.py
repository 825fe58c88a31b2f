import os

import pytest

from quire.llm import columns, workspace
from quire.llm.workspace import Workspace, scratch


def files(work):
    return os.path.exists(work.folder.removeprefix("file:"))


def test_tables_end(spark):
    frame = spark.range(3)
    work = Workspace(spark)
    one, two = work.table(frame), work.table(frame)
    work.drop(one)
    assert two.count() == 3 and files(work)
    with scratch():
        inner = Workspace(spark)
        with scratch():
            deep = Workspace(spark)
            deep.table(frame)
            assert files(deep)
        kept = work.table(inner.table(frame))
        assert files(inner) and not files(deep)
    assert not files(inner) and kept.count() == 3
    work.clear(kept)
    assert kept.count() == 3
    work.end()
    assert not files(work) and work not in Workspace._all


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Inner:
                    @staticmethod
                    def getCheckpointDir():
                        class Option:
                            @staticmethod
                            def isDefined():
                                return False

                        return Option

                return Inner

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError):
        workspace.shared_folder(Session)
    Session.conf.get = staticmethod(lambda name, default: "hdfs://folder")
    assert workspace.shared_folder(Session) == "hdfs://folder"


def test_names():
    assert columns.without(["a", "B", "c"], ["b", "C"]) == ["a"]
    assert columns.fresh(["x", "__A", "__a_1"], "a", "a", "b") == ["__a_2", "__a_3", "__b"]
