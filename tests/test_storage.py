"""The shared folder: where tables go, what is refused, and their release."""

import glob

import pytest

from seriesloom import storage


class Session:
    """As much of a session as the rule for the folder looks at."""

    def __init__(self, master, named=None, set_by_context=None):
        values = {"spark.master": master, "spark.checkpoint.dir": named}

        class Conf:
            def get(self, key, default=None):
                return values.get(key) or default

        class Context:
            def getCheckpointDir(self):
                return set_by_context

        self.conf, self.sparkContext = Conf(), Context()


def test_folder_rule():
    assert storage.shared_folder(Session("spark://m", "hdfs://n/x/")) == "hdfs://n/x"
    assert storage.shared_folder(Session("yarn", None, "s3://b/c")) == "s3://b/c"
    assert storage.shared_folder(Session("local-cluster[2,1,1024]", "file:///tmp/x")) == "file:///tmp/x"
    for session in (Session("yarn"), Session("yarn", "/tmp/x"), Session("spark://m", "file:///var/tmp/x"),
                    Session("local-cluster[2,1,1024]")):
        with pytest.raises(RuntimeError):
            storage.shared_folder(session)


def test_stored_tables_are_released(spark):
    with storage.released_tables(spark):
        kept = storage.written_table(spark.range(10))
        folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert kept.count() == 10 and glob.glob(folder)
    assert not glob.glob(folder)


def test_early_cleanup_restores_the_setting(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    storage.written_table(spark.range(10).groupBy("id").count())
    assert spark.conf.get(key, None) == before
