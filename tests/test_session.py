from types import SimpleNamespace

import pytest

from folioweave.session import checkpoint, checkpoint_dir, discard, forget, repeatable, scratch


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, setting=None, folder=None):
    return SimpleNamespace(sparkContext=Context(master, folder), conf=SimpleNamespace(get=lambda key, default: setting))


def test_checkpoint_folder():
    assert checkpoint_dir(session("spark://x:7077", "/shared")) == "/shared"
    assert checkpoint_dir(session("spark://x:7077", None, "/set")) == "/set"
    assert checkpoint_dir(session("local[4]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(session("local-cluster[3,4,1024]"))


def test_checkpoint_keeps_the_rows(spark):
    assert checkpoint(spark.range(5)).count() == 5


def test_checkpoints_are_deleted(spark):
    kept = checkpoint(spark.range(5))
    forget(kept)
    with pytest.raises(Exception, match="(?i)checkpoint|exist"):
        kept.count()
    path = scratch(spark)
    spark.range(3).write.parquet(path)
    discard(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_only_shuffled_rows_are_written_to_be_repeatable(spark):
    plain = spark.range(5)
    assert repeatable(plain) is plain
    shuffled = plain.repartition(2)
    assert repeatable(shuffled) is not shuffled and repeatable(shuffled).count() == 5
