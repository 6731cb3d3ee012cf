from types import SimpleNamespace

import pytest

from ruleloom import shared


def session(master, named=None, context=None):
    conf = {"spark.checkpoint.dir": named} if named else {}
    made = []
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else context, setCheckpointDir=made.append))
    return spark, made


def test_a_cluster_names_its_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        spark, made = session(master)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_folder(spark)
        assert not made
        assert shared.shared_folder(session(master, "hdfs:///x/")[0]) == "hdfs:///x"
        assert shared.shared_folder(session(master, None, "file:/y")[0]) == "file:/y"
    spark, made = session("local[4]")
    assert shared.shared_folder(spark) == made[0]


def test_written_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(shared._CLEANUP)
    df = shared.written(spark.range(20).repartition(3, "id"), "t")
    assert df.count() == 20 and spark.conf.get(shared._CLEANUP) == before
