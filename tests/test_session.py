"""The shared folder: read from the session, never set, an error on a cluster without one."""

import types

import pytest

from slotpack import session


def _fake(master="spark://host:7077", setting=None, folder=None, app="app-1"):
    sc = types.SimpleNamespace(master=master, applicationId=app, getCheckpointDir=lambda: folder)
    conf = types.SimpleNamespace(get=lambda key, default=None: setting if key == "spark.checkpoint.dir" else default)
    return types.SimpleNamespace(sparkContext=sc, conf=conf)


def test_setting_comes_first_then_the_context_folder():
    assert session.shared_dir(_fake(setting="hdfs:///a/", folder="/b")) == "hdfs:///a"
    assert session.shared_dir(_fake(folder="file:/b")) == "file:/b"


def test_cluster_without_a_folder_raises():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_fake())
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_fake(master="local-cluster[2,1,1024]"))


def test_local_master_gets_one_folder_per_application():
    a = session.shared_dir(_fake(master="local[4]", app="x"))
    assert a == session.shared_dir(_fake(master="local[4]", app="x")) != session.shared_dir(_fake(master="local", app="y"))


def test_stored_tables_round_trip_and_are_dropped_together(spark):
    before = spark.sparkContext.getCheckpointDir()
    df = session.materialize(spark.range(5), "numbers")
    path = df.inputFiles()[0]
    assert df.count() == 5 and f"/slotpack-tables/{spark.sparkContext.applicationId}/numbers-" in path
    assert spark.sparkContext.getCheckpointDir() == before
    own = session.table_path(spark, "x")
    assert own.startswith(session.shared_dir(spark))


def test_tables_of_other_applications_stay(spark, tmp_path):
    import os
    folder = session.shared_dir(spark)
    other = os.path.join(folder.removeprefix("file:"), "slotpack-tables", "another-app")
    os.makedirs(other, exist_ok=True)
    session.materialize(spark.range(3), "numbers")
    session.drop_tables(spark)
    assert os.path.isdir(other) and not os.path.isdir(os.path.join(os.path.dirname(other), spark.sparkContext.applicationId))
