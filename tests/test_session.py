import pathlib
from types import SimpleNamespace

import pytest

from feira import CleanTables, session
from feira.plans import revenue
from tests.frames import rows


def test_written_tables_lie_in_the_configured_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    df = session.write_and_read(spark.range(3).toDF("n"), "numbers")
    assert rows(df) == [(0,), (1,), (2,)]
    assert all(f.removeprefix("file://").startswith(root) for f in df.inputFiles())


def test_settings_are_applied(spark):
    assert all(session.configure(spark).conf.get(k) == v for k, v in session.RUNTIME_CONF.items())


def fake(master, configured=None, more=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, applicationId="app-1")
    conf = {"spark.checkpoint.dir": configured} | (more or {})
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: conf.get(key) or default))


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError):
        session.shared_folder(fake("yarn"))


def test_a_cluster_uses_the_folder_it_names():
    assert session.shared_folder(fake("yarn", "hdfs:///shared/")) == "hdfs:///shared/feira-app-1"


def test_a_cluster_is_not_given_a_local_folder():
    for path in ("/tmp/here", "file:///tmp/here", "file:/tmp/here"):
        with pytest.raises(ValueError):
            session.shared_folder(fake("spark://host:7077", path))
    # On one machine, and where the mount is said to be shared, it serves.
    assert session.shared_folder(fake("local-cluster[2,1,1024]", "file:///tmp/here")) == "file:///tmp/here/feira-app-1"
    assert session.shared_folder(fake("yarn", "/mnt/all", {session.SHARED_MOUNT: "true"})) == "/mnt/all/feira-app-1"


class Cluster:
    """The test session under the name of a cluster; with ``lost`` what executors write is not there to be read."""

    def __init__(self, spark, folder, lost=False):
        real = spark.sparkContext
        self.sparkContext = SimpleNamespace(
            master="spark://host:7077", getCheckpointDir=lambda: None, applicationId=f"app-{folder.name}",
            defaultParallelism=real.defaultParallelism,
        )
        self.conf = SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": f"file://{folder}"}.get(key) or default)
        self.tries, self.read, self.spark, self.lost = 0, spark.read, spark, lost

    def range(self, *args):
        self.tries += 1
        return self.spark.range(*args).where("id % 3 = 0") if self.lost else self.spark.range(*args)


def test_a_cluster_uses_a_local_folder_that_is_one_mount_for_all(spark, tmp_path):
    cluster = Cluster(spark, tmp_path)
    for _ in range(3):
        assert session.shared_folder(cluster) == f"file://{tmp_path}/feira-app-{tmp_path.name}"
    assert cluster.tries == 1


def test_a_cluster_is_not_given_a_local_folder_where_rows_get_lost(spark, tmp_path):
    with pytest.raises(ValueError):
        session.shared_folder(Cluster(spark, tmp_path, lost=True))


def test_a_cluster_without_a_folder_named_uses_the_warehouse(spark, tmp_path):
    more = {"spark.sql.warehouse.dir": "hdfs:///warehouse"}
    assert session.shared_folder(fake("yarn", more=more)) == "hdfs:///warehouse/feira-app-1"
    more = {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}
    assert session.shared_folder(fake("local-cluster[3,4,10240]", more=more)) == "file:/tmp/warehouse/feira-app-1"
    cluster = Cluster(spark, tmp_path)
    cluster.conf = SimpleNamespace(get=lambda key, default: {"spark.sql.warehouse.dir": f"file://{tmp_path}"}.get(key) or default)
    assert session.shared_folder(cluster) == f"file://{tmp_path}/feira-app-{tmp_path.name}"


def test_a_cluster_uses_the_warehouse_where_the_folder_named_is_not_shared(spark, tmp_path):
    (tmp_path / "plain").touch()  # nothing can be written below a file
    named = {"spark.checkpoint.dir": f"file://{tmp_path}/plain", "spark.sql.warehouse.dir": f"file://{tmp_path}/all"}
    cluster = Cluster(spark, tmp_path)
    cluster.conf = SimpleNamespace(get=lambda key, default: named.get(key) or default)
    for _ in range(3):
        assert session.shared_folder(cluster) == f"file://{tmp_path}/all/feira-app-{tmp_path.name}"
    assert cluster.tries == 2


def test_several_processes_on_one_machine_need_a_folder_named():
    with pytest.raises(ValueError):
        session.shared_folder(fake("local-cluster[2,1,1024]"))


def written(spark):
    root = pathlib.Path(session.shared_folder(spark).removeprefix("file://"))
    return {p for p in root.rglob("*") if not p.name.startswith(".")} if root.exists() else set()


def test_a_block_removes_what_it_wrote_and_nothing_else(spark):
    kept = session.write_and_read(spark.range(2).toDF("n"), "kept")
    before = written(spark)
    with session.Intermediates(spark) as block:
        df = session.write_and_read(spark.range(3).toDF("n"), "inner")
        with session.Intermediates(spark):
            session.write_and_read(spark.range(4).toDF("n"), "innermost")
            assert len(written(spark)) > len(before)
        assert rows(df) == [(0,), (1,), (2,)]
    assert written(spark) == before and not pathlib.Path(block.folder).exists()
    assert rows(kept) == [(0,), (1,)]
    assert session.Intermediates.current() is None


def test_a_block_that_fails_is_cleared_and_a_foreign_file_stays(spark):
    before = written(spark)
    with pytest.raises(ZeroDivisionError), session.Intermediates(spark) as block:
        session.write_and_read(spark.range(3).toDF("n"), "inner")
        foreign = pathlib.Path(block.folder.removeprefix("file://")) / "foreign.txt"
        foreign.write_text("mine")
        raise ZeroDivisionError
    assert foreign.read_text() == "mine"
    assert written(spark) - before == {foreign, foreign.parent}


def test_jobs_within_a_block_leave_nothing(spark, sample):
    before = written(spark)
    with session.Intermediates(spark):
        fresh = CleanTables(sample.raw, store_items=True)
        found = rows(revenue.revenue_per_year(fresh)) + rows(revenue.revenue_per_seller(fresh, (1996,)))
        assert found and len(written(spark)) > len(before)
    assert written(spark) == before
