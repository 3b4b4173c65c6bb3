"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the jobs count on. Broadcasts are left to Spark's own size checks
# (autoBroadcastJoinThreshold at plan time, AQE with measured sizes at run time).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # One more shuffle is cheaper than one task that holds a third of the rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

SHARED_MOUNT = "feira.sharedMount"


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(master: str = "local[*]", app: str = "feira", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the one you are given."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def _on_one_machine(master: str) -> bool:
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def _is_local_path(path: str) -> bool:
    return path.startswith("file:") or "://" not in path


# What went wrong when a folder was tried, if anything; their names hold the application's id.
_tried: dict[str, str] = {}


def _lost(spark: SparkSession, folder: str) -> str:
    """Why rows that all executors write to the folder are not there for the driver and other tasks to read; empty if they are."""
    path = f"{folder}/tried-{uuid.uuid4().hex}"
    try:
        n = 2 * spark.sparkContext.defaultParallelism
        spark.range(0, n, 1, n).write.parquet(path)
        found = spark.read.schema("id long").parquet(path).count()
        return "" if found == n else f"{found} of {n} rows written by executors came back"
    except Exception as e:  # a folder that cannot be written or listed is no shared one, whatever the reason
        return f"{type(e).__name__}: {str(e)[:300]}"


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: as named by ``spark.checkpoint.dir``, or else in the warehouse.

    Without that setting a temporary folder serves a driver that has no other machine, and nothing else. On a
    cluster the warehouse takes its place, as it holds the tables that executors write. There a local path must be
    the same mount everywhere: ``feira.sharedMount`` says so, or else it is tried once, and refused where what
    executors write does not come back.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None and _on_one_machine(context.master):
        root = tempfile.mkdtemp(prefix="feira-")
        context.setCheckpointDir(root)
    refused = []
    for place in (root, spark.conf.get("spark.sql.warehouse.dir", None)):
        if place is None:
            continue
        folder = f"{place.rstrip('/')}/feira-{context.applicationId}"
        if context.master.startswith("local") or not _is_local_path(place) or spark.conf.get(SHARED_MOUNT, "false") == "true":
            return folder
        if folder not in _tried:
            _tried[folder] = _lost(spark, folder)
        if not _tried[folder]:
            return folder
        refused.append(f"{place} is a local path that executors on other machines cannot see ({_tried[folder]})")
    raise ValueError("; ".join(["set spark.checkpoint.dir to a folder that all executors share", *refused]))


class Intermediates:
    """The tables written by ``write_and_read`` inside a ``with`` block; they are removed when it ends.

    >>> with Intermediates(spark):
    ...     revenue.revenue_per_seller(tables).write.parquet(out)

    Results must be written or collected within the block. After a failure, too, what the block wrote is
    removed, and nothing else; its folder goes with it if nobody else has put a file there. Blocks
    may be nested: a table belongs to the innermost one of the thread that writes it.
    """

    _open = threading.local()

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", []

    @classmethod
    def current(cls) -> Intermediates | None:
        stack = getattr(cls._open, "stack", [])
        return stack[-1] if stack else None

    def __enter__(self) -> Intermediates:
        if not hasattr(self._open, "stack"):
            self._open.stack = []
        self._open.stack.append(self)
        return self

    def __exit__(self, *failure) -> None:
        self._open.stack.remove(self)
        self.release()

    def release(self) -> None:
        """Remove the tables through the file system that holds them."""
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        while self.paths:
            files.delete(jvm.org.apache.hadoop.fs.Path(self.paths.pop()), True)
        folder = jvm.org.apache.hadoop.fs.Path(self.folder)
        if files.exists(folder) and not files.listStatus(folder):
            files.delete(folder, False)


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage with a table that outlives any executor, and gives later joins true sizes. Within an
    ``Intermediates`` block the table is removed at its end, otherwise it stays.
    """
    spark, owner = df.sparkSession, Intermediates.current()
    path = f"{owner.folder if owner else shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if owner:
        owner.paths.append(path)  # first, so that a half-written table goes as well
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
