"""Session and shared-storage helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def _driver_memory(cap_gb: int = 16) -> str:
    """About 60% of physical memory, at most ``cap_gb`` (local mode: the
    driver JVM is the whole cluster)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        gb = max(1, min(cap_gb, int(total * 0.6 / 2**30)))
    except (ValueError, OSError, AttributeError):
        gb = 4
    return f"{gb}g"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "wearline") -> SparkSession:
    """Local/test session. On a cluster, build the session with the cluster's
    own settings instead; the library only reads what it needs from it."""
    master = master or os.environ.get("WEARLINE_MASTER", "local[*]")
    b = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # plans with hundreds of columns are built several times faster without
        # a recorded line of Python for each expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WEARLINE_DRIVER_MEMORY", _driver_memory()))
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(
        [root] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and p != root])
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


#: HotSpot never compiles a method of more bytecode than this.
HUGE_METHOD = 8000


def compiled_methods(spark: SparkSession) -> None:
    """Plans with dozens of columns make whole-stage methods that HotSpot only
    interprets; above its limit Spark is told to generate split code instead."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key, "65535")) > HUGE_METHOD:
        spark.conf.set(key, str(HUGE_METHOD))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Only when it is unset in a local run (tests) a
    folder of our own is set; on a cluster that is an error, since a folder of
    one machine is not seen by the others."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            d = tempfile.mkdtemp(prefix="wearline-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir()
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder, for tables
    written to cut lineage or to hand data between jobs."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/wearline-{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it a job's shuffle files go when the job ends, not when the driver
    happens to collect garbage: what was stored does not need them any more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextlib.contextmanager
def garbage_collected(spark: SparkSession, seconds: float = 15.0) -> Iterator[None]:
    """Within it the driver collects garbage every few seconds, so that Spark
    removes the shuffle files of finished steps. Training a forest shuffles the
    statistics of all nodes once a level; by default those files stay for up to
    half an hour (``spark.cleaner.periodicGC.interval``)."""
    done = threading.Event()

    def run() -> None:
        while not done.wait(seconds):
            spark._jvm.System.gc()
    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
        spark._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder, and read from there."""
    path = shared_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    _STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_over(df: DataFrame, name: str, last: str | None) -> tuple[DataFrame, str]:
    """``stored``, and its path; the table at ``last``, which ``df`` may read, is
    deleted once the new one is written."""
    out, path = stored(df, name), _STORED[-1]
    if last is not None:
        _STORED.remove(last)
        _delete(df.sparkSession, [last])
    return out, path


@contextlib.contextmanager
def stored_removed(spark: SparkSession) -> Iterator[None]:
    """At its end the tables that ``stored`` wrote within it are deleted, and the
    shuffle files of what read them; nothing may read them later."""
    before = len(_STORED)
    try:
        yield
    finally:
        gone = _STORED[before:]
        del _STORED[before:]
        _delete(spark, gone)
        spark._jvm.System.gc()


#: Paths given out by ``shared_path`` in this process.
_MADE: list[str] = []
#: Of them, the tables that ``stored`` wrote and nobody has deleted since.
_STORED: list[str] = []


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def remove_shared(spark: SparkSession) -> int:
    """Delete the tables that this process has put below the shared folder;
    results that still read them must be stored before. Returns how many there
    were."""
    paths = list(_MADE)
    _MADE.clear()
    _STORED.clear()
    return _delete(spark, paths)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``wearline`` importable in Python workers of this application
    (standard ``addPyFile`` of a zipped copy). Called before any operator
    that runs Python code in tasks."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    os.environ["PYTHONPATH"] = os.pathsep.join(
        [root] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and p != root])
    out = tempfile.mkdtemp(prefix="wearline-pkg-")
    zpath = shutil.make_archive(os.path.join(out, "wearline"), "zip", root, "wearline")
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
