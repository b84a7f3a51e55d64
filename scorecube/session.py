"""Session helpers: a local session for tests/bench, and the shared folder for materialised tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of this library wants. On a cluster these come from the job config; here they are
# applied only when building a local session (tests, bench).
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "scorecube") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SCORECUBE_DRIVER_MEMORY", "16g"))
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for checkpoints and materialised tables.

    Read from the session (``spark.checkpoint.dir`` / the context's checkpoint dir). Only when neither is set
    (local tests) a fresh folder is created and registered.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not d:
            d = tempfile.mkdtemp(prefix="scorecube-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d.rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence of a Hadoop-FS path (any scheme the cluster knows)."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


ROWS_PER_TASK = 500_000
#: up to this many tasks a shuffle's map side writes rows straight to a file for each of them (spark.shuffle.sort.bypassMergeThreshold);
#: beyond, it gathers the rows of a whole input split in memory first
DIRECT_TASKS = 200
MOST_ROWS_PER_TASK = 4 * ROWS_PER_TASK
#: for tables whose rows are read to be worked on: a reader's task takes files by their bytes (and 4 MB for each file), and rows that
#: compress to a few bytes would otherwise make few tasks of tens of millions
ROWS_PER_FILE = 200_000


def task_count(rows: int) -> int:
    """Tasks to deal ``rows`` to. A number of its own keeps a task's memory bounded as tables grow: adaptive coalescing goes by
    compressed bytes, and cells compress to a few bytes a row. From ``DIRECT_TASKS`` on a task first takes more rows, up to
    ``MOST_ROWS_PER_TASK``."""
    tasks = max(1, -(-rows // ROWS_PER_TASK))
    return tasks if tasks <= DIRECT_TASKS else max(DIRECT_TASKS, -(-rows // MOST_ROWS_PER_TASK))


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared folder."""
    return f"{shared_dir(spark)}/scorecube/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``scorecube`` importable by Python workers (what ``--py-files`` does for a submitted job).

    The package is zipped in memory, written through the Hadoop FileSystem API into the shared folder and added
    from there. Needed only by the stages that run Python on executors (archive unpack, fixture writer)."""
    import io
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    target = f"{new_table_path(spark, 'pyfiles')}/scorecube.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
