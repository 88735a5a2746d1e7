"""Session helpers: a local session for tests and benches, and the shared scratch folder.

The library itself never builds a session; callers pass theirs in.  Scratch files (text
written by the round-trip queries, checkpoints) go under the folder the cluster names in
``spark.checkpoint.dir``.  Only a local session without that setting gets a private temporary
folder, so tests and benches run anywhere while a cluster job never writes to a machine-local
path.
"""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def _held() -> list:
    """What the open ``released`` blocks have sent or written, innermost last.  Kept beside the package,
    whose modules are pickled by value into task functions."""
    store = sys.modules.setdefault("_proxima_held", types.ModuleType("_proxima_held")).__dict__
    return store.setdefault("blocks", [])


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "proxima",
                  event_log_dir: str | None = None) -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "6g")
    )
    if event_log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_root(spark)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (or the checkpoint folder already set on the
    context).  When neither is set and the session is local (tests, benches), a private temporary
    folder is created and set; on a cluster an unset value is an error, because a machine-local
    folder is not visible to other executors.
    """
    sc = spark.sparkContext
    root = sc.getConf().get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not root:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; set it to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="proxima-scratch-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the shared scratch folder."""
    root = scratch_root(spark)
    sep = "" if root.endswith("/") else "/"
    return f"{root}{sep}{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through Spark's own file system client."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


@contextlib.contextmanager
def released():
    """Frees, at its end, the broadcasts and scratch tables made inside it.

    Results are lazy, so run the action inside the block too:
    ``with released(): knn_classify(train, test, 5).write.parquet(path)``.
    """
    held: list = []
    _held().append(held)
    try:
        yield
    finally:
        _held().remove(held)
        for free in reversed(held):
            free()


def on_release(free) -> None:
    """Call ``free`` at the end of the enclosing ``released`` block, if there is one."""
    if _held():
        _held()[-1].append(free)


def send(spark: SparkSession, value):
    """A broadcast variable; destroyed at the end of the enclosing ``released`` block."""
    out = spark.sparkContext.broadcast(value)
    on_release(out.destroy)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    The rows are computed a single time, the lineage is cut, and a lost executor costs nothing.
    The folder is deleted at the end of the enclosing ``released`` block.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    on_release(lambda: delete_path(spark, path))
    return spark.read.schema(df.schema).parquet(path)
