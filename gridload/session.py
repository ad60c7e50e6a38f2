"""Session settings and the shared working folder.

The library never builds a session inside an operator: callers pass one.
``build_session`` is for tests, the bench and command-line runs.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the engine relies on. AQE re-plans joins from runtime sizes, splits
# skewed shuffle partitions and coalesces tiny ones; UTC keeps instants stable.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Static settings, applied when the session is created. PySpark's DataFrame
# debugging context records the Python call site of every API call in the JVM
# (several round trips each); jobs that build plans in code do not need it.
STATIC_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "gridload", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in {**STATIC_CONF, **ENGINE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for key, value in ENGINE_CONF.items():
        spark.conf.set(key, value)
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def is_local(spark: SparkSession) -> bool:
    """One JVM does all the work (``local``, ``local[n]``), so a folder of this
    machine is reachable by every task."""
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and is read here. Only in local
    mode, and only when it is unset, is a folder of this machine used (one per
    application; the caller's checkpoint folder is left as it is). Elsewhere
    an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="gridload-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def job_description(spark: SparkSession, text: str):
    """Label the Spark jobs started inside the block (event log, cluster UI)."""
    sc = spark.sparkContext
    previous = sc.getLocalProperty("spark.job.description")
    sc.setJobDescription(text)
    try:
        yield
    finally:
        sc.setJobDescription(previous)
