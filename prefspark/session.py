"""Session helpers: building a session for tests/bench and locating shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "prefspark",
                  driver_memory: str = "8g") -> SparkSession:
    """Session for tests and the bench. On a cluster, use the cluster's own session instead."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # batch sessions run hundreds of short jobs: keep the status store (kept even without the UI) small
        .config("spark.ui.retainedJobs", "100")
        .config("spark.ui.retainedStages", "200")
        .config("spark.ui.retainedTasks", "10000")
        .config("spark.sql.ui.retainedExecutions", "50")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )


def _context(spark: SparkSession):
    """The SparkContext, or None where the session has none (e.g. a remote session)."""
    try:
        return spark.sparkContext
    except Exception:
        return None


def default_parallelism(spark: SparkSession) -> int:
    """Cores available to the job (falls back to the shuffle partition count)."""
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder used for checkpoints and scratch tables.

    Reads ``spark.checkpoint.dir`` (or the directory already set on the context). Only when
    neither is set *and* the master is local (tests) a private temporary folder is created;
    on a cluster a machine-local folder would be lost with its executor, so we refuse.
    """
    sc = _context(spark)
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if sc is not None:
            sc.setCheckpointDir(conf_dir)
            return sc.getCheckpointDir() or conf_dir
        return conf_dir
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if master.startswith("local"):
        local_dir = tempfile.mkdtemp(prefix="prefspark-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(local_dir)
            return sc.getCheckpointDir() or local_dir
        return local_dir
    raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder for intermediate tables."""
    root = checkpoint_root(spark)
    return os.path.join(root, "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (``addPyFile``), once per context.

    Partition-wise Python (``mapInPandas``) unpickles backend factories by module name, so the
    workers need the package even when only the driver has it on its path (``--py-files`` does the
    same for jobs submitted with it).
    """
    sc = _context(spark)
    if sc is None:
        return
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    archive = os.path.join(tempfile.mkdtemp(prefix="prefspark-py-"), "prefspark.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(archive)
    _SHIPPED.add(key)
