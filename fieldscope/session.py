"""Session settings the operators rely on.

``configure(spark)`` sets the runtime SQL confs on any session (including one
handed to us by a driver); ``local_session`` builds a test session.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL confs. All can be changed on a live session.
RUNTIME_CONFS = {
    # The document walk is a recursive CTE: one iteration per nesting level,
    # row count grows with the corpus, so the default 1M row cap must go.
    "spark.sql.cteRecursionRowLimit": "-1",
    # Python's json keeps the last duplicate key; Variant fails without this.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Maps built from name lists keep the last duplicate, like a Python dict.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Beyond 8,000 bytes of bytecode the JVM interprets a method: split such stages by operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Variant walking costs CPU per row, not bytes: keep small shuffles spread
    # over many tasks instead of coalescing them into one or two.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``fieldscope`` importable by the Python workers (the Arrow UDFs
    and grouped functions live in it): zip the package once per application
    into the shared checkpoint folder and ``addPyFile`` it."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    target_dir = checkpoint_dir(spark).rstrip("/")
    local_dir = target_dir[len("file:"):] if target_dir.startswith("file:") else target_dir
    if "://" in local_dir:  # a remote shared folder: stage the zip locally, Spark ships it
        local_dir = tempfile.mkdtemp(prefix="fieldscope-pkg-")
    os.makedirs(local_dir, exist_ok=True)
    zpath = os.path.join(local_dir, f"fieldscope-{app}.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def configure(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_CONFS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's ``spark.checkpoint.dir``.

    Only a session that runs in one process (``local[n]``, as in tests) gets
    one of our own where the setting is missing; on a cluster a machine-local
    folder would lose files, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="fieldscope-ckpt-", dir=os.environ.get("FIELDSCOPE_TMP", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def materialize(df):
    """Compute ``df`` once as a Parquet table in the shared checkpoint folder
    and read it back: the lineage is cut, several consumers read the same
    files, and a lost executor cannot lose them (one write, no recompute)."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/fieldscope-tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "fieldscope") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("FIELDSCOPE_DRIVER_MEMORY", "16g"))
    )
    for k, v in RUNTIME_CONFS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
