"""Session defaults and the shared folder for materialised tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # delete checkpoint files (NTILE / RANK ranges, CSV staging) once their DataFrame is gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "marginscope") -> SparkSession:
    """Build (or reuse) a session with the settings every module assumes.

    On a cluster, master, memory and ``spark.checkpoint.dir`` come from the
    cluster config; only unset values get a local default here.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # Spark Connect
        pass
    ensure_checkpoint_dir(spark)
    return spark


def app_id(spark: SparkSession) -> str:
    """Application id (classic sessions) or the session id (Spark Connect)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # Spark Connect: no SparkContext on the client
        return spark.conf.get("spark.app.id", None) or getattr(spark, "session_id", "session")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a local one only if none is configured.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is. A local folder is only created for a local master (tests, a
    laptop); a cluster without a shared folder is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if not conf:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on the server")
        return conf.rstrip("/") + "/" + app_id(spark)
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="marginscope-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the session's (shared) checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return "/".join([root.rstrip("/"), *parts])


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Cheap identity of input files (path, size, modification time), asked of the store they are in.

    Where the store cannot be asked (Spark Connect, a missing path) the answer
    is new each time, so nothing derived is reused.
    """
    import hashlib
    import uuid

    h = hashlib.sha1()
    try:
        jvm = spark._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in sorted(paths):
            path = jvm.org.apache.hadoop.fs.Path(p)
            for f in path.getFileSystem(conf).listStatus(path):
                h.update(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()};".encode())
    except Exception:  # noqa: BLE001  any store's error means the same here
        h.update(uuid.uuid4().bytes)
    return h.hexdigest()[:16]


def parallelism(spark: SparkSession) -> int:
    """Tasks that run at once, or as many as Spark Connect's server is asked for."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # Spark Connect: no SparkContext on the client
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def size_shuffles(spark: SparkSession, rows: int, rows_per_partition: int = 500_000) -> None:
    """Raise the number of shuffle partitions to fit a table of ``rows``; adaptive execution merges small ones."""
    now = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    need = -(-rows // rows_per_partition)
    if need > now:
        spark.conf.set("spark.sql.shuffle.partitions", str(need))
