"""Session helpers: one place for the configs every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Settings that matter at any scale: AQE re-plans shuffles at runtime
# (coalesces small partitions, splits skewed join partitions), the UI
# stays off (no server), and timestamps are pinned to UTC.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # A table bucketed by page_id / doc_id is landed for its partitioning:
    # keep the bucketed scan even where Spark would judge it unneeded.
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The driver keeps a status record (with the plan text) of every job and
    # SQL execution; pipelines run many, so keep only recent ones.
    "spark.sql.ui.retainedExecutions": "50",
    "spark.ui.retainedJobs": "200",
    "spark.ui.retainedStages": "200",
    "spark.ui.retainedTasks": "20000",
    # Large pages become large rows; let a file split carry several.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "calyx",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the library's defaults.

    ``master`` is only set when given: on a cluster the launcher decides.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for staged tables.

    Read from ``spark.checkpoint.dir`` (the cluster names it). A local session
    without the setting gets a scratch folder; on a cluster that would be a
    folder of one machine only, so there it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        d = tempfile.mkdtemp(prefix="calyx-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_batches(spark: SparkSession, size: int) -> None:
    """Arrow batches of at most ``size`` bytes (a row at least), where the session doesn't set it: Spark's own limit
    counts rows only, and 10,000 pages can be any size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(size))


# Bytes of stored (compressed) pages or documents per task: a page's token
# rows take many times the space, and several sorts hold them.
CLUSTER_TARGET_BYTES = 16 * 1024 * 1024


def is_clustered_by(df, key: str) -> bool:
    """True when ``df`` is already hash-partitioned on ``key`` alone (for
    example a table bucketed by ``key``), so per-key windows need no shuffle."""
    part = df._jdf.queryExecution().executedPlan().outputPartitioning()
    if part.getClass().getSimpleName() != "HashPartitioning":
        return False
    exprs = part.expressions()
    return exprs.size() == 1 and exprs.apply(0).toString().split("#", 1)[0] == key


def clustered_partitions(df) -> int:
    """Tasks for per-page work on ``df``: by its bytes where they are known,
    and the session's shuffle partitions at least."""
    n = shuffle_partitions(df.sparkSession)
    size = scan_bytes(df)
    return n if size is None else max(n, -(-size // CLUSTER_TARGET_BYTES))


def cluster_by(df, key: str, partitions: int | None = None):
    """Hash-partition ``df`` on ``key`` once, unless it already is.

    The count is explicit (AQE must not coalesce: the rows grow after this
    exchange) and follows the input.
    """
    if is_clustered_by(df, key):
        return df
    return df.repartition(partitions or clustered_partitions(df), key)


def spread(df, key: str, text: str):
    """A written table dealt over tasks by ``key`` for a pass over its column ``text``: a task for each
    ``CLUSTER_TARGET_BYTES`` of it as it is in memory, and the shuffle partitions at least.

    A table read back has a task for each of its files at most, and few files where what wrote it read few: pages that
    are alike are small as files, whatever a pass over them takes.
    """
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(max(shuffle_partitions(df.sparkSession), -(-size // CLUSTER_TARGET_BYTES)), key)


def scan_bytes(df, plain: bool = False) -> int | None:
    """Bytes of the files when ``df`` is a file scan under projections and
    filters only (``plain``: under projections only); None otherwise.
    Estimates through joins or in-memory data are not sizes."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.getClass().getSimpleName() in (("Project",) if plain else ("Project", "Filter")):
        node = node.child()
    if node.getClass().getSimpleName() != "LogicalRelation":
        return None
    size = int(str(node.stats().sizeInBytes()))
    return size if size < (1 << 62) else None
