"""SparkSession construction, the bound on Arrow batches and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "ordersight",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session tuned for the analytics in this package.

    On a cluster the master, partitions and checkpoint folder come from the
    cluster config; locally (tests, bench) we fill in sane defaults.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Broadcast decisions are size-checked at runtime by AQE; anything
        # bigger than this falls back to a shuffle join.
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        # Without column statistics a filtered month of orders is estimated at
        # full-table size; let it still build the (size-capped) bloom filter.
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
        "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": str(256 * 1024 * 1024),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of an Arrow batch to Python at most: the tasks of an executor hold a few of them each as text and objects.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_BYTES`` (a lower one stays); narrow rows don't notice."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read ``spark.checkpoint.dir`` from the session; only when it is unset
    (local runs, tests) create a scratch folder for it.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:  # set already: setting it again would make a folder inside it
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            # A machine-local folder would not survive losing that machine.
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        d = tempfile.mkdtemp(prefix="ordersight-ckpt-", dir=os.environ.get("ORDERSIGHT_SCRATCH", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d
