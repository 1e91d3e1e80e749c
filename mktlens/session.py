"""Session helpers.

Library code never builds its own session: every operator takes the caller's
``SparkSession`` (or a DataFrame). ``local_session`` exists for tests and the
bench; it pins the settings the oracle comparison relies on (UTC, AQE on).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale; applied by ``local_session`` and documented in
# the README for cluster deployments.
SCALE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE turns a sort-merge join into a broadcast join only when the runtime
    # size of a side is below this bound: the size check behind every broadcast.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "mktlens") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator of the cluster sets it to a shared file system;
    in local mode a fresh scratch folder is taken when it is unset, elsewhere that is an error. The
    context's checkpoint directory is set once, from that setting.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.conf.get("spark.master", "local")
        if not master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="mktlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session manages its own checkpoint folder
        return current
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def materialize_dimension(df):
    """Cut the lineage of a small derived dimension (category forest, scope table) with a reliable checkpoint.

    The checkpoint lives in the shared folder named by ``spark.checkpoint.dir``,
    so it survives executor loss; later references scan a few rows instead of
    re-deriving the dimension at every join of a plan. Joins against it are
    sized at run time by AQE: broadcast below
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``, shuffle join above.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """Write a derived table of any size to the shared folder as Parquet and read it back.

    For rows that several branches of a plan read: they are worked out once, and each branch scans the columns it needs.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/mktlens/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
