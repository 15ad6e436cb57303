"""Session construction and the checkpoint folder.

The library never hard-codes cluster sizing: `build_session` is for tests, the
bench and local runs. On a cluster the session comes from the platform and only
`ensure_checkpoint_dir` is used, which reads `spark.checkpoint.dir` from the
session and sets a private folder only when none is configured (local runs).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every plan in this package is written against.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # files of checkpoints that no result refers to any more are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    master: str = "local[*]",
    shuffle_partitions: int = 8,
    app: str = "quarry",
    extra: dict | None = None,
) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only if none is configured.

    A cluster names a shared folder in `spark.checkpoint.dir`; that is used as is.
    Only when the setting is absent on a local master (tests, local runs) is a
    fresh local folder made; on a cluster a missing setting is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: name a folder shared by all executors "
                "(a machine-local folder does not survive a lost executor)"
            )
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()
