"""Session set-up and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "classtilt", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CLASSTILT_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the cluster names in ``spark.checkpoint.dir``.

    Without that setting a temporary folder is made in local mode, where all tasks run on this machine; on a cluster that
    would lose data, so it is an error there.
    """

    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder at once and drop its lineage.

    Spark removes the files when the DataFrame is no longer referenced if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, as it is in :func:`local_session`.
    """

    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
