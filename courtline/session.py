"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every courtline session wants: adaptive execution (runtime broadcast
# choice, skew-join splitting, partition coalescing), UTC session zone and no UI.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files are removed once no DataFrame refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Settings for a large cluster (about 1000 executors reading ~100 TB).  Shuffle
# partitions start high and adaptive execution coalesces them towards the
# advisory size, so no shuffle partition outgrows executor memory; scans split
# files into 512 MB tasks; skewed partitions above 5x the median (and 1 GB) are
# split by the skew-join rule; AQE may broadcast a side measured under 64 MB.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "32768",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "32768",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "courtline", extra: dict | None = None,
                  cluster: bool = False) -> SparkSession:
    """Create (or reuse) a SparkSession with courtline's defaults.

    On a cluster pass ``master=None`` and ``cluster=True`` and let spark-submit
    decide the rest; tests pass ``local[*]`` and a small shuffle partition count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(CLUSTER_CONF if cluster else {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _context(spark: SparkSession):
    """The SparkContext, or None where the session has none (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions raise here
        return None


_LOCAL_DIRS: dict[int, str] = {}  # private scratch folders of local sessions


def checkpoint_dir(spark: SparkSession, create_local_if_unset: bool = False) -> str | None:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared file system or
    object store).  Only local runs such as tests may get a private scratch
    folder when it is unset.  The SparkContext's checkpoint folder is set once
    (every ``setCheckpointDir`` call would start a new sub-folder).
    """
    sc = _context(spark)
    path = (spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc is not None else None)
            or _LOCAL_DIRS.get(id(spark)))
    if not path and create_local_if_unset:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = _LOCAL_DIRS.setdefault(id(spark), tempfile.mkdtemp(prefix="courtline-ckpt-"))
    if path and sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str, per_application: bool = True) -> str:
    """A sub-folder of the checkpoint folder for a materialised intermediate table.

    Intermediates go under the application id so concurrent jobs never share
    them; streaming checkpoints pass ``per_application=False`` so a restarted
    query finds its state again.
    """
    base = checkpoint_dir(spark, create_local_if_unset=True)
    if per_application:
        base = os.path.join(base, spark.conf.get("spark.app.id", "app"))
    return os.path.join(base, name)


def checkpointed(df):
    """``df`` computed once and written to the shared checkpoint folder.

    For small intermediates that a plan reads twice with different column
    needs (so Spark cannot reuse the exchange): without it both reads would
    rescan and re-aggregate the large input.  The lineage is cut at the
    written files, which also survive the loss of executors.
    """
    checkpoint_dir(df.sparkSession, create_local_if_unset=True)
    return df.checkpoint(eager=True)


def partitions_for(df, rows: int) -> int:
    """Partitions of at most about ``rows`` rows of ``df`` each, and no fewer than the cores.

    Counts ``df``; of a Parquet table that reads the files' footers only.
    """
    sc = _context(df.sparkSession)
    least = sc.defaultParallelism if sc is not None else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-df.count() // rows))


def ship_sources(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per Spark application.

    The sources go out as one small archive from the driver, so the package need
    not be installed on, or on the Python path of, every machine.
    """
    context = spark.sparkContext
    if getattr(context, "_courtline_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="courtline-")), "courtline-sources.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    context._courtline_shipped = True
