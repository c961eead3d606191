"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job relies on: AQE (runtime coalescing and skew-join
# splitting), UTC session time, Arrow transfer for the pandas hooks and no UI.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def scale_conf(shuffle_bytes: int, cores: int, *, target_partition_bytes: int = 256 << 20) -> dict:
    """Shuffle and scan sizing for a cluster run.

    About ``target_partition_bytes`` of shuffle data per reduce task (so a task
    fits executor memory without heavy spilling), at least three waves over
    ``cores``; AQE then coalesces small partitions and splits skewed ones at run time.
    """
    n = max(cores * 3, -(-shuffle_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes // 2),
    }


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "pairlab", conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of a session (once per context).

    The same as ``--py-files`` at submission: Arrow functions are pickled by
    reference, so a worker must be able to import the package.
    """
    sc = spark.sparkContext
    if getattr(sc, "_pairlab_shipped", False):
        return spark
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="pairlab-ship-")) / "pairlab.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(archive))
    sc._pairlab_shipped = True
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``.

    Where a session names none, a folder below its warehouse (which is shared as
    well) is set as the context's checkpoint folder and used.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/pairlab-scratch")
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def materialize(df, name: str = "table", by: Sequence[str] = (), **options):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    return the re-read table: one job, and the lineage is cut at the files
    (a reliable cut that survives executor loss; never a local checkpoint).
    ``by`` names columns whose values get folders of their own, ``options`` are those of the writer."""
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/materialized/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).partitionBy(*by).parquet(path)
    return spark.read.parquet(path)
