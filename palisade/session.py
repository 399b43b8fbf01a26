"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "palisade", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings these jobs are tuned for.

    The cluster's own settings (executors, memory, shuffle partitions,
    ``spark.checkpoint.dir``) are left to spark-submit unless passed in ``conf``.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Long texts travel to the scorer in Arrow batches; keep them small.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; on
    a cluster a machine-local folder would lose data, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    local = tempfile.mkdtemp(prefix="palisade-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers do not inherit the driver's import path, and unpickling the encoder
    needs the package.  Nothing is sent where it already runs from an archive
    given to spark-submit.
    """
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _shipped or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="palisade-")) / "palisade.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/palisade/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives executor loss, and gives the optimizer the true
    size of the result for its broadcast decision.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the session's own from the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_scratch(df: DataFrame) -> None:
    """Remove what :func:`materialise` wrote, when nothing reads it any more."""
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        remove_path(df.sparkSession, path)
