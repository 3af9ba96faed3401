"""Session building and durable intermediate tables."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "quillspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; conf entries use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (ENGINE_CONF | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only where the setting is absent (tests, a laptop) a temporary folder of this machine is used, and only by a
    session whose executors are on this machine.
    """
    scala_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if scala_dir.isDefined():
        return scala_dir.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_staged: dict[str, list[str]] = {}


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read instead of a recomputation; unlike a
    checkpoint the table is compressed and its columns can be pruned. clear_staged() deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, column: str, label: str) -> str:
    """Write df in the shared folder as a Parquet table with a folder for each value of column, which tasks may read by themselves; its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    return path


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more, and let go of the shuffles of what has ended: their files stay until the driver
    collects its garbage, which a long job of few objects may never do by itself."""
    spark = df.sparkSession
    jvm, known = spark.sparkContext._jvm, _staged.get(spark.sparkContext.applicationId, [])
    names = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in df.inputFiles()}
    for path in [p for p in known if p.rsplit("/", 1)[1] in names]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        known.remove(path)
    gc.collect()
    jvm.System.gc()


def clear_staged(spark: SparkSession) -> None:
    """Delete all staged tables of this application; results that still read them must be written before."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in _staged.pop(spark.sparkContext.applicationId, []):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers of all executors, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        home = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='quillspark-')}/quillspark", "zip", home.parent, home.name)
        spark.sparkContext.addPyFile(archive)
