"""A table store of parts: every write adds a folder of tables, a pointer names the parts that count."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def parts(spark: SparkSession, root: str) -> list[str]:
    """Names of the parts that count, oldest first; none for a store that was never written."""
    fs, p = _fs(spark, f"{root}/{POINTER}")
    return [r[0] for r in spark.read.text(f"{root}/{POINTER}").collect() if r[0]] if fs.exists(p) else []  # one line a part


def write_part(spark: SparkSession, root: str, tables: dict[str, DataFrame], replace: bool = False) -> str:
    """Write tables as a part and make the pointer name it, after the others or instead of them.

    The pointer is replaced by one rename over the old file, which is atomic on file systems with an atomic rename
    (HDFS, local disks): readers see the old parts or the new ones. Object stores without it need one writer at a time.
    """
    name, before = uuid.uuid4().hex, [] if replace else parts(spark, root)
    for table, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{root}/{name}/{table}")
    fs, new = _fs(spark, f"{root}/{POINTER}.{name}")
    out = fs.create(new, True)
    out.write(bytearray("\n".join([*before, name]).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}"), options)
    return name


def read_parts(spark: SparkSession, root: str, *tables: str) -> dict[str, DataFrame]:
    """The named tables, the rows of all parts together."""
    names = parts(spark, root)
    return {t: spark.read.parquet(*[f"{root}/{n}/{t}" for n in names]) for t in tables}


def drop_all(spark: SparkSession, root: str) -> None:
    """Delete every part below root."""
    fs, p = _fs(spark, root)
    fs.delete(p, True)
