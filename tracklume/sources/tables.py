"""Reading and writing tables: declared schemas, provenance columns, and stored intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklume.functions.scalars import nan_to_null

_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for stored intermediates: the one the cluster names or the session's checkpoint folder, or a fresh local one where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_later = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_later.isDefined():
        return set_later.get().rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        _FOLDERS[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _FOLDERS[app]


def new_location(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, keeps pruning and pushdown."""
    path = new_location(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def state_of(df: DataFrame) -> tuple:
    """Names, lengths and times of the files of a table: changes when the table is written anew."""
    spark, found = df.sparkSession, []
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((file, status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def read_observations(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    """Scan a table with a declared schema, by ``kind``: header ``csv`` with NaN turned into NULL, or ``parquet``.  A folder of files is fine.

    Parquet tables are expected to be clean (see :func:`stored_observations`), so that filters on measures reach the scan.
    """
    if kind == "csv":
        return nan_to_null(spark.read.schema(schema).option("header", True).csv(path))
    return spark.read.schema(schema).parquet(path)


def stored_observations(df: DataFrame, path: str) -> None:
    """Write observations as parquet with missing measures as NULL."""
    nan_to_null(df).write.parquet(path)


def write_csv(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Header CSV; with ``partition`` one directory per value of those columns, whatever values there are."""
    df.write.option("header", True).mode("overwrite").partitionBy(*partition).csv(path)


def write_runs(df: DataFrame, path: str, partition: str) -> None:
    """Store result rows of many runs as one dataset partitioned by the run.

    Rows are spread by (run, all columns' hash bucket) first so that a run with very many rows is written by several
    tasks and a small run by few.
    """
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    df.repartition(F.col(partition), spread).write.mode("overwrite").partitionBy(partition).parquet(path)


def read_recursive_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan every CSV below ``path`` and add the name of the directory each row came from."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(path)
        .withColumn("dir", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    )


def filename_fields(df: DataFrame, name: str, separator: str = "_", suffix: int = 4) -> DataFrame:
    """Facts kept in a file name: first field (date), second field (label, if a number), name without extension."""
    fields = F.split(F.col(name), f"[{separator}]")
    return df.select(
        "*",
        F.element_at(fields, 1).alias("date"),
        F.try_element_at(fields, F.lit(2)).try_cast("int").alias("serum"),
        F.substring(F.col(name), F.lit(1), F.length(name) - suffix).alias("file"),
    )


def rename_canonical(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def labelled(df: DataFrame, **values: Column | str | int | float) -> DataFrame:
    """Tag rows with constant columns (configuration, version, label)."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})
