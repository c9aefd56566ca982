"""Loading, latest-wins upserts, deletes, snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first by the given order (upsert: the latest write wins)."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


#: Replaced rows that may be broadcast (16 bytes each).
MOST_REPLACED = 2_000_000
_REPLACED: dict[tuple, tuple[str, bool]] = {}


def table_state(spark: SparkSession, path: str) -> tuple:
    """What tells a stored table, as it is now, from every other in this application."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    return sc.applicationId, path, fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime()


def _stored(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, folder: str) -> bool:
    fs, at = _stored(spark, folder)
    return fs.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = _stored(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def make_folder(spark: SparkSession, folder: str) -> None:
    fs, at = _stored(spark, folder)
    fs.mkdirs(at)


def replaced_rows(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """((_f, _r) of the rows of a docs table that a later row of their id replaces, whether they may be broadcast).

    Only ids, times and the rows' places are read. The places are found once an
    application for a table as it is now (its size and time tell) and written to the shared folder.
    """
    key = table_state(spark, path)
    if key not in _REPLACED or not exists(spark, _REPLACED[key][0]):
        d = spark.read.parquet(path).where("id is not null")
        d = d.select("id", F.struct("crawled_at", "indexed_at", "quality_score", *_place()).alias("at"))
        best = d.groupBy("id").agg(F.max("at").alias("best"), F.count("*").alias("n")).where("n > 1").select("id", "best")
        gone = d.join(best, "id").where("at._f <> best._f or at._r <> best._r").select("at._f", "at._r")
        folder = shared_folder(spark)
        gone.write.parquet(folder)
        _REPLACED[key] = folder, spark.read.parquet(folder).count() <= MOST_REPLACED
    folder, small = _REPLACED[key]
    return spark.read.schema("_f bigint, _r bigint").parquet(folder), small


def _place() -> list[Column]:
    return [F.xxhash64("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r")]


def pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The latest row of each page; only the named columns are read.

    Rows that a later one replaces are left out where they are scanned, so that
    texts are in no shuffle and filters on top reach the scan. Only where more
    rows are replaced than may be broadcast do the places meet in a shuffle.
    """
    path = f"{sf_dir}/docs.parquet"
    gone, small = replaced_rows(spark, path)
    d = spark.read.parquet(path).where("id is not null")
    d = d.select(*dict.fromkeys(["id", *columns]), *_place())
    return d.join(F.broadcast(gone) if small else gone, ["_f", "_r"], "left_anti").drop("_f", "_r")


def numbered(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """Adds number, from 1, of each row within its group by the order, which tells all rows of a group apart.

    Numbers come from a range partitioning on (group, order), so that a group of
    any size spreads over tasks; what meets in a window is one row per group and task.
    """
    shared_checkpoints(rows.sparkSession)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = rows.repartitionByRange(tasks, *by, *order).sortWithinPartitions(*by, *order)
    x = x.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).checkpoint()
    runs = x.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*by, "_part", "_first", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    return x.join(runs, [*by, "_part"]).withColumn("number", F.col("_earlier") + F.col("_at") - F.col("_first") + 1).drop("_at", "_part", "_first", "_earlier")


def union_all(first: DataFrame, *rest: DataFrame, missing: bool = False) -> DataFrame:
    """Rows of all frames, columns by name.

    Spark 4.1 lets a union claim the partitioning of its children though adaptive
    execution has coalesced them apart, and a grouping or join on top then gives
    wrong rows; the claim is switched off for the session.
    """
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for x in rest:
        first = first.unionByName(x, allowMissingColumns=missing)
    return first


def upsert(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of current without those that updates replace, and the updates."""
    return union_all(current.join(updates.select(key), key, "left_anti"), updates, missing=True)


def delete(current: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return current.join(gone.select(key).distinct(), key, "left_anti")


def checked_vectors(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    """Fails on a vector of another dimension; empty and null ones are left out."""
    v = vectors.where(F.size(column) > 0)
    return v.where(F.when(F.size(column) == dim, F.lit(True)).otherwise(F.raise_error(F.lit(f"vector dimension is not {dim}")).cast("boolean")))


def snapshot(frames: dict[str, DataFrame], folder: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def restore(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    for n in names:
        if "/" in n or ".." in n:
            raise ValueError(f"not a table name: {n}")
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors see."""
    shared_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def shared_checkpoints(spark: SparkSession) -> None:
    """Uses the shared folder named in spark.checkpoint.dir; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
