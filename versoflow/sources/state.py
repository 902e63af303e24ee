"""Saved state: segments, checkpoints, glossaries, modes, cache entries; JSON as found elsewhere, Parquet of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoflow import schemas
from versoflow.functions.text import is_blank

DEFAULT_MODE = ("default", "Default", "You are a careful translator", "plain", "medium")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Rows of a JSON array or of JSON lines; None if there is no file or any of it is not valid."""
    if not exists(spark, path):
        return None
    checked = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    # the files are small state, read once to decide between the file and parsing anew
    if checked.cache().where("_corrupt_record is not null").limit(1).count():
        checked.unpersist()
        return None
    return checked.drop("_corrupt_record")


def read_segments(spark: SparkSession, path: str, doc_id: int) -> DataFrame | None:
    """Segments saved as JSON, with the defaults of fields that are missing; None if they must be parsed anew."""
    rows = read_json(spark, path, schemas.SEGMENTS)
    return None if rows is None else rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(doc_id))).fillna(schemas.SEGMENT_DEFAULTS)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The checkpoint at a path, or an empty one."""
    rows = read_json(spark, path, schemas.CHECKPOINT)
    return spark.createDataFrame([], schemas.CHECKPOINT) if rows is None else rows


def read_glossary(spark: SparkSession, merged_path: str, path: str) -> DataFrame | None:
    """The merged glossary if there is one, else the plain one, else None."""
    for p in (merged_path, path):
        if (rows := read_json(spark, p, "term string, translation string")) is not None:
            return rows
    return None


def read_modes(spark: SparkSession, path: str) -> DataFrame:
    """Valid modes of a file (an id, a name and a role each); the default mode if there is none."""
    rows = read_json(spark, path, schemas.MODES)
    return valid_modes(spark.createDataFrame([], schemas.MODES) if rows is None else rows)


def valid_modes(modes: DataFrame) -> DataFrame:
    spark = modes.sparkSession
    names = [c.split(" ")[0] for c in schemas.MODES.split(", ")]
    valid = modes.where(~is_blank("mode_id") & ~is_blank("name") & ~is_blank("role_desc")).select(*names, F.lit(0).alias("r"))
    both = valid.unionByName(spark.createDataFrame([(*DEFAULT_MODE, 1)], schemas.MODES + ", r int"))
    first = both.agg(F.min("r").alias("least"))
    return both.crossJoin(F.broadcast(first)).where("r = least").drop("r", "least")  # one row


def choose_mode(modes: DataFrame, *wanted: str | None) -> DataFrame:
    """The mode of the first wanted id that exists, else the first by id: one row."""
    rank = F.lit(len(wanted))
    for k in range(len(wanted) - 1, -1, -1):
        if wanted[k]:
            rank = F.when(F.col("mode_id") == wanted[k], k).otherwise(rank)
    return modes.withColumn("__r", rank).orderBy("__r", "mode_id").limit(1).drop("__r")


def fingerprint(spark: SparkSession, path: str) -> str:
    """Hash of the contents of the files at a path."""
    files = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h"))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h")).first()["h"]


def save(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace the state at a path; the commit is atomic as far as the file system's rename is."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def reset(spark: SparkSession, path: str) -> bool:
    """Delete the state at a path; whether there was any."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def recovered_context(spark: SparkSession, path: str, most: int = 2000) -> str:
    """The last characters of a rendered file; empty if there is none. Only the ends of its last lines are brought here."""
    if not exists(spark, path):
        return ""
    lines = spark.read.text(path).select(F.right("value", F.lit(most)).alias("value")).tail(most)
    return "\n".join(r.value for r in lines)[-most:]
