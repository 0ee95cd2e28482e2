"""Tables written once and read by all that follows, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made for local sessions without a setting, by application.
_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which all executors share; on a plain local master without one, a temporary folder."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if place:
        return place
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="groundloom-")
    return _OWN[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """df as a written table: its plan is run once, lineage ends here, and a lost executor costs no recomputation. file_rows: the most rows of a file."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_groups(df: DataFrame, most: int) -> list[list[str]]:
    """The files of a written table in order, in groups of about `most` bytes: one file at least."""
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct().orderBy("file_path").collect()  # a row a file
    groups, size = [[]], 0
    for f in files:
        if groups[-1] and size + f.file_size > most:
            groups.append([])
            size = 0
        groups[-1].append(f.file_path)
        size += f.file_size
    return groups


def staged_pair(left: DataFrame, right: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Two tables of as many columns, alike in types, written as one; rows of a side lie in files of their own."""
    marked = [df.toDF(*left.columns).withColumn("__right", F.lit(x)) for df, x in ((left, False), (right, True))]
    both = staged(marked[0].unionByName(marked[1]), name)
    sides = (both.where(F.col("__right") == F.lit(x)).drop("__right") for x in (False, True))
    return next(sides), next(sides).toDF(*right.columns)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that no later plan reads."""
    for df in tables:
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(conf).delete(path, True)
