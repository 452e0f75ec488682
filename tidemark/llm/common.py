"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a regular-expression class (space, tab to carriage return).
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a new one (tests)."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_to = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", set_to)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to


def saved(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: Column) -> Column:
    """The words of a text in order, as an array; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def folded(values: list[float]) -> str:
    """A SQL expression for an array of doubles; the optimizer folds it to one literal."""
    return "cast(split('" + ",".join(f"{v:.6g}" for v in values) + "', ',') as array<double>)"


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """As saved(), for wide rows: a compressed table in the shared folder, until forget()."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Removes what this application has written() and saved(), once the results that read it are stored."""
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    for folder in filter(None, (_tables(spark), spark.sparkContext.getCheckpointDir())):
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(hadoop).delete(at, True)
    spark.sparkContext.setCheckpointDir(shared_dir(spark))


#: Rows of whole texts that a batch between the JVM and Python holds at most.
TEXT_ROWS = 1000


def in_text_batches(df: DataFrame) -> DataFrame:
    """df; from now on the session hands rows to Python in batches of TEXT_ROWS at most, as both sides hold a whole batch."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df
