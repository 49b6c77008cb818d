"""Helpers that several operators share."""

from __future__ import annotations

import string
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts.
WHITE = r"[\x20\x09-\x0D]+"
#: A word: a longest run of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of this machine only where none is set and Spark runs on it alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


#: Where the rows of frames made by ``cut`` lie.
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """The same rows, computed now, written as Parquet to the shared folder and read from there, with their lineage cut.

    The files go when the driver ends; those of ``instead_of``, an earlier result of ``cut`` that nothing else reads, go
    as soon as the new ones are written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = files.getFileSystem(spark._jsc.hadoopConfiguration())
    store.deleteOnExit(files)
    old = _written.pop(instead_of, None) if instead_of is not None else None
    if old:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """A text, a null one as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. ``text`` is read three times, so it should be a column of its own."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def no_white(text: Column) -> Column:
    """The text without the characters of ``WHITE``; at one match a word, cheaper than a regular expression."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def split_words(text: Column, between: str) -> Column:
    """The non-empty parts of a text between runs of ``between``, a regular expression of such a run."""
    return F.array_remove(F.split(text, between), "")
