"""Readers of the Parquet tables and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``; the schema comes from the Parquet footer."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (a local session, as in tests) a folder of our own
    is made and used.
    """
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="lexspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def run_dir(spark: SparkSession, what: str) -> str:
    """A new folder of one run's written tables in the shared folder; it goes when the program ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before
        pass


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends, nothing runs twice."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)



def _state_of(spark: SparkSession, root: str, names: list[str]) -> str:
    """A fingerprint of the files of some tables: their names, sizes and times."""
    jvm = spark.sparkContext._jvm
    seen = []
    for n in names:
        for f in sorted(table(spark, root, n).inputFiles()):
            p = jvm.org.apache.hadoop.fs.Path(f)
            st = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
            seen.append(f"{f} {st.getLen()} {st.getModificationTime()}")
    return hashlib.md5("\n".join(seen).encode()).hexdigest()


def stored(spark: SparkSession, root: str, names: list[str], what: str, make: Callable[[], DataFrame], write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """A table derived from others, written once for a state of their files and read from then on.

    It is written under a name of its own and then renamed, so a reader sees
    all of it or none.
    """
    path = f"{shared_dir(spark)}/{what}-{_state_of(spark, root, names)}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p(f"{path}/_SUCCESS")):
        aside = f"{path}-{uuid.uuid4().hex}"
        write(make(), aside)
        if not fs.rename(p(aside), p(path)):  # another run was first
            fs.delete(p(aside), True)
    return spark.read.parquet(path)
