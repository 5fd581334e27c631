"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode a temporary folder where it is unset (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


#: Folders that were handed out and not removed yet, oldest first.
_made: list[str] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    _made.append(f"{shared_dir(spark)}/mf-{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def remove_since(spark: SparkSession, mark: int, but: tuple[str, ...] = ()) -> int:
    """Removes the folders handed out since there were ``mark`` of them, other than ``but``; returns how many are left.

    For a caller that has written what it needs: tables that are still read
    from such a folder fail afterwards.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in [p for p in _made[mark:] if p not in but]:
        path(name).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(name), True)
        _made.remove(name)
    return len(_made)


def handed_out() -> int:
    return len(_made)


def write_table(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to ``path`` and read it again."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a new folder of the shared one and read it again.

    The lineage ends there, so lost executors cost no recomputation, and the
    planner knows the size of what it reads.
    """
    return write_table(df, fresh_path(df.sparkSession, tag), codec)
