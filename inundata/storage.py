"""Intermediate tables in the folder that all executors share.

Multi-step operators cut their lineage with written tables, never with local
copies: a lost executor then costs a re-read, not a wrong or failed result.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one if unset, which only a local master can share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder for {master}")
        found = "file://" + tempfile.mkdtemp(prefix="inundata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system layer; a missing one is fine."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffled(cells: DataFrame) -> DataFrame:
    """The same rows, for one side of a join that is never to be broadcast.

    Spark takes a table for as large as its files, and millions of cells fit a
    few compressed megabytes: the driver would collect and hash them all.
    """
    return cells.hint("merge")


class Scratch:
    """Named tables below one fresh shared folder.

    ``with Scratch(spark) as s``: tables written with ``save`` go when the block
    ends, those written with ``keep`` stay, for results that are read later.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/inundata/{uuid.uuid4().hex}", 0
        self.drops: list[str] = []
        self.saved: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.drops:
            delete_path(self.spark, path)

    def path(self, name: str, keep: bool = False) -> str:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        if not keep:
            self.drops.append(path)
        return path

    def save(self, df: DataFrame, name: str = "t", keep: bool = False) -> DataFrame:
        path = self.path(name, keep)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.saved[id(out)] = out, path
        return out

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        return self.save(df, name, keep=True)

    def drop(self, df: DataFrame) -> None:
        """Delete a saved or kept table before the block ends, to give its disk back."""
        _, path = self.saved.pop(id(df), (None, None))
        if path:
            delete_path(self.spark, path)
            if path in self.drops:
                self.drops.remove(path)
