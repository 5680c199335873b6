"""Tables written to the shared folder, to cut lineage so that lost executors cost no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where that is unset and the master is local, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "t", rows_together: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The returned frame's plan is a plain scan, whose files outlive any executor. A reader holds up to some
    thousand rows at once; where single rows are large, ``rows_together`` bounds that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if rows_together:
        writer = writer.option("parquet.block.row.count.limit", rows_together)
    writer.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, count: Column, name: str = "t") -> tuple[DataFrame, int]:
    """The same, and the value of the aggregate ``count`` over the rows, read from the columns it needs."""
    out = cut(df, name)
    return out, out.agg(count).first()[0] or 0


class Versions:
    """A named table of which every commit is a new version; readers see whole versions only.

    A version is written beside the table and becomes one by a single rename, which fails where another writer was
    first. A run that dies leaves the last version in place. ``path`` is a folder that all executors share.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        _made.append(self.path)

    def numbers(self) -> list[int]:
        """Numbers of the versions there are, oldest first."""
        root = self._path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def load(self, number: int | None = None) -> DataFrame | None:
        """A version, the latest if none is named; None where there is none."""
        have = self.numbers()
        if number is None and not have:
            return None
        return self.spark.read.parquet(f"{self.path}/v{have[-1] if number is None else number:06d}")

    def commit(self, df: DataFrame) -> int:
        """Write ``df``, which may be read from an earlier version, as the next version; its number."""
        number = (self.numbers() or [0])[-1] + 1
        side = f"{self.path}/_{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(side)
        to = self._path(f"{self.path}/v{number:06d}")
        if self._fs.exists(to) or not self._fs.rename(self._path(side), to):
            self._fs.delete(self._path(side), True)
            raise RuntimeError(f"version {number} of {self.path} was committed by another writer")
        return number

    def keep(self, last: int) -> None:
        """Delete all but the ``last`` versions."""
        for n in self.numbers()[:-last]:
            self._fs.delete(self._path(f"{self.path}/v{n:06d}"), True)


def drop_all(spark: SparkSession) -> None:
    """Delete every table that :func:`cut` has made in this process; call it when results are written."""
    jvm = spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`cut` once nothing will read it again."""
    spark = df.sparkSession
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    base = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    jvm = spark.sparkContext._jvm
    for root in roots:
        if root.split(":", 1)[-1].lstrip("/").startswith(base):
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
