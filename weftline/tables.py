"""Tables that are written once and read again, and logs of commits: what a folder's readers see is what its newest commit lists."""

from __future__ import annotations

import gc
import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .errors import BackendError


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset a folder of this machine serves, which only a local session can share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise BackendError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """(Hadoop file system, Hadoop path) of a path of any scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes a table into the shared folder and reads it back: later steps neither repeat the work nor depend on executors that are lost."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nobody reads any more, and lets Spark drop the shuffle files of finished jobs, which it does
    only when the driver collects its garbage."""
    for df in tables:
        folder = next(iter(df.inputFiles()), "").rpartition("/")[0]
        if folder.rpartition("/")[2].startswith("weftline-"):
            fs, p = file_system(df.sparkSession, folder)
            fs.delete(p, True)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs."""
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame, least_bytes: int = 2 << 20, most_bytes: int = 1 << 30) -> DataFrame:
    """A table of some megabytes in fewer files than there are cores, dealt over all of them; a smaller or larger one stays as it lies. For
    work that is far dearer than moving such a table once."""
    spark, files = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if not 0 < len(files) < cores:
        return df
    size = sum(fs.getFileStatus(p).getLen() for fs, p in (file_system(spark, f) for f in files))
    return df.repartition(cores) if least_bytes <= size <= most_bytes else df


class CommitLog:
    """Numbered JSON files in a folder. One is written under a temporary name and then renamed, never over another, so it is there whole or
    not at all, and of two writers of one number one wins."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def newest(self) -> tuple[int, dict] | None:
        """The highest number whose file can be read as an object; files that other tools tore are passed over."""
        fs, p = file_system(self.spark, self.path)
        if not fs.exists(p):
            return None
        names = sorted((s.getPath().getName() for s in fs.listStatus(p)), reverse=True)
        for name in (n for n in names if n.endswith(".json") and n[:-5].isdigit()):
            try:
                found = json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])
            except (ValueError, TypeError):
                continue
            if isinstance(found, dict):
                return int(name[:-5]), found
        return None

    def at(self, number: int) -> dict | None:
        """What was published under a number, while it is kept."""
        fs, p = file_system(self.spark, f"{self.path}/{number:08d}.json")
        return json.loads(self.spark.read.text(f"{self.path}/{number:08d}.json", wholetext=True).first()[0]) if fs.exists(p) else None

    def publish(self, number: int, content: dict) -> None:
        fs, temp = file_system(self.spark, f"{self.path}/.{uuid.uuid4().hex}.tmp")
        _, final = file_system(self.spark, f"{self.path}/{number:08d}.json")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        if not self._rename(fs, temp, final):
            fs.delete(temp, False)
            raise BackendError(f"number {number} was published by another writer")

    def _rename(self, fs, temp, final) -> bool:  # noqa: ANN001
        """Renames unless the target exists. A local file system would replace it, so there the target is made as a link."""
        if fs.getScheme() == "file":
            source, target = (p.toUri().getPath() for p in (temp, final))
            try:
                os.link(source, target)
            except FileExistsError:
                return False
            os.unlink(source)
            return True
        return not fs.exists(final) and bool(fs.rename(temp, final))

    def update(self, change: Callable[[dict], dict | None], tries: int = 8) -> dict:
        """Publishes what ``change`` makes of the newest content, anew if another writer came first; None publishes nothing."""
        for _ in range(tries):
            number, now = self.newest() or (0, {})
            new = change(now)
            if new is None:
                return now
            try:
                self.publish(number + 1, new)
            except BackendError:
                continue
            return new
        raise BackendError("other writers kept coming first")


class Store:
    """Small files of a project in a folder of any file system."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, (folder if "://" in folder else "file://" + os.path.abspath(folder)).rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        fs, p = file_system(self.spark, self.path(name))
        return bool(fs.exists(p))

    def read(self, name: str) -> str:
        return self.spark.read.text(self.path(name), wholetext=True).first()[0] if self.exists(name) else ""

    def names(self, folder: str) -> list[str]:
        fs, p = file_system(self.spark, self.path(folder))
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith(".")) if fs.exists(p) else []

    def write(self, name: str, text: str, exclusive: bool = False) -> None:
        """Whole or not at all; with ``exclusive`` an existing file is an error."""
        fs, final = file_system(self.spark, self.path(name))
        _, temp = file_system(self.spark, f"{self.path(name)}.{uuid.uuid4().hex}.tmp")
        out = fs.create(temp, False)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        if exclusive:
            done = CommitLog(self.spark, self.folder)._rename(fs, temp, final)
        elif fs.getScheme() == "file":
            os.replace(temp.toUri().getPath(), final.toUri().getPath())
            done = True
        else:
            fs.delete(final, False)
            done = fs.rename(temp, final)
        if not done:
            fs.delete(temp, False)
            raise BackendError(f"{name} exists")

    def delete(self, name: str, recursive: bool = False) -> None:
        fs, p = file_system(self.spark, self.path(name))
        fs.delete(p, recursive)
