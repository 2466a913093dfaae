"""The folder that the driver and all executors share, and what is kept there for a while."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []  # of local sessions without spark.checkpoint.dir


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where none is named, and only in local mode, a temporary folder that goes with the process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quern-shared-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def durable(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that computes a table once, as Parquet in the shared folder. All files go at the end of the block: what it gives has to be computed by then.

    For steps with many small tables: a scan packs small files into few tasks, where a checkpoint has a task for each
    partition, and the files don't wait for the driver to collect its garbage.
    """
    folder = f"{shared_dir(spark)}/quern-scratch-{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        delete(spark, folder)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there."""
    system, p = _hadoop(spark, path)
    system.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _hadoop(spark, path)
    return system.exists(p)


def make_folder(spark: SparkSession, path: str) -> None:
    system, p = _hadoop(spark, path)
    system.mkdirs(p)


def rename(spark: SparkSession, path: str, to: str) -> None:
    system, p = _hadoop(spark, path)
    if not system.rename(p, _hadoop(spark, to)[1]):
        raise OSError(f"{path} can't be renamed")


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    system, p = _hadoop(spark, path)
    return system.getContentSummary(p).getLength()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files of a folder, in order; none if there is no folder. Those that begin with a dot are left out."""
    system, p = _hadoop(spark, path)
    if not system.exists(p):
        return []
    return sorted(name for x in system.listStatus(p) if not (name := x.getPath().getName()).startswith("."))


def read_text(spark: SparkSession, path: str) -> str:
    system, p = _hadoop(spark, path)
    stream = system.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file that wasn't there; False if it was."""
    system, p = _hadoop(spark, path)
    system.mkdirs(p.getParent())
    try:
        out = system.create(p, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or system.exists(p):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written aside and renamed, so that a reader finds the old or the new one whole."""
    system, p = _hadoop(spark, path)
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{jvm.java.util.UUID.randomUUID()}")
    out = system.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(system.makeQualified(aside), system.makeQualified(p), options)
