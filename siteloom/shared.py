"""The folder that the driver and all executors share, and tables of one call in it."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Only a local session without it gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="siteloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    files, place = _place(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def make_folder(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.mkdirs(place)


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def joined(spark: SparkSession, parts: str, target: str, head: bytes) -> list[dict]:
    """One file of a head and a folder's part files, in order of their names: (name, start, bytes) of each.

    Bytes are copied from stream to stream, a megabyte at a time. The file takes its name once it is whole.
    """
    files, folder = _place(spark, parts)
    path, streams = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils
    found = sorted((s.getPath().getName(), s.getLen()) for s in files.listStatus(folder) if s.getPath().getName().startswith("part-"))
    out, start, listed = files.create(path(target + ".partial"), True), len(head), []
    try:
        out.write(bytearray(head))
        for name, size in found:
            part = files.open(path(f"{parts}/{name}"))
            try:
                streams.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
            listed.append({"name": name, "start": start, "bytes": size})
            start += size
    finally:
        out.close()
    if not files.rename(path(target + ".partial"), path(target)):
        raise OSError(f"{target} can't be written")
    return listed


def write_text(spark: SparkSession, path: str, text: str) -> None:
    files, place = _place(spark, path)
    out = files.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, sorted; nothing if there is no folder."""
    files, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Renames unless the target is there already: of several that try, one succeeds, where the file system's rename is atomic."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path
    where = place(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(place(source), where, spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
    except Py4JJavaError as e:
        if exists(spark, target):  # what was to be moved may be gone by then
            return False
        raise e
    return True


def read_text(spark: SparkSession, path: str) -> str:
    files, place = _place(spark, path)
    stream = files.open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
