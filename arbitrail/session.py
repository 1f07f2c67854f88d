"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Settings the results depend on. A session made elsewhere gets them from ``prepare``.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # A repeated key keeps its last value, as the usual JSON map readers do.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# A task that meets few days writes them side by side instead of sorting all its rows by day first.
WRITE_SETTINGS = {"spark.sql.maxConcurrentOutputFileWriters": "16"}


def build_session(master: str = "local[8]", memory: str = "8g", **settings: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("arbitrail")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in {**RESULT_SETTINGS, **WRITE_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in {**RESULT_SETTINGS, **WRITE_SETTINGS}.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def one_writer(spark: SparkSession) -> Iterator[None]:
    """Within, a task closes one folder's file before it opens the next: for rows that come in the folders' order, each of whose open files would hold its rows in memory."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, "0")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for ``purpose`` below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the library's own making, wherever Spark reaches it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none while it isn't there."""
    if not folder_exists(spark, folder):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]


def read_text(spark: SparkSession, file: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text_once(spark: SparkSession, file: str, text: str) -> bool:
    """Writes a small file under another name and renames it, so that it is there whole or not at all. False, and nothing
    changed, if a file of that name exists."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target, draft = hadoop.Path(file), hadoop.Path(f"{file}.{uuid.uuid4().hex[:12]}.tmp")
    files = target.getFileSystem(conf)
    out = files.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    keep = getattr(hadoop, "Options$Rename").NONE  # an existing file is not replaced
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = keep
    try:
        hadoop.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, options)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
            return False
        raise
    return True
