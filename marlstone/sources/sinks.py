"""Sinks: versioned tables and sets of tables with a pointer to the current one, working tables, upserts and append-only audits."""

from __future__ import annotations

import os
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(df: DataFrame, folder: str, by: tuple[str, ...] = ()) -> str:
    """Write a new version (in folders of the columns ``by``), then append its name to the log of versions: readers see the old or the new one whole."""
    return publish_set(df.sparkSession, folder, lambda at: df.write.partitionBy(*by).parquet(at))


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last published version; None if there is none."""
    at = current_set(spark, folder)
    return spark.read.parquet(at) if at else None


def _newest(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """Number and name of the last version."""
    try:
        log = spark.read.schema("version string, n long").parquet(f"{folder}/_versions")
        name, n = log.agg(F.max_by("version", F.struct("n", "version")), F.max("n")).first()
        return n or 0, name
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0, None
        raise


def publish_set(spark: SparkSession, folder: str, write) -> str:
    """Let ``write`` put several tables under the folder of a new version, then append that version to the log: readers see the tables of one version together.

    Versions are numbered, whatever the writers' clocks say; writers that must not overlap hold ``only_writer``.
    """
    version = uuid.uuid4().hex
    write(f"{folder}/v-{version}")
    n = _newest(spark, folder)[0] + 1
    spark.range(1).select(F.lit(version).alias("version"), F.lit(n).cast("long").alias("n")).coalesce(1).write.mode("append").parquet(f"{folder}/_versions")
    return version


def current_set(spark: SparkSession, folder: str) -> str | None:
    """The folder of the last published set of tables; None if there is none."""
    last = _newest(spark, folder)[1]
    return f"{folder}/v-{last}" if last else None


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


@contextmanager
def only_writer(spark: SparkSession, folder: str, stale: float = 180.0, wait: float = 600.0, poll: float = 0.5) -> Iterator[None]:
    """Hold the lock of a folder: a file that one writer can create.  Others wait, up to ``wait`` seconds.

    The holder touches the file while it works; one that has not been touched for ``stale`` seconds is left over from a writer that died,
    and is moved away by whoever comes first.
    """
    fs, lock = _file_system(spark, f"{folder}/_lock")
    until = time.monotonic() + wait
    while not _created(fs, lock):
        with suppress(Exception):  # it may go meanwhile
            old = lambda at: time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > stale
            if old(lock):
                away = _file_system(spark, f"{folder}/_stale-{uuid.uuid4().hex}")[1]
                if fs.rename(lock, away) and not old(away):  # one of those who try; was it a new writer's by now?
                    fs.rename(away, lock)
                fs.delete(away, False)
                continue
        if time.monotonic() > until:
            raise TimeoutError(f"another writer holds {folder}")
        time.sleep(poll)
    done = threading.Event()

    def touch() -> None:
        while not done.wait(stale / 4):
            with suppress(Exception):
                fs.setTimes(lock, int(time.time() * 1000), -1)

    beat = threading.Thread(target=touch, daemon=True)
    beat.start()
    try:
        yield
    finally:
        done.set()
        beat.join()
        fs.delete(lock, False)


def _created(fs, lock) -> bool:
    """Create the file unless it is there, in one step: as the file system does it (HDFS does), or as the operating system does for a mounted folder."""
    try:
        if fs.getScheme() == "file":  # whose create looks first and writes then
            path = lock.toUri().getPath()
            os.makedirs(os.path.dirname(path), exist_ok=True)
            os.close(os.open(path, os.O_CREAT | os.O_EXCL))
        else:
            fs.create(lock, False).close()
        return True
    except Exception as e:
        if "exist" in str(e).lower():
            return False
        raise


def state_of_files(spark: SparkSession, path: str) -> str:
    """A digest of names, sizes and times of the files of a table."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    row = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")  # contents are not read
    return str(tuple(files.agg(F.count("*"), F.sum(row)).first()))


#: Most rows of a side that is sent to every executor; larger ones are shuffled.
FEW_ROWS = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """df, marked for broadcasting if a count shows that it is small; df has a few narrow columns."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def working_folder(spark: SparkSession) -> str:
    """Where this application's working tables are: in the folder of spark.checkpoint.dir; in a temporary one only where that is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{folder.rstrip('/')}/work-{spark.sparkContext.applicationId}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the working folder and read back, for what several plans read: nothing stays in executors' memory."""
    path = f"{working_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def audit(df: DataFrame, folder: str) -> None:
    df.write.mode("append").parquet(folder)
