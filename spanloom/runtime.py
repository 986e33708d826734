"""Session settings and the shared folder in which lineage is cut.

Executors can be lost at any time, so intermediate results that are used more than once are written as
Parquet tables below ``spark.checkpoint.dir``, a folder that all executors share. Only where a session has no
such setting (local tests) a temporary folder is set.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that Python workers find it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="spanloom-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/spanloom_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent).as_posix())
    spark.sparkContext.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one is set where the session names none."""
    where = spark.conf.get(CHECKPOINT_KEY, None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set(CHECKPOINT_KEY, where)
    return where.rstrip("/")


_cleaned: set[str] = set()


def new_path(spark: SparkSession, hint: str) -> str:
    """A path below the shared folder, which is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _cleaned:
        _cleaned.add(app)
        atexit.register(_cleanup_quietly, spark)
    return f"{shared_dir(spark)}/spanloom/{spark.sparkContext.applicationId}/{hint}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> None:
    """Deletes all tables that this application has written to the shared folder; results that read them end with it."""
    drop_path(spark, f"{shared_dir(spark)}/spanloom/{spark.sparkContext.applicationId}")


def _cleanup_quietly(spark: SparkSession) -> None:
    try:
        cleanup(spark)
    except Exception:  # noqa: BLE001, S110 - the session may have ended before
        pass


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a written table that has been superseded."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, hint: str) -> tuple[DataFrame, str]:
    """Writes ``df`` once to the shared folder; gives the table as read back and its path."""
    spark = df.sparkSession
    path = new_path(spark, hint)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Folder:
    """Small files and names below a folder on any file system of the session's Hadoop configuration; used on the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if self.root and name else self.root or name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self, name: str = "") -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def names(self, name: str = "") -> list[str]:
        """Names of what lies in a folder."""
        fs, path = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str) -> str | None:
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """All or nothing: written beside its place and then moved there."""
        fs, path = self._at(name)
        temp = path.suffix(f".{uuid.uuid4().hex}.tmp")
        stream = fs.create(temp, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if fs.exists(path):
            fs.delete(path, False)
        if not fs.rename(temp, path):
            raise OSError(f"{path} can't be written")

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def move(self, name: str, to: str) -> None:
        fs, path = self._at(name)
        _, target = self._at(to)
        fs.mkdirs(target.getParent())
        if not fs.rename(path, target):
            raise OSError(f"{path} can't be moved to {target}")
