"""Session settings and the folder that all executors share."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_made: list[str] = []
_tables: dict[str, str] = {}
_runs: dict[str, str] = {}


def session(app: str = "tallymill", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session, for tests and the bench, with the settings every job here assumes: UTC, ANSI, AQE.

    On a cluster the number of shuffle partitions is the job's own; here it is the number of cores, 8 where that isn't given.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where it lies, also if only the driver's ``sys.path`` names that place."""
    root, environment = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    A cluster names it and every executor can read it. Only where the setting is empty (a local test) a
    temporary folder of this machine is used.
    """
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="tallymill-")
    return f"file://{_local_dir}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in a folder of this application that goes when the application ends."""
    shared = shared_dir(spark)
    if shared not in _runs:
        _runs[shared] = f"{shared}/tallymill-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_runs[shared])
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    _made.append(f"{_runs[shared]}/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete what ``scratch`` has named in this process, once no result that reads it is needed any more."""
    paths = _made[:]
    _made.clear()
    for path in paths:
        root, _, name = path.rpartition("/")
        SharedFiles(spark, root).delete(name)
        for table in [t for t, at in _tables.items() if at == path or at.startswith(f"{path}/")]:
            spark.sql(f"drop table if exists {table}")
            del _tables[table]
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder: its lineage ends there, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(spark: SparkSession, path: str, schema: str, column: str, buckets: int) -> str:
    """The name under which this session knows the table at ``path``, bucketed by ``column``.

    Rows of one bucket are in files of their own, so grouping or joining by ``column`` takes them as they lie. The catalog only refers to the path;
    what counts is what lies there, for this session and any other.
    """
    name = f"tallymill_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
    spark.sql(f"create table if not exists {name} ({schema}) using parquet clustered by ({column}) into {buckets} buckets location '{path}'")
    _tables[name] = path
    return name


class SharedFiles:
    """The few calls on the shared file system that the drivers of multi-step jobs need."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def names(self) -> list[str]:
        """Names directly below the root, sorted; none if the root isn't there."""
        if not self._fs.exists(self._root):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._root))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def move(self, name: str, to: str) -> None:
        """Rename within the root; the folder it goes to is made if need be."""
        self._fs.mkdirs(self._path(to).getParent())
        if not self._fs.rename(self._path(name), self._path(to)):
            raise OSError(f"{name} can't be moved to {to}")

    def publish(self, name: str, text: str) -> bool:
        """Write ``text`` beside its place and rename it there; False if another writer came first."""
        temporary = self._path(f".{name}.{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path(name).getParent())
        out = self._fs.create(temporary, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(temporary, self._path(name)):
            self._fs.delete(temporary, False)
            return False
        return True

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
