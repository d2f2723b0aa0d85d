"""Session helpers: where intermediate tables go and how they are written.

Iterative operators cut their lineage by writing a Parquet table into the
folder the cluster names in ``spark.checkpoint.dir`` (shared by every executor,
so a lost executor costs a task retry and not the job).  Only a local session
without that setting falls back to a folder of its own.
"""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_MARKED: set[str] = set()


def _conf(spark: SparkSession, key: str) -> str | None:
    value = spark.conf.get(key, None)
    if value:
        return value
    return spark.sparkContext.getConf().get(key, None)


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application; deleted when its driver ends."""
    base = _conf(spark, "spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="canteria-")
            atexit.register(shutil.rmtree, _LOCAL_DIRS[app], True)
        base = _LOCAL_DIRS[app]
    folder = f"{base.rstrip('/')}/canteria/{app}"
    if app not in _MARKED:
        fs, p = file_system(spark, folder)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _MARKED.add(app)
    return folder


def kept_path(spark: SparkSession, name: str) -> str:
    """Folder for what later runs build on: under ``spark.canteria.kept.dir`` where that is set, else of this application alone."""
    base = _conf(spark, "spark.canteria.kept.dir")
    return f"{base.rstrip('/')}/{name}" if base else f"{work_dir(spark)}/{name}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its object."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application, so it need not be installed where they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(package):  # already run from an archive
        return
    folder = tempfile.mkdtemp(prefix="canteria-code-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "canteria.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, run where the workers have this package."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` once and return the table read back, with its path."""
    table, path, _ = materialize_with(df, tag)
    return table, path


def materialize_with(df: DataFrame, tag: str, place: str | None = None, **metrics: Column) -> tuple[DataFrame, str, dict[str, int]]:
    """The same, with aggregates observed by the job that writes; ``place`` names the path, its {} a new name.

    A task that runs twice may count twice, so a metric says whether there is
    anything, and about how much, and never enters a result.
    """
    spark = df.sparkSession
    path = place.format(uuid.uuid4().hex) if place else new_path(spark, tag)
    seen = Observation() if metrics else None
    watched = df.observe(seen, *[c.alias(k) for k, c in metrics.items()]) if seen else df
    watched.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path, dict(seen.get) if seen else {}


def release(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables nothing reads any more."""
    for path in paths:
        fs, p = file_system(spark, path)
        fs.delete(p, True)


def release_all(spark: SparkSession) -> None:
    """Delete every intermediate table of this application, when no result of it is read any more."""
    release(spark, work_dir(spark))


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


_STATUS = re.compile(r"\w*FileStatus\{path=(.*?); isDirectory=(true|false);(?: length=(\d+);)?.*?modification_time=(\d+);")


def list_files(spark: SparkSession, path: str) -> dict[str, str]:
    """Data files of a table, a file or a folder of any depth, and what tells whether one has changed: its length and time."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return {}
    out, todo = {}, [p]
    while todo:
        for status in fs.listStatus(todo.pop()):
            m = _STATUS.match(status.toString())  # one call across the bridge instead of four
            at, folder, length, changed = m.groups() if m else (status.getPath().toString(), str(status.isDirectory()).lower(), status.getLen(), status.getModificationTime())
            name = at.rsplit("/", 1)[-1]
            if name.startswith(("_", ".")):
                continue
            if folder == "true":
                todo.append(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at))
            else:
                out[at] = f"{length}@{changed}"
    return out


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, on the driver."""
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small text file that is not there yet; False, and nothing written, if it is."""
    fs, p = file_system(spark, path)
    _, temporary = file_system(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    stream = fs.create(temporary, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    done = not fs.exists(p) and fs.rename(temporary, p)
    if not done:
        fs.delete(temporary, False)
    return bool(done)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """One table of a data folder, reduced to the columns a query needs."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df
