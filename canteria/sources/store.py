"""The durable side: an append-only log of JSON lines and content-addressed snapshots."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from hashlib import sha256

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import ISO, canonical_line, line_form, line_sha
from ..functions.text import content_hash, py_strip
from ..session import path_exists

# The layout of a store.
LOG_DIR, LOG_NAME, SNAPSHOT_DIR = "log", "inscripciones.jsonl", "snapshots"
#: Folder beside the log file with what was appended by many tasks at once, a numbered folder for each time.
SEGMENT_DIR = "segmentos"


def now() -> str:
    return datetime.now().strftime(ISO)


def log_path(root: str) -> str:
    return f"{root.rstrip('/') if '://' in root else os.path.abspath(root)}/{LOG_DIR}/{LOG_NAME}"


def _one_json(line: Column) -> Column:
    """Is the line one JSON value, as Python's reader takes them?

    It is read as the first of two elements of an array; a line that closes
    the array itself, or holds more than one value, does not leave the second,
    which no line can guess, in its place.
    """
    mark = uuid.uuid4().hex
    pair = F.from_json(F.concat(F.lit("["), line, F.lit(f',"{mark}"]')), "array<string>", {"allowSingleQuotes": "false"})
    return (F.size(pair) == 2) & (F.get(pair, F.lit(1)) == mark)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, linea) of the lines that are not blank, of a log file and the segments beside it."""
    segments = f"{path.rsplit('/', 1)[0]}/{SEGMENT_DIR}"
    there = [p for p in (path, segments) if path_exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "seq struct<archivo:string,bloque:long,fila:long>, linea string")
    raw = spark.read.option("recursiveFileLookup", "true").text(there)
    seq = F.struct(F.col("_metadata.file_path").alias("archivo"), F.col("_metadata.file_block_start").alias("bloque"), F.monotonically_increasing_id().alias("fila"))
    return raw.select(seq.alias("seq"), py_strip(F.col("value")).alias("linea")).where(F.col("linea") != "")


def _refused(what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what} at "), F.to_json("seq")))


def read_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(seq, linea) of every line that is not blank, wholly inside the JVM.

    seq is a sortable place (file, block, row in block), so reading in order
    needs no shuffle; segments come after the log file, in order of number.
    ``strict`` makes a line that is no JSON an error when it is read, naming
    its place; otherwise such lines are left out.  A missing log has no lines.
    """
    lines, good = _lines(spark, path), _one_json(F.col("linea"))
    if not strict:
        return lines.where(good)
    return lines.select("seq", F.when(good, F.col("linea")).otherwise(_refused("no JSON in the log")).alias("linea"))


def canonical_log(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line_sha, event): every event in canonical form, whatever the spacing and key order of its line; parsed once."""
    rows = _lines(spark, path).select("seq", canonical_line(F.col("linea")).alias("event"))
    rows = rows.select("seq", F.coalesce("event", _refused("no JSON in the log")).alias("event"))
    return rows.select("seq", line_sha(F.col("event")).alias("line_sha"), "event")


class EventStore:
    """Append and put only: nothing here changes or deletes what is stored.

    ``root`` is a local or mounted folder, or a URI of a file system Arrow
    knows (``hdfs://``, ``s3://``, ``gs://``, ``file://``).  One process at a
    time writes a store, through its driver (:meth:`append`,
    :meth:`put_snapshot`) or with many tasks (:meth:`append_frame`,
    :meth:`put_snapshots`); all tasks must then reach ``root``.  Reading for
    queries goes through Spark.
    """

    def __init__(self, root: str, clock: Callable[[], str] | None = None):
        self.root = root.rstrip("/") if "://" in root else os.path.abspath(root)
        self.clock = clock or now
        self.log_path = f"{self.root}/{LOG_DIR}/{LOG_NAME}"
        self.segments = f"{self.root}/{LOG_DIR}/{SEGMENT_DIR}"
        self.snapshot_dir = f"{self.root}/{SNAPSHOT_DIR}"
        self.files, base = fs.FileSystem.from_uri(self.root) if "://" in root else (fs.LocalFileSystem(), self.root)
        self._cut = len(self.root) - len(base)  # what a path of Spark has before one of Arrow
        for d in (self.log_path.rpartition("/")[0], self.snapshot_dir):
            self.files.create_dir(d[self._cut :], recursive=True)

    def _names(self, folder: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(folder[self._cut :], allow_not_found=True))
        return sorted(f.base_name for f in found)

    def _exists(self, path: str) -> bool:
        return self.files.get_file_info(path[self._cut :]).type != fs.FileType.NotFound

    def _write(self, path: str, data: bytes) -> None:
        """A file that appears whole or not at all."""
        folder, _, name = path[self._cut :].rpartition("/")
        hidden = f"{folder}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(hidden) as f:
            f.write(data)
        self.files.move(hidden, f"{folder}/{name}")

    def _next_segment(self) -> str:
        numbers = [int(n) for n in self._names(self.segments) if n.isdigit()]
        return f"{self.segments}/{max(numbers, default=0) + 1:012d}"

    def append(self, events: Iterable[dict]) -> list[dict]:
        """Adds events in order in one write; ``ts`` is set only where the key is missing.

        They go to the log file, unless there are segments, as what comes later
        must be read later, or the file system cannot add to a file: then they
        are a segment of their own.
        """
        out = [e if "ts" in e else {**e, "ts": self.clock()} for e in events]
        data = "".join(line_form(e) + "\n" for e in out).encode()
        if not data:
            return out
        if not self._names(self.segments) and isinstance(self.files, (fs.LocalFileSystem, fs.HadoopFileSystem)):
            with self.files.open_append_stream(self.log_path[self._cut :]) as f:
                f.write(data)
        else:
            folder = self._next_segment()
            self.files.create_dir(folder[self._cut :], recursive=True)
            self._write(f"{folder}/part-00000.txt", data)
        return out

    def append_event(self, event: dict) -> dict:
        return self.append([event])[0]

    def append_frame(self, events: DataFrame, *order: str) -> int:
        """Adds ``evento`` (JSON) of every row, ordered by ``order``, as one segment written by all tasks; the number of lines.

        ``ts`` is the time of the call where an event has none.  The segment
        appears whole or not at all.
        """
        spark, ts = events.sparkSession, F.lit(json.dumps({"ts": self.clock()})[1:-1])
        body = F.col("evento")
        dated = F.when(F.array_contains(F.json_object_keys(body), "ts"), body).otherwise(F.concat(F.lit("{"), ts, F.when(F.size(F.json_object_keys(body)) > 0, F.lit(", ")).otherwise(F.lit("")), F.regexp_replace(body, r"^\s*\{", "")))
        target = self._next_segment()
        temporary = f"{self.segments}/.{target.rpartition('/')[2]}"
        rows = events.select(*order, dated.alias("evento")).repartitionByRange(*order).sortWithinPartitions(*order)
        rows.select(canonical_line(F.col("evento")).alias("value")).write.mode("overwrite").text(temporary)
        n = spark.read.text(temporary).count()
        if n:
            self.files.move(temporary[self._cut :], target[self._cut :])
        else:
            self.files.delete_dir(temporary[self._cut :])
        return n

    def put_snapshot(self, data: bytes) -> str:
        """Stores bytes under their hash unless they are there; appears whole or not at all."""
        name = sha256(data).hexdigest()
        if not self.has_snapshot(name):
            self._write(f"{self.snapshot_dir}/{name}", data)
        return name

    def put_snapshots(self, contents: DataFrame) -> DataFrame:
        """(content_hash, nueva) of each different ``content`` (binary), written by the tasks that hold it; bytes that are there are not sent anywhere."""
        hashed = contents.where(F.col("content").isNotNull()).select(content_hash(F.col("content")).alias("content_hash"), "content").dropDuplicates(["content_hash"])
        known = self.snapshots(contents.sparkSession).withColumn("_there", F.lit(True))
        marked = hashed.join(known, "content_hash", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data in b.column(1):
                    self.put_snapshot(data.as_py())
                yield b.select(["content_hash"])

        new = marked.where(F.col("_there").isNull()).select("content_hash", "content").mapInArrow(run, "content_hash string").withColumn("nueva", F.lit(True))
        return new.unionByName(marked.where(F.col("_there")).select("content_hash", F.lit(False).alias("nueva")))

    def has_snapshot(self, name: str) -> bool:
        """Is there a snapshot of this name?  The empty name is the folder itself and so there."""
        return self._exists(f"{self.snapshot_dir}/{name}".rstrip("/"))

    def read_snapshot(self, name: str) -> bytes:
        with self.files.open_input_stream(f"{self.snapshot_dir}/{name}"[self._cut :]) as f:
            return f.read()

    def iter_events(self) -> Iterable[dict]:
        """Events one by one on the driver, for tools on small stores; queries use :meth:`log`."""
        parts = [f"{self.segments}/{k}/{n}" for k in self._names(self.segments) if k.isdigit() for n in self._names(f"{self.segments}/{k}") if n.startswith("part-")]
        for path in [p for p in (self.log_path,) if self._exists(p)] + parts:
            with self.files.open_input_stream(path[self._cut :]) as f:
                yield from (json.loads(line) for line in f.read().decode().split("\n") if line.strip())

    def log(self, spark: SparkSession, strict: bool = True) -> DataFrame:
        return read_log(spark, self.log_path, strict)

    def log_ids(self, spark: SparkSession) -> DataFrame:
        """Distinct ids in the log."""
        return self.log(spark).select(F.get_json_object("linea", "$.id").alias("id")).where(F.col("id").isNotNull()).distinct()

    def snapshots(self, spark: SparkSession) -> DataFrame:
        """(content_hash) of every stored snapshot, from a listing alone."""
        return self.snapshot_contents(spark).select("content_hash")

    def snapshot_contents(self, spark: SparkSession) -> DataFrame:
        """(content_hash, content)."""
        files = spark.read.format("binaryFile").load(self.snapshot_dir)
        named = files.select(F.element_at(F.split("path", "/"), -1).alias("content_hash"), "content")
        empty = sha256(b"").hexdigest()  # a file without bytes is in no split
        return named.unionByName(spark.createDataFrame([(empty, b"")], "content_hash string, content binary")) if self.has_snapshot(empty) else named
