"""Where a log can be exported to: insert-if-absent by line hash."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.claims import upsert_new
from ..session import materialize, path_exists, release
from .store import canonical_log

# Fixed value: the statement of the receiving table.
UPSERT = "INSERT INTO aec_log (line_sha, event) {} ON CONFLICT (line_sha) DO NOTHING"


class CountingSink:
    """A dry run: counts what an export to an empty replica would insert; nothing is kept on the driver."""

    inserted = conflicts = 0

    def write(self, lines: DataFrame) -> None:
        n = lines.select("line_sha").distinct().count()
        self.inserted += n
        self.conflicts += lines.count() - n

    def close(self) -> None:
        pass


class MemorySink:
    """Lines kept in a dict, for tests on small logs; the counters add up over its life."""

    def __init__(self, existing: dict[str, str] | None = None):
        self.store, self.inserted, self.conflicts = dict(existing or {}), 0, 0

    def write(self, lines: DataFrame) -> None:
        before, n = len(self.store), 0
        for row in lines.toLocalIterator():
            self.store.setdefault(row["line_sha"], row["event"])
            n += 1
        self.inserted += len(self.store) - before
        self.conflicts += n - (len(self.store) - before)

    def close(self) -> None:
        pass


class ParquetSink:
    """A replica table in Parquet; only lines it lacks are added, by an anti-join."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.inserted, self.conflicts = spark, path, 0, 0

    def write(self, lines: DataFrame) -> None:
        there = self.spark.read.parquet(self.path).select("line_sha") if path_exists(self.spark, self.path) else self.spark.createDataFrame([], "line_sha string")
        new, at = materialize(upsert_new(lines.select("line_sha", "event"), there), "new")
        n = new.count()
        if n:
            new.write.mode("append").parquet(self.path)
        release(self.spark, at)
        self.inserted += n
        self.conflicts += lines.count() - n

    def close(self) -> None:
        pass


def _library():
    try:
        import psycopg as library
    except ImportError:
        import psycopg2 as library
    return library


class PostgresSink:
    """The replica table in Postgres.

    The tasks copy their partitions into a staging table of this export, each
    in its own transaction and under its own attempt; :meth:`close` moves the
    rows of one attempt of every partition to the replica with a single
    statement and commit, so an export that dies has inserted nothing.  The
    driver library is imported only where a connection is opened.
    """

    def __init__(self, url: str, connect: Callable | None = None, rows_at_once: int = 1000):
        self.connect = connect or (lambda: _library().connect(url))
        self.rows_at_once, self.staged, self.inserted, self.conflicts = rows_at_once, [], 0, 0
        self.table: str | None = f"aec_log_stage_{uuid.uuid4().hex}"
        self._run(f"CREATE TABLE {self.table} (attempt TEXT, line_sha TEXT, event TEXT)")

    def _run(self, *statements: str) -> list[int]:
        connection = self.connect()
        try:
            with connection.cursor() as cursor:
                counts = []
                for s in statements:
                    cursor.execute(s)
                    counts.append(cursor.rowcount)
            connection.commit()
            return counts
        finally:
            connection.close()

    def write(self, lines: DataFrame) -> None:
        """Stage the lines; counters are known after :meth:`close`."""
        connect, table, size = self.connect, self.table, self.rows_at_once

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            attempt, n, connection = uuid.uuid4().hex, 0, connect()
            rows = ((attempt, *r) for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            try:
                with connection.cursor() as cursor:
                    while chunk := list(itertools.islice(rows, size)):
                        cursor.executemany(f"INSERT INTO {table} VALUES (%s, %s, %s)", chunk)
                        n += len(chunk)
                connection.commit()
            finally:
                connection.close()
            yield pa.RecordBatch.from_pydict({"attempt": [attempt], "n": [n]})

        # One row a partition; an attempt Spark gave up leaves rows nothing names.
        self.staged += [(r["attempt"], r["n"]) for r in lines.select("line_sha", "event").mapInArrow(run, "attempt string, n long").collect()]

    def close(self) -> None:
        if self.table is None:
            return
        named = ", ".join(f"'{a}'" for a, _ in self.staged) or "''"
        source = f"SELECT DISTINCT ON (line_sha) line_sha, CAST(event AS jsonb) FROM {self.table} WHERE attempt IN ({named})"
        self.inserted = self._run(UPSERT.format(source), f"DROP TABLE {self.table}")[0]
        self.conflicts = sum(n for _, n in self.staged) - self.inserted
        self.table = None


def export_log(spark: SparkSession, path: str, sink) -> dict[str, int]:
    """Every event of a log into a sink; {read, inserted, conflicts}.  Snapshots never leave.

    Lines are canonicalised once, into a stored table; as a sink keeps one
    line of each hash and equal hashes are equal lines, their order is free.
    A Postgres sink is closed here, as its counts need the commit.
    """
    lines, at = materialize(canonical_log(spark, path).select("line_sha", "event"), "lines")
    read = lines.count()
    sink.write(lines)
    if isinstance(sink, PostgresSink):
        sink.close()
    release(spark, at)
    return {"read": read, "inserted": sink.inserted, "conflicts": sink.conflicts}
