"""References to records that do not exist: signed counts per key.

Change deltas say that a key gained a reference, came into existence or was
withdrawn.  Added up per (target table, id) they are a state that is kept and
that later deltas are merged into; the keys with references and no existence
are the current orphan report, and those first stored after a reference the
late ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key_bytes, key_text
from ..session import list_files, materialize_with, path_exists, read_text, release, write_text
from .skew import salted_lookup

STATE = ["destino", "clave"]
STATE_SCHEMA = "destino string, clave binary, referencias long, existencias long, bajas long, ref_min long, alta_min long"


def reference_rows(df: DataFrame, tabla: str, campo: str, destino: str) -> DataFrame:
    """One row per stored reference: (tabla, campo, seq, periodo, destino, clave).

    Null and '' are no references; any other text, blanks too, is compared
    exactly.  periodo is the first seven characters of ts, '' where it is null.
    """
    return df.where(F.col(campo).isNotNull() & (F.col(campo) != "")).select(
        F.lit(tabla).alias("tabla"), F.lit(campo).alias("campo"), "seq", F.coalesce(F.substring("ts", 1, 7), F.lit("")).alias("periodo"),
        F.lit(destino).alias("destino"), key_bytes(F.col(campo)).alias("clave"),
    )


def reference_deltas(refs: DataFrame) -> DataFrame:
    """+1 reference per row."""
    return refs.select(*STATE, F.lit(1).cast("long").alias("referencias"), F.lit(0).cast("long").alias("existencias"), F.lit(0).cast("long").alias("bajas"), F.col("seq").alias("ref_min"), F.lit(None).cast("long").alias("alta_min"))


def existence_deltas(df: DataFrame, destino: str) -> DataFrame:
    """+1 existence per stored row with an id."""
    return df.where(F.col("id").isNotNull()).select(F.lit(destino).alias("destino"), key_bytes(F.col("id")).alias("clave"), F.lit(0).cast("long").alias("referencias"), F.lit(1).cast("long").alias("existencias"), F.lit(0).cast("long").alias("bajas"), F.lit(None).cast("long").alias("ref_min"), F.col("seq").alias("alta_min"))


def withdrawal_deltas(bajas: DataFrame, destinos: list[str]) -> DataFrame:
    """A withdrawal cancels all existence of its key, whenever it came."""
    return bajas.where(F.col("id").isNotNull() & F.col("tabla").isin(*destinos)).select(F.col("tabla").alias("destino"), key_bytes(F.col("id")).alias("clave"), F.lit(0).cast("long").alias("referencias"), F.lit(0).cast("long").alias("existencias"), F.lit(1).cast("long").alias("bajas"), F.lit(None).cast("long").alias("ref_min"), F.lit(None).cast("long").alias("alta_min"))


def merge_state(*parts: DataFrame) -> DataFrame:
    """The state after all deltas; a state is itself a valid part, so it is kept up by merging new deltas."""
    rows = reduce(DataFrame.unionByName, parts)
    sums = [F.sum(c).alias(c) for c in ("referencias", "existencias", "bajas")]
    return rows.groupBy(*STATE).agg(*sums, F.min("ref_min").alias("ref_min"), F.min("alta_min").alias("alta_min"))


class KeptState:
    """A state on shared storage that only deltas of new files are merged into.

    ``path`` is a folder of numbered manifests, each naming a table of the
    state and the data files that are in it.  :meth:`update` reads the files
    no manifest entry has; if one that is in the state is gone or has changed,
    the state is built anew from all files.  A manifest is written last and
    never overwritten, so a job that dies leaves the state before it, and of
    two writers the second keeps its own table to itself.  ``rows`` is about
    how many references are in the state, ``read_files`` how many files the
    last update read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.read_files, self.rows = spark, path, 0, 0

    def _manifest(self) -> tuple[int, dict] | None:
        found = list_files(self.spark, f"{self.path}/manifest") if path_exists(self.spark, f"{self.path}/manifest") else {}
        if not found:
            return None
        number = max(int(f.rsplit("/", 1)[-1]) for f in found)
        return number, json.loads(read_text(self.spark, self._at(number)))

    def update(self, tables: dict[str, str], deltas: Callable[[Callable[[str], DataFrame | None]], list[DataFrame]]) -> DataFrame:
        """The state of ``tables`` (name to path) as a stored table.

        ``deltas`` gets a function from a table's name to its rows that are to
        be added (None: none) and gives the deltas of those rows.
        """
        now = {name: list_files(self.spark, path) for name, path in tables.items()}
        last = self._manifest()
        number, old = last if last else (0, None)
        if old and not all(now.get(name, {}).get(f) == mark for name, files in old["files"].items() for f, mark in files.items()):
            old = None
        fresh = {name: [f for f in files if not old or f not in old["files"].get(name, {})] for name, files in now.items()}
        self.read_files = sum(map(len, fresh.values()))
        self.rows = old["rows"] if old else 0
        if old and not self.read_files:
            return self._state(old["state"])

        def added(name: str) -> DataFrame | None:
            whole = not old and bool(now[name])
            return self.spark.read.parquet(tables[name]) if whole else self.spark.read.parquet(*fresh[name]) if fresh[name] else None

        parts = [self.spark.createDataFrame([], STATE_SCHEMA), *deltas(added)] + ([self._state(old["state"])] if old else [])
        _, table, seen = materialize_with(merge_state(*parts), "", f"{self.path}/state/{{}}", rows=F.sum("referencias"))
        self.rows = seen["rows"] or 0
        if write_text(self.spark, self._at(number + 1), json.dumps({"state": table, "files": now, "rows": self.rows})) and path_exists(self.spark, self._at(number - 1)):
            # The state before this one may still be read; the one before that is no longer needed.
            release(self.spark, json.loads(read_text(self.spark, self._at(number - 1)))["state"], self._at(number - 1))
        return self._state(table)

    def _at(self, number: int) -> str:
        return f"{self.path}/manifest/{number:012d}"

    def _state(self, table: str) -> DataFrame:
        return self.spark.read.schema(STATE_SCHEMA).parquet(table)


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys with references that something is wrong with: (destino, clave, referencias, clase, alta_min).

    clase is ``baja`` for a withdrawn key, ``ausente`` for one never stored, and
    ``tardia`` for one stored after its first reference.
    """
    signed = F.when(F.col("bajas") > 0, F.lit(0)).otherwise(F.col("existencias"))
    clase = F.when(F.col("bajas") > 0, F.lit("baja")).when(signed <= 0, F.lit("ausente")).when(F.col("alta_min") > F.col("ref_min"), F.lit("tardia"))
    return state.where(F.col("referencias") > 0).withColumn("clase", clase).where(F.col("clase").isNotNull()).select(*STATE, "referencias", "clase", "alta_min")


def classify_references(refs: DataFrame, state: DataFrame, rows: int | None = None) -> DataFrame:
    """(tabla, campo, seq, periodo, clase, destino, id): the rows of ``refs`` whose target is missing, withdrawn or late.

    ``state`` is that of all ``refs``, so its counts say which keys are hot;
    it is read several times and should be a stored table.  ``rows``, about
    how many references there are, saves adding them up.
    """
    rows = rows if rows is not None else state.agg(F.sum("referencias")).first()[0] or 0
    counts = state.where(F.col("referencias") > 0).select(*STATE, F.col("referencias").alias("_n"))
    hit = salted_lookup(refs, orphan_keys(state).drop("referencias"), STATE, rows, counts=counts)
    return hit.where((F.col("clase") != "tardia") | (F.col("alta_min") > F.col("seq"))).select("tabla", "campo", "seq", "periodo", "clase", "destino", key_text(F.col("clave")).alias("id"))
