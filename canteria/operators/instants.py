"""Mixed timestamp notations and zones brought to one UTC instant.

The raw strings are deduplicated together with the zone and date order of the
machine that wrote them; each distinct value is parsed once, the result is
kept in a dictionary on shared storage that later batches only extend, and the
instants are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import PARSER_VERSION, to_utc_us
from ..functions.text import py_strip
from ..session import file_system, kept_path, materialize_with, path_exists, release
from .skew import salted_lookup

KEYS = ["raw", "zona", "orden"]
_SCHEMA = "raw string, zona string, orden string, utc_us long"


def machines(equipo: DataFrame) -> DataFrame:
    """(equipo, zona, orden_fecha) with one row per machine, the smallest where a key repeats."""
    return equipo.where(F.col("equipo").isNotNull()).groupBy("equipo").agg(F.min(F.struct("zona", "orden_fecha")).alias("m")).select("equipo", "m.zona", "m.orden_fecha")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = [b.column(b.schema.get_field_index(k)) for k in KEYS]
        us = [to_utc_us(r, z or None, o or None) for r, z, o in zip(*(c.to_pylist() for c in columns))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(us, pa.int64()), b.column(b.schema.get_field_index("_n"))], names=[*KEYS, "utc_us", "_n"])


class InstantDictionary:
    """Distinct (raw, zona, orden) values and the instants they denote.

    What a value denotes never changes, so the dictionary is never stale and
    is shared by all queries.  It is a Parquet folder on shared storage:
    ``path``, else the one ``spark.canteria.kept.dir`` names, which outlives
    the application, else one of this application.  :meth:`extend` parses only
    values the folder lacks and adds them as a batch of their own;
    :meth:`attach` joins the instants to rows.  Two writers at once may both
    add a value; it is read once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or kept_path(spark, f"instants-{PARSER_VERSION}")

    def _stored(self) -> DataFrame | None:
        return self.spark.read.schema(_SCHEMA).parquet(self.path).select(*KEYS, "utc_us") if path_exists(self.spark, self.path) else None

    def read(self) -> DataFrame | None:
        """(raw, zona, orden, utc_us), each value once; None while there is no dictionary."""
        stored = self._stored()
        return None if stored is None else stored.groupBy(*KEYS).agg(F.max("utc_us").alias("utc_us"))

    def extend(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """Add the values of ``rows`` (raw, zona, orden) that are not there yet; their counts (raw, zona, orden, _n) and about how many rows there are."""
        counts = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
        known, batch, total = self._stored(), f"{self.path}/lote={{}}", F.sum("_n")
        if known is None:  # all are new: one job counts, parses and stores them
            parsed, path, seen = materialize_with(counts.mapInArrow(_parse, f"{_SCHEMA}, _n long"), "", batch, rows=total)
            if not seen["rows"]:
                release(self.spark, path)
            return parsed.select(*KEYS, "_n"), seen["rows"] or 0
        counts, _, seen = materialize_with(counts, "values", rows=total)
        if seen["rows"]:
            fresh = counts.join(known.select(*KEYS), KEYS, "left_anti")
            _, path, added = materialize_with(fresh.mapInArrow(_parse, f"{_SCHEMA}, _n long"), "", batch, rows=total)
            if not added["rows"]:
                release(self.spark, path)
        return counts, seen["rows"] or 0

    def compact(self) -> None:
        """Rewrite the batches there are as one, while no result that reads them is still open."""
        fs, folder = file_system(self.spark, self.path)
        batches = [b.getPath().toString() for b in fs.listStatus(folder)] if fs.exists(folder) else []
        if len(batches) > 1:
            materialize_with(self.read(), "", f"{self.path}/lote={{}}")
            release(self.spark, *batches)

    def attach(self, rows: DataFrame, counts: DataFrame, total: int) -> DataFrame:
        """``rows`` with an instant, and their ``utc_us``; rows without one are left out.

        ``counts`` and ``total`` are those :meth:`extend` gave for ``rows`` or
        for more; values too many rows share are salted.
        """
        known = self.read()
        if known is None:
            return rows.withColumn("utc_us", F.lit(None).cast("long")).limit(0)
        return salted_lookup(rows, known.where(F.col("utc_us").isNotNull()), KEYS, total, counts=counts)


def with_machine(rows: DataFrame, equipo: DataFrame) -> DataFrame:
    """``rows`` with zona and orden of their machine in place of equipo; empty for a null or unknown one."""
    rows = rows.join(machines(equipo), "equipo", "left").drop("equipo")
    return rows.withColumn("zona", F.coalesce("zona", F.lit(""))).withColumn("orden", F.coalesce("orden_fecha", F.lit(""))).drop("orden_fecha")


def written_values(df: DataFrame, tabla: str, fields: list[str], equipo: DataFrame) -> DataFrame:
    """(tabla, campo, seq, raw, zona, orden): the stored non-blank values, trimmed.

    Null and blank values denote no instant and are left out here already; an
    unknown or null machine gives empty zona and orden.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("campo"), py_strip(F.col(f)).alias("raw")) for f in fields])).alias("p")
    rows = df.select("seq", "equipo", pairs).select("seq", "equipo", "p.campo", "p.raw").where(F.col("raw") != "")
    return with_machine(rows, equipo).select(F.lit(tabla).alias("tabla"), "campo", "seq", "raw", "zona", "orden")


def normalise_instants(rows: DataFrame, dictionary: InstantDictionary | None = None) -> DataFrame:
    """(tabla, campo, seq, utc_us) of every row of :func:`written_values` that denotes an instant."""
    dictionary = dictionary or InstantDictionary(rows.sparkSession)
    return dictionary.attach(rows, *dictionary.extend(rows)).select("tabla", "campo", "seq", "utc_us")
