"""The pN_ queries of the general problems 1 to 5."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PENDING, canonical_url, is_blank, key_bytes, key_text, norm_hash, py_strip
from ..operators import flatten, groups, history, instants, references
from ..session import kept_path, read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored timestamp of three fields that denotes an instant, in UTC."""
    equipo = read(spark, sf_dir, "equipo")
    rows = instants.written_values(read(spark, sf_dir, "version", "seq", "equipo", "capture_ts"), "version", ["capture_ts"], equipo)
    more = instants.written_values(read(spark, sf_dir, "inscripcion", "seq", "equipo", "inferidor_ts", "ts"), "inscripcion", ["inferidor_ts", "ts"], equipo)
    return instants.normalise_instants(rows.unionByName(more))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of referents that are one document."""
    links = groups.decided_links(read(spark, sf_dir, "referente_assert", "seq", "referente_a", "referente_b", "relacion"))
    return groups.connected_groups(links).withColumnRenamed("miembro", "referente")


# Which table each reference field points to.
REFERENCES = (("afirmacion", "ref_id", "version"), ("afirmacion", "insc_id", "inscripcion"), ("consulta", "nec_id", "necesidad"), ("version", "q_id", "consulta"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [references.reference_rows(read(spark, sf_dir, t, "seq", c, "ts"), t, c, to) for t, c, to in REFERENCES]
    return reduce(DataFrame.unionByName, rows)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references with their class, by the kept counts of a folder of tables, brought up to date with what its files have gained."""
    targets = [to for _, _, to in REFERENCES]
    tables = sorted({t for t, _, _ in REFERENCES} | set(targets))

    def deltas(added: Callable[[str], DataFrame | None]) -> list[DataFrame]:
        out = [references.reference_deltas(references.reference_rows(rows, t, c, to)) for t, c, to in REFERENCES if (rows := added(t)) is not None]
        out += [references.existence_deltas(rows, to) for to in targets if (rows := added(to)) is not None]
        return out + [references.withdrawal_deltas(rows, targets) for rows in [added("baja")] if rows is not None]

    name = f"references/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    kept = references.KeptState(spark, kept_path(spark, name))
    state = kept.update({t: f"{sf_dir}/{t}.parquet" for t in (*tables, "baja")}, deltas)
    return references.classify_references(_references(spark, sf_dir), state, kept.rows)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored reference whose target is missing, withdrawn or only arrived later."""
    return _classified(spark, sf_dir).select("tabla", "campo", "seq", "periodo", "clase")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by table, field and month: rows and distinct ids of each class."""
    rows = _classified(spark, sf_dir)
    return rows.groupBy("tabla", "campo", "periodo", "clase", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("tabla", "campo", "periodo", "clase").agg(F.sum("n").alias("filas"), F.count(F.lit(1)).alias("ids"))


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(referente_id, content_hash, utc_us, seq): the counting row of each version id, normalised; content as key bytes, null where there is none."""
    equipo = read(spark, sf_dir, "equipo")
    dictionary = instants.InstantDictionary(spark)
    counts, total = dictionary.extend(instants.written_values(read(spark, sf_dir, "version", "seq", "equipo", "capture_ts"), "version", ["capture_ts"], equipo))
    rows = read(spark, sf_dir, "version", "id", "seq", "referente_id", "content_hash", "capture_ts", "equipo")
    content = F.lower(norm_hash(F.col("content_hash")))
    rows = rows.select(
        F.coalesce(key_bytes(F.col("id")), F.concat(F.lit(b"\x02"), F.col("seq").cast("string").cast("binary"))).alias("clave"),
        "seq",
        F.when(~is_blank(F.col("referente_id")), canonical_url(F.col("referente_id"))).alias("referente_id"),
        F.when(~is_blank(content) & (py_strip(F.col("content_hash")) != PENDING), key_bytes(content)).alias("content_hash"),
        py_strip(F.col("capture_ts")).alias("raw"), "equipo",
    )
    first = rows.groupBy("clave").agg(F.min_by(F.struct("referente_id", "content_hash", "raw", "equipo"), "seq").alias("v"), F.min("seq").alias("seq")).select("v.*", "seq")
    first = instants.with_machine(first.where(F.col("referente_id").isNotNull()), equipo)
    return dictionary.attach(first, counts, total).select("referente_id", "content_hash", "utc_us", "seq")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each referent's contents with the periods in which they held."""
    periods = history.coalesce_history(_captures(spark, sf_dir), "referente_id", "content_hash", "utc_us", "seq")
    return periods.withColumn("content_hash", key_text(F.col("content_hash")))


# The arrays of the three JSON columns.
JSON_LEVELS = (
    ("inscripcion", "busqueda", flatten.Level("busqueda")),
    ("inscripcion", "resultados_crudos", flatten.Level("resultado", "fuente", {"citas": flatten.Level("cita", "txt", {"notas": flatten.Level("nota")})})),
    ("grano", "consultas", flatten.Level("consulta", "formulacion", {"referencias": flatten.Level("referencia", "url", {"intentos": flatten.Level("intento", "estado")})})),
)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested JSON of three columns as flat rows."""
    return reduce(DataFrame.unionByName, [flatten.flatten_json(read(spark, sf_dir, t, "seq", c), c, level) for t, c, level in JSON_LEVELS])
