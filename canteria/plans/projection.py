"""The relational projection, rebuilt from the log: one parse, split by kind, and a plan over each part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_line
from ..operators.claims import first_capture, first_write_wins
from ..session import new_path

# The event kinds, and the fields of their tables; a * marks JSON kept in canonical line form.
KINDS = {
    "inscripcion": ("inscripcion", ["premisa", "busqueda*", "resultados_crudos*", "conclusion", "inferidor_model", "inferidor_ts", "huella"], []),
    "necesidad": ("necesidad", ["pregunta", "gatillo"], ["origen_nodo"]),
    "consulta": ("consulta", ["nec_id", "formulacion"], []),
    "referencia": ("version", ["referente_id", "content_hash", "url_cruda", "capture_ts", "fecha_fuente", "q_id"], []),
    "afirmacion": ("afirmacion", ["txt", "insc_id", "tipo", "estatus"], ["ref_id"]),
    "referente_assert": ("referente_assert", ["referente_a", "referente_b", "relacion", "gatillo"], []),
}
# The column order of the tables.
COLUMNS = {
    "inscripcion": ["id", "premisa", "busqueda", "resultados_crudos", "conclusion", "inferidor_model", "inferidor_ts", "huella", "ts"],
    "necesidad": ["id", "pregunta", "gatillo", "origen_nodo", "ts"],
    "consulta": ["id", "nec_id", "formulacion", "ts"],
    "referente": ["referente_id", "primera_captura"],
    "version": ["id", "referente_id", "content_hash", "url_cruda", "capture_ts", "fecha_fuente", "q_id", "ts"],
    "afirmacion": ["id", "txt", "insc_id", "ref_id", "tipo", "estatus", "ts"],
    "referente_assert": ["id", "referente_a", "referente_b", "relacion", "gatillo", "ts"],
}


def _fields(kind: str) -> tuple[list[str], list[str], set[str]]:
    """Mandatory and other fields of a kind, and those that hold JSON."""
    _, mandatory, optional = KINDS[kind]
    return ["id", *(m.rstrip("*") for m in mandatory)], [*optional, "ts"], {m.rstrip("*") for m in mandatory if m.endswith("*")}


FIELDS = sorted({f for kind in KINDS for part in _fields(kind)[:2] for f in part})


def _cell(field: str) -> Column:
    """A field as text; a boolean is 1 or 0, as in a column of text affinity, but the words true and false stay."""
    value = F.col(f"e.{field}")
    is_flag = F.schema_of_variant(F.try_variant_get(F.try_parse_json("linea"), f"$.{field}", "variant")) == "BOOLEAN"
    return F.when(value.isin("true", "false") & is_flag, F.when(value == "true", F.lit("1")).otherwise(F.lit("0"))).otherwise(value)


def parse_log(log: DataFrame, strict: bool = True) -> DataFrame:
    """(seq, ev and every field of any kind) of the events of known kinds in a log (seq, linea): one JSON parse a line.

    ``strict`` makes a missing mandatory field an error that names the event;
    one that is there and null is none.
    """
    schema = ", ".join(f"`{f}` string" for f in ("ev", *FIELDS))
    rows = log.select("seq", "linea", F.from_json("linea", schema, {"allowSingleQuotes": "false"}).alias("e")).where(F.col("e.ev").isin(*KINDS))
    ev = F.col("e.ev")
    if strict:
        names = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.array(*map(F.lit, _fields(k)[0])))])[ev]
        some_null = reduce(lambda a, b: a | b, [(ev == k) & reduce(lambda a, b: a | b, [F.col(f"e.{n}").isNull() for n in _fields(k)[0]]) for k in KINDS])
        lacking = F.array_except(names, F.json_object_keys("linea"))
        ev = F.when(some_null & (F.size(lacking) > 0), F.raise_error(F.concat(ev, F.lit(" lacks "), F.array_join(lacking, ", "), F.lit(" at "), F.to_json("seq")))).otherwise(ev)
    return rows.select("seq", ev.alias("ev"), *[_cell(f).alias(f) for f in FIELDS])


def rebuild(log: DataFrame, strict: bool = True) -> dict[str, DataFrame]:
    """The seven tables from a log (seq, linea); the same log gives the same tables.

    The log is read and parsed once, into a stored table split by kind.
    Unknown kinds are skipped.  The first write of an id wins, rows with a
    null id are all kept, assertions are a bag.  ``strict``: see
    :func:`parse_log`.
    """
    spark = log.sparkSession
    parsed, path = parse_log(log, strict), new_path(spark, "events")
    parsed.write.partitionBy("ev").option("compression", "zstd").parquet(path)
    events = spark.read.schema(parsed.schema).parquet(path)
    out: dict[str, DataFrame] = {}
    for kind in KINDS:
        mandatory, optional, nested = _fields(kind)
        cells = [(F.coalesce(canonical_line(F.col(f)), F.col(f)) if f in nested else F.col(f)).alias(f) for f in (*mandatory, *optional)]
        out[KINDS[kind][0]] = events.where(F.col("ev") == kind).select("seq", *cells)
    referente = first_capture(out["version"]).select(*COLUMNS["referente"])
    tables = {t: (df if t == "referente_assert" else first_write_wins(df)).select(*COLUMNS[t]) for t, df in out.items()}
    return tables | {"referente": referente}


def write_projection(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under ``path``, replacing what was there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
