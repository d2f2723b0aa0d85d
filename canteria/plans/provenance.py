"""The provenance queries over the projected tables, each with its SQL."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical, text
from ..operators import claims
from ..operators.skew import salted_lookup
from ..session import materialize, materialize_with, new_path, read, release, shuffle_partitions
from ..sources import emission, fetching, grains
from ..sources.store import LOG_NAME, EventStore, read_log
from .found import REFERENCES
from .projection import COLUMNS, KINDS, parse_log, rebuild


def _first(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    return claims.first_write_wins(read(spark, d, table, "id", "seq", *columns))


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Hashes that two of the machines stored."""
    return read(spark, d, "version", "content_hash", "equipo").where(F.col("equipo").isin("nube-a", "mx-nodo-1")).select("content_hash").where(F.col("content_hash").isNotNull()).distinct()


def current_version(spark: SparkSession, d: str) -> DataFrame:
    return claims.current_version(_first(spark, d, "version", "referente_id", "content_hash", "capture_ts")).select("referente_id", "id", "content_hash", "capture_ts")


def first_write_wins(spark: SparkSession, d: str) -> DataFrame:
    return _first(spark, d, "version", "referente_id", "content_hash", "capture_ts", "q_id")


def first_capture(spark: SparkSession, d: str) -> DataFrame:
    return claims.first_capture(read(spark, d, "version", "referente_id", "capture_ts", "seq"))


def orphans(spark: SparkSession, d: str) -> DataFrame:
    return claims.orphans(_first(spark, d, "afirmacion", "txt", "ref_id", "insc_id"))


def unsafe_claims(spark: SparkSession, d: str) -> DataFrame:
    return claims.unsafe_claims(_first(spark, d, "afirmacion", "ref_id", "estatus"), _first(spark, d, "version", "content_hash"), _snapshots(spark, d))


def trace_up(spark: SparkSession, d: str) -> DataFrame:
    return claims.trace_up(
        _first(spark, d, "afirmacion", "txt", "insc_id", "ref_id"),
        _first(spark, d, "inscripcion", "conclusion", "inferidor_model", "inferidor_ts", "huella"),
        _first(spark, d, "version", "referente_id", "content_hash", "url_cruda", "capture_ts", "q_id"),
        _first(spark, d, "consulta", "formulacion", "nec_id"),
        _first(spark, d, "necesidad", "pregunta", "gatillo", "origen_nodo"),
    )


def pinned_versions(spark: SparkSession, d: str) -> DataFrame:
    return claims.pinned_versions(_first(spark, d, "afirmacion", "ref_id"), _first(spark, d, "version", "content_hash", "capture_ts"))


def load_bearing(spark: SparkSession, d: str) -> DataFrame:
    return claims.load_bearing(_first(spark, d, "version", "referente_id"), read(spark, d, "afirmacion", "ref_id")).select("id", "referente_id", "load_bearing")


def missing_events(spark: SparkSession, d: str) -> DataFrame:
    wanted = read(spark, d, "afirmacion", "insc_id", "seq").where(F.col("insc_id").isNotNull()).select(F.col("insc_id").alias("id"), "seq")
    return claims.missing_events(wanted, read(spark, d, "inscripcion", "id"))


def missing_log_events(spark: SparkSession, d: str) -> DataFrame:
    """Ids that stored rows name, of whatever kind, and the log has no event of."""
    wanted = [read(spark, d, t, c, "seq").where(F.col(c).isNotNull()).select(F.lit(t).alias("tabla"), F.lit(c).alias("campo"), F.col(c).alias("id"), "seq") for t, c, _ in REFERENCES]
    there = [read(spark, d, table, "id") for table, _, _ in KINDS.values()]
    return claims.missing_events(reduce(DataFrame.unionByName, wanted), reduce(DataFrame.unionByName, there))


def consumption_state(spark: SparkSession, d: str) -> DataFrame:
    derived = read(spark, d, "version", "id", "q_id")
    used = read(spark, d, "afirmacion", "ref_id").select(F.col("ref_id").alias("id"))
    return claims.consumption_state(derived, used, "q_id")


def consumption_gate(spark: SparkSession, d: str) -> DataFrame:
    s = consumption_state(spark, d)
    done = F.col("estado") == "CONSUMIDO"
    return s.agg(F.count_if(done).alias("consumidos"), F.count_if(~done).alias("pendientes"), F.coalesce(F.bool_and(done), F.lit(True)).alias("todos"))


def divergence(spark: SparkSession, d: str) -> DataFrame:
    """Words each later reading of the same inputs shares with the first one."""
    rows = read(spark, d, "inscripcion", "seq", "huella", "conclusion").where(F.col("huella").isNotNull())
    first = rows.groupBy("huella").agg(F.min_by("conclusion", "seq").alias("base"), F.min("seq").alias("primera"), F.count(F.lit(1)).alias("_n"))
    first, _, seen = materialize_with(first, "first", rows=F.sum("_n"))
    pairs = salted_lookup(rows, first.drop("_n"), ["huella"], seen["rows"] or 0, counts=first.select("huella", "_n"))
    pairs = pairs.where((F.col("seq") > F.col("primera")) & F.col("base").isNotNull() & F.col("conclusion").isNotNull())
    common, both = claims.divergence_counts(F.col("base"), F.col("conclusion"))
    return pairs.select("seq", F.left("huella", F.lit(12)).alias("huella"), common.cast("long").alias("comunes"), both.cast("long").alias("todas"))


def divergence_rounded(spark: SparkSession, d: str) -> DataFrame:
    """The same as rounded shares, as Python rounds; no two words at all are alike."""
    alike = F.when(F.col("todas") == 0, F.lit(1.0)).otherwise(F.try_divide("comunes", "todas"))
    return divergence(spark, d).select("seq", "huella", canonical.round3(alike).alias("similitud"), canonical.round3(1 - alike).alias("divergencia"))


def preflight(spark: SparkSession, d: str) -> DataFrame:
    """References with a stand-in probe that goes by the first digit of the id."""
    v = claims.load_bearing(_first(spark, d, "version", "content_hash"), read(spark, d, "afirmacion", "ref_id"))
    digit = F.left("id", F.lit(1))
    probed = F.when(digit.isin("0", "1", "2", "3"), "DNS").when(digit.isin("4", "5"), "TIMEOUT").when(digit.isin("6", "7"), "HTTP").otherwise("OK")
    v = v.withColumn("estado", claims.probe_state(F.col("content_hash"), probed))
    return v.select("id", "load_bearing", "estado", claims.severity(F.col("estado"), F.col("load_bearing")).alias("severidad"))


def preflight_counts(spark: SparkSession, d: str) -> DataFrame:
    return preflight(spark, d).agg(
        F.count_if(F.col("severidad") == "BLOQUEANTE").alias("bloqueantes"), F.count_if(F.col("severidad") == "AVISO").alias("avisos"),
        F.count_if(F.col("estado") == "OK").alias("ok"), F.count_if(F.col("estado") == "YA").alias("ya"),
    )


def _new_store(spark: SparkSession) -> EventStore:
    """A store of this application in the folder all executors share."""
    root = new_path(spark, "store")
    return EventStore(root if "://" in root else root.removeprefix("file:"), clock=lambda: "2026-01-01T00:00:00")


def snapshot_store(spark: SparkSession, d: str) -> DataFrame:
    """The texts of all documents put into a store that has those in Spanish already, and what it then holds."""
    docs, store = read(spark, d, "documents", "text", "lang").where(F.col("text").isNotNull()), _new_store(spark)
    content = F.col("text").cast("binary").alias("content")
    materialize(store.put_snapshots(docs.where(F.col("lang") == "es").select(content)), "put")
    put, _ = materialize(store.put_snapshots(docs.select(content)), "put")
    held = store.snapshot_contents(spark).select("content_hash", F.length("content").cast("long").alias("bytes"))
    return held.join(put, "content_hash")


def store_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The events ingesting all grains adds to a new store, appended by all tasks and read back from its log."""
    store = _new_store(spark)
    rows, at = materialize(grains.examined(_grains(spark, d), GRAIN_ROOT, json.loads), "examined")
    store.append_frame(grains.fresh_events(rows, store.log_ids(spark)), "path", "pos")
    release(spark, at)
    return parse_log(store.log(spark)).select("id", "ev", "ts", "nec_id", "formulacion", "referente_id", "content_hash", "q_id")


class _Hashes:
    """A stand-in for the snapshots of a store: names bytes and keeps nothing."""

    def put_snapshot(self, data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()


def _stand_in_fetch(url: str | None) -> bytes:
    """A fetch that goes by the hash of the URL and gives its text."""
    if not url or hashlib.sha256(url.encode()).hexdigest()[0] in "0123":
        raise OSError("down" if url else "no URL")
    return url.encode()


def materialize_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every version's reference when the pending ones are fetched, by a stand-in."""
    v = claims.load_bearing(_first(spark, d, "version", "content_hash", "url_cruda"), read(spark, d, "afirmacion", "ref_id"))
    refs = v.select(F.lit(0).alias("place"), F.col("id").alias("local_id"), F.col("url_cruda").alias("url"), "content_hash", "load_bearing")
    out = fetching.materialize(refs, _Hashes(), _stand_in_fetch, clock=lambda: "2026-01-01T00:00:00")
    return out.select(F.col("local_id").alias("id"), "load_bearing", "estado", "content_hash", "capture_ts", "bytes", "error")


def materialize_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same counted by outcome."""
    return materialize_outcomes(spark, d).groupBy("estado", "load_bearing").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def reinferred(spark: SparkSession, d: str) -> DataFrame:
    """Every inference read again by a stand-in that concludes what was premised, and how far that lies from what was concluded."""
    rows = read(spark, d, "inscripcion", "seq", "premisa", "busqueda", "resultados_crudos", "conclusion", "inferidor_model", "inferidor_ts", "huella")
    again = emission.reinfer(rows.withColumn("antes", F.col("conclusion")), lambda premise, searches, results: premise, "model-b", "2026-01-01T00:00:00")
    common, both = claims.divergence_counts(F.col("antes"), F.col("conclusion"))
    return again.select("seq", "huella", "conclusion", text.signature(F.col("inferidor_model"), F.col("inferidor_ts")).alias("firma"), common.cast("long").alias("comunes"), both.cast("long").alias("todas"))


def snapshot_dedup(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents", "text").where(F.col("text").isNotNull()).select(text.content_hash(F.col("text")).alias("content_hash")).distinct()


def _lines(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "consulta", "id", "nec_id", "formulacion", "ts")
    event = F.to_json(F.struct(F.lit("consulta").alias("ev"), "id", "nec_id", "formulacion", "ts"), {"ignoreNullFields": "false"})
    line = canonical.canonical_line(event)
    return c.select("ts", line.alias("event")).select("ts", canonical.line_sha(F.col("event")).alias("line_sha"), "event")


def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    """(seq, line_sha, event) of every stored log row, of all six kinds; equipo is no field of an event."""
    parts = []
    for kind, (table, mandatory, optional) in KINDS.items():
        fields = ["id", *(m.rstrip("*") for m in mandatory), *optional, "ts"]
        event = F.to_json(F.struct(F.lit(kind).alias("ev"), *fields), {"ignoreNullFields": "false"})
        line = canonical.event_line(event, *(m.rstrip("*") for m in mandatory if m.endswith("*")))
        parts.append(read(spark, d, table, "seq", *fields).select("seq", line.alias("event")))
    return reduce(DataFrame.unionByName, parts).select("seq", canonical.line_sha(F.col("event")).alias("line_sha"), "event")


def export_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the queries alone; :func:`export_log_lines` has those of all kinds."""
    return _lines(spark, d).select("line_sha", "event")


def export_upsert(spark: SparkSession, d: str) -> DataFrame:
    """What an export adds where the events up to the end of 2023 are already there."""
    lines, _ = materialize(_lines(spark, d), "lines")
    return claims.upsert_new(lines.select("line_sha", "event"), lines.where(F.col("ts") < "2024").select("line_sha")).select("line_sha")


def export_log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of the log, repeats kept."""
    return _log_lines(spark, d).select("line_sha", "event")


def export_log_upsert(spark: SparkSession, d: str) -> DataFrame:
    """What an export of the whole log adds where its first half, by place, is already there."""
    lines, _ = materialize(_log_lines(spark, d), "lines")
    half = (lines.agg(F.max("seq")).first()[0] or 0) // 2
    return claims.upsert_new(lines.select("line_sha", "event"), lines.where(F.col("seq") <= half).select("line_sha"))


def _stored_log(spark: SparkSession, d: str) -> str:
    """The log tables as a log of JSON lines in log order: part files whose names sort as their lines do."""
    lines, path = _log_lines(spark, d).select("seq", "event"), new_path(spark, "log")
    lines.repartitionByRange(shuffle_partitions(spark), "seq").sortWithinPartitions("seq").select("event").write.text(f"{path}/log/{LOG_NAME}")
    return f"{path}/log/{LOG_NAME}"


def log_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines and distinct ids of each kind, by reading the log itself."""
    log = read_log(spark, _stored_log(spark, d)).select(F.get_json_object("linea", "$.ev").alias("ev"), F.get_json_object("linea", "$.id").alias("id"))
    ids = log.groupBy("ev", "id").agg(F.count(F.lit(1)).alias("n"))
    return ids.groupBy("ev").agg(F.sum("n").alias("lineas"), F.count("id").alias("ids"))


def rebuild_dump(spark: SparkSession, d: str) -> DataFrame:
    """The seven tables rebuilt from the log itself; without the two JSON columns, whose canonical form SQL cannot state."""
    tables = rebuild(read_log(spark, _stored_log(spark, d)))
    return claims.dump({t: df.drop("busqueda", "resultados_crudos") for t, df in tables.items()})


#: The key the documents made from the table grano stand under.
GRAIN_ROOT = "grano"


def _grains(spark: SparkSession, d: str) -> DataFrame:
    """(path, texto): each row of grano as a document in JSON, its seq as the path; consultas as it is stored, null and '' for none."""
    g = read(spark, d, "grano", "seq", "session_id", "schema_version", "consolidado_por", "project", "consultas")
    meta = F.to_json(F.struct("session_id", "schema_version", "consolidado_por", "project"))
    tree = F.coalesce(F.nullif("consultas", F.lit("")), F.lit("[]"))
    return g.select(F.lpad(F.col("seq").cast("string"), 20, "0").alias("path"), F.concat(F.lit(f'{{"{GRAIN_ROOT}": {{"meta": '), meta, F.lit(', "consultas": '), tree, F.lit("}}")).alias("texto"))


def _grain_events(spark: SparkSession, d: str) -> DataFrame:
    return grains.derived_events(_grains(spark, d), GRAIN_ROOT, json.loads)


def grain_events(spark: SparkSession, d: str) -> DataFrame:
    """The events every stored grain gives, with deterministic ids; a tree that is none of a document gives none."""
    return _grain_events(spark, d).where(F.col("id").isNotNull()).select(F.col("path").cast("long").alias("seq"), "pos", "id", "ev")


def grain_lint(spark: SparkSession, d: str) -> DataFrame:
    """What stands against each grain, counted by rule."""
    found = grains.lint(_grains(spark, d), _snapshots(spark, d), GRAIN_ROOT, json.loads)
    return found.groupBy(F.col("path").cast("long").alias("seq"), "regla").agg(F.count(F.lit(1)).alias("n"))


def _grains_and_log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The events of all grains, and as the log's ids those of the grains up to the end of 2023."""
    events, _ = materialize(_grain_events(spark, d), "grains")
    early = read(spark, d, "grano", "seq", "ts").where(F.col("ts") < "2024").select(F.lpad(F.col("seq").cast("string"), 20, "0").alias("path"))
    return events, events.join(early, "path", "left_semi").select("id")


def grain_states(spark: SparkSession, d: str) -> DataFrame:
    """How much of each grain the log has."""
    return grains.states_of(*_grains_and_log(spark, d)).select(F.col("path").cast("long").alias("seq"), "session_id", "estado", "total", "presentes")


def grain_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The events ingesting all grains would add to that log, each id once, from the first grain that has it."""
    return grains.fresh_events(*_grains_and_log(spark, d)).select("id", "ev", F.col("path").cast("long").alias("seq"), "pos")


def _claim_document(text: str) -> dict:
    """One claim with what it names, as a document: its inference, its reference under its query, and the need."""
    r = json.loads(text)

    def tree(value: str | None) -> object:
        try:
            return json.loads(value) if value is not None else None
        except ValueError:
            return value

    inference = {"local_id": r.get("insc"), "premisa": r.get("premisa"), "busqueda": tree(r.get("busqueda")), "resultados_crudos": tree(r.get("resultados_crudos"))}
    reference = {"local_id": r.get("ref"), "content_hash": r.get("content_hash"), "capture_ts": r.get("capture_ts")}
    return {
        GRAIN_ROOT: {
            "meta": {"schema_version": "aec-1"}, "necesidad": {"pregunta": r.get("pregunta"), "gatillo": r.get("gatillo")},
            "inscripciones": [inference] if r.get("insc") else [], "consultas": [{"referencias": [reference]}] if r.get("ref") else [],
            "afirmaciones": [{"txt": r.get("txt"), "survived_from": r.get("ref_id"), "inferida_por": r.get("insc_id")}],
        }
    }


def claim_lint(spark: SparkSession, d: str) -> DataFrame:
    """What stands against each stored claim with all it rests on, taken as a document of its own, counted by rule."""
    named = {"insc_id": F.nullif("insc_id", F.lit("")), "ref_id": F.nullif("ref_id", F.lit(""))}
    a = _first(spark, d, "afirmacion", "txt", "insc_id", "ref_id").where(F.col("id").isNotNull()).select("id", "txt", *[c.alias(k) for k, c in named.items()])
    i = _first(spark, d, "inscripcion", "premisa", "busqueda", "resultados_crudos").drop("seq").withColumnRenamed("id", "insc")
    v = _first(spark, d, "version", "content_hash", "capture_ts", "q_id").drop("seq").withColumnRenamed("id", "ref")
    q = _first(spark, d, "consulta", "nec_id").select(F.col("id").alias("q_id"), "nec_id")
    n = _first(spark, d, "necesidad", "pregunta", "gatillo").select(F.col("id").alias("nec_id"), "pregunta", "gatillo")
    origin = v.join(q, "q_id", "left").join(n, "nec_id", "left").drop("q_id", "nec_id")
    rows = a.join(i, F.col("insc_id") == F.col("insc"), "left").join(origin, F.col("ref_id") == F.col("ref"), "left")
    docs = rows.select(F.col("id").alias("path"), F.to_json(F.struct(*[c for c in rows.columns if c != "id"])).alias("texto"))
    return grains.lint(docs, _snapshots(spark, d), GRAIN_ROOT, _claim_document).groupBy(F.col("path").alias("id"), "regla").agg(F.count(F.lit(1)).alias("n"))


def lint_inferences(spark: SparkSession, d: str) -> DataFrame:
    """Premises that are blank or null, of every stored row."""
    return read(spark, d, "inscripcion", "seq", "premisa").select("seq", text.is_blank(F.col("premisa")).alias("sin_premisa"))


def lint_triplets(spark: SparkSession, d: str) -> DataFrame:
    """Does an inference have its premise, searches and results?  And who signed it."""
    c = read(spark, d, "inscripcion", "seq", "premisa", "busqueda", "resultados_crudos", "inferidor_model", "inferidor_ts")
    return c.select("seq", text.triplet_ok(F.col("premisa"), F.col("busqueda"), F.col("resultados_crudos")).alias("completa"), text.signature(F.col("inferidor_model"), F.col("inferidor_ts")).alias("firma"))


def lint_needs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "necesidad", "seq", "pregunta", "gatillo").select("seq", text.gatillo_ok(F.col("gatillo")).alias("gatillo_ok"), text.is_blank(F.col("pregunta")).alias("sin_pregunta"))


def lint_versions(spark: SparkSession, d: str) -> DataFrame:
    h = text.norm_hash(F.col("content_hash"))
    return read(spark, d, "version", "seq", "content_hash").select("seq", h.alias("hash"), text.is_pending(F.col("content_hash")).alias("pendiente"))


def lint_times(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "version", "seq", "capture_ts").select("seq", canonical.iso_ok(F.col("capture_ts")).alias("iso_ok"))


def lint_schema(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "grano", "seq", "schema_version", "session_id").select("seq", F.coalesce(F.col("schema_version") == "aec-1", F.lit(False)).alias("version_ok"), F.coalesce("session_id", F.lit("")).alias("session_id"))


def integrity(spark: SparkSession, d: str) -> DataFrame:
    """Does the stored fingerprint fit the three inputs?  Null where they are no JSON."""
    c = read(spark, d, "inscripcion", "seq", "premisa", "busqueda", "resultados_crudos", "huella")
    return c.select("seq", (canonical.huella(F.col("premisa"), F.col("busqueda"), F.col("resultados_crudos")) == F.col("huella")).alias("integra"))


def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "inscripcion", "seq", "busqueda", "resultados_crudos")
    return c.select("seq", canonical.canonical_line(F.col("busqueda")).alias("busqueda"), canonical.canonical_compact(F.col("resultados_crudos")).alias("resultados_crudos"))


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "version", "seq", "url_cruda").where(~text.is_blank(F.col("url_cruda"))).select("seq", text.canonical_url(F.col("url_cruda")).alias("url"))


def det_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "version", "seq", "referente_id", "content_hash", "capture_ts").select("seq", text.det_id(F.lit("ref"), F.col("referente_id"), text.norm_hash(F.col("content_hash")), F.col("capture_ts")).alias("det_id"))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


def assert_bag(spark: SparkSession, d: str) -> DataFrame:
    """Assertions as they are, repeats kept."""
    return read(spark, d, "referente_assert", "id", "referente_a", "referente_b", "relacion", "gatillo", "ts")


def log_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct ids of each log table."""
    out = None
    for t in ("version", "inscripcion", "necesidad", "consulta", "afirmacion", "referente_assert"):
        ids = read(spark, d, t, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        part = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("filas"), F.count("id").alias("ids")).select(F.lit(t).alias("tabla"), "filas", "ids")
        out = part if out is None else out.unionByName(part)
    return out


def dump_tables(spark: SparkSession, d: str) -> DataFrame:
    """The fixed lists alone; the store is dumped by :func:`dump_projection`."""
    return claims.dump({t: read(spark, d, t) for t in ("equipo", "envase", "mezcla")})


def dump_projection(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the seven projected tables, in order of table and row; JSON columns as they are stored."""
    tables = {t: _first(spark, d, t, *columns[1:]).select(*columns) for t, columns in COLUMNS.items() if columns[0] == "id" and t != "referente_assert"}
    tables["referente_assert"] = assert_bag(spark, d)
    tables["referente"] = first_capture(spark, d)
    return claims.dump(tables).orderBy("tabla", "fila")


QUERIES = (
    current_version, first_write_wins, first_capture, orphans, unsafe_claims, trace_up, pinned_versions, load_bearing, missing_events, consumption_state,
    consumption_gate, divergence, divergence_rounded, preflight, preflight_counts, snapshot_dedup, snapshot_store, store_ingest, export_lines, export_upsert, lint_inferences, lint_triplets, lint_needs,
    lint_versions, lint_times, lint_schema, integrity, canonical_json, canonical_urls, det_ids, content_hashes, assert_bag, log_counts, dump_tables,
    dump_projection, log_scan, rebuild_dump, grain_events, grain_lint, grain_states, grain_ingest, claim_lint, materialize_outcomes, materialize_counts, reinferred, export_log_lines, export_log_upsert, missing_log_events,
)
