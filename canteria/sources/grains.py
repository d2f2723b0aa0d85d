"""Source documents in YAML: read in parallel, one row each, then validated and turned into events set-wise."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import document
from ..operators.claims import missing_events, orphans
from ..plans.projection import rebuild, write_projection
from ..session import materialize, release
from .store import EventStore


class LintError(Exception):
    """A document that does not pass; nothing of it was stored."""


def load_yaml(text: str) -> object:
    import yaml

    return yaml.safe_load(text)


def read_grains(spark: SparkSession, folder: str) -> DataFrame:
    """(path, texto) of every .yaml and .yml file of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yaml,yml}").load(folder)
    return files.select("path", F.decode("content", "UTF-8").alias("texto"))


def one_document(spark: SparkSession, path: str, text: str) -> DataFrame:
    return spark.createDataFrame([(path, text)], "path string, texto string")


def _by_document(docs: DataFrame, one, schema: str, load=load_yaml) -> DataFrame:
    """``one(path, doc, error)`` gives rows for each document; one that cannot be read, or whose tree ``one`` cannot walk, has an error."""
    names = [x.split()[0] for x in schema.split(", ")]

    def rows_of(path: str, text: str) -> list[tuple]:
        try:
            return list(one(path, load(text), None))
        except Exception as e:
            return list(one(path, None, f"{type(e).__name__}: {e}"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([r for path, text in zip(f["path"], f["texto"]) for r in rows_of(path, text)], columns=names)

    return docs.select("path", "texto").mapInPandas(run, schema)


def _as_json(event_id: str, event: dict) -> str:
    return json.dumps({**event, "id": event_id}, ensure_ascii=False, sort_keys=True, default=str)


def derived_events(docs: DataFrame, root_key: str, load=load_yaml) -> DataFrame:
    """(path, session_id, pos, id, ev, evento, error): every event the documents give, in order of pos; evento is JSON.

    A document that gives none has one row with a null pos: with its error if
    it could not be read or its tree is none of a document.
    """

    def one(path: str, doc: object, error: str | None) -> list[tuple]:
        session = document.session_of(doc, root_key)
        pairs = document.derive_events(doc, root_key)
        rows = [(path, session, k, i, e["ev"], _as_json(i, e), None) for k, (i, e) in enumerate(pairs)]
        return rows or [(path, session, None, None, None, None, error)]

    rows = _by_document(docs, one, "path string, session_id string, pos double, id string, ev string, evento string, error string", load)
    return rows.withColumn("pos", F.col("pos").cast("int"))


def _standing(found: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The findings that stand: all but those whose hash is stored."""
    stored = snapshots.select(F.col("content_hash").alias("hash")).distinct().withColumn("_there", F.lit(True))
    return found.join(stored, "hash", "left").where(F.col("hash").isNull() | F.col("_there").isNull()).drop("_there")


def lint(docs: DataFrame, snapshots: DataFrame, root_key: str, load=load_yaml) -> DataFrame:
    """(path, pos, regla, mensaje): what stands against each document, in report order."""

    def one(path: str, doc: object, error: str | None) -> list[tuple]:
        if error:
            return [(path, 0, "YAML", error, None)]
        return [(path, k, *x) for k, x in enumerate(document.lint(doc, root_key))]

    found = _by_document(docs, one, "path string, pos int, regla string, mensaje string, hash string", load)
    return _standing(found, snapshots).select("path", "pos", "regla", "mensaje")


def examined(docs: DataFrame, root_key: str, load=load_yaml) -> DataFrame:
    """(path, pos, id, ev, evento, regla, hash): events and findings of every document from one parse; one that cannot become events has a finding."""

    def one(path: str, doc: object, error: str | None) -> list[tuple]:
        if error:
            return [(path, 0, None, None, None, "YAML", None)]
        found = [(path, k, None, None, None, rule, content) for k, (rule, _, content) in enumerate(document.lint(doc, root_key))]
        return found + [(path, k, i, e["ev"], _as_json(i, e), None, None) for k, (i, e) in enumerate(document.derive_events(doc, root_key))]

    return _by_document(docs, one, "path string, pos int, id string, ev string, evento string, regla string, hash string", load)


def states_of(events: DataFrame, log_ids: DataFrame) -> DataFrame:
    """(path, session_id, estado, total, presentes, faltantes, error) of every document of :func:`derived_events`; repeats count."""
    there = log_ids.select("id").where(F.col("id").isNotNull()).distinct().withColumn("_in", F.lit(True))
    real = F.col("id").isNotNull()
    gone = F.array_sort(F.collect_list(F.when(real & F.col("_in").isNull(), F.struct("pos", "id", "ev"))))  # bounded by one document
    rows = events.join(there, "id", "left").groupBy("path").agg(
        F.max("session_id").alias("session_id"), F.count("id").alias("total"), F.count("_in").alias("presentes"), gone.alias("faltantes"), F.max("error").alias("error")
    )
    state = F.when(F.col("error").isNotNull(), "ERROR").when(F.col("total") == 0, "VACIO").when(F.col("presentes") == 0, "NO-CONSUMIDO").when(F.col("presentes") == F.col("total"), "CONSUMIDO").otherwise("PARCIAL")
    return rows.select("path", "session_id", state.alias("estado"), "total", "presentes", "faltantes", "error")


def states(docs: DataFrame, log_ids: DataFrame, root_key: str) -> DataFrame:
    """The same from documents, each parsed once, in order of path."""
    return states_of(derived_events(docs, root_key), log_ids).orderBy("path")


def fresh_events(events: DataFrame, log_ids: DataFrame) -> DataFrame:
    """(path, pos, id, ev, evento): of events the first of each id, by path and place, that the log lacks."""
    first = events.where(F.col("id").isNotNull()).groupBy("id").agg(F.min_by(F.struct("path", "pos", "ev", "evento"), F.struct("path", "pos")).alias("e")).select("id", "e.*")
    return missing_events(first, log_ids).select("path", "pos", "id", "ev", "evento")


def _refused(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    return _standing(rows.where(F.col("regla").isNotNull()), snapshots).select("path").distinct()


def new_events(rows: DataFrame, log_ids: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What ingesting the documents of :func:`examined` that pass lint would add, each id once."""
    return fresh_events(rows.join(_refused(rows, snapshots), "path", "left_anti"), log_ids)


def ingest(docs: DataFrame, store: EventStore, root_key: str) -> dict[str, int]:
    """All documents into the log, by one parse, anti-joins and one append of all tasks: {documentos, rechazados, appended}.

    A document that does not pass adds nothing; doing it again adds nothing.
    """
    spark = docs.sparkSession
    rows, at = materialize(examined(docs, root_key), "examined")
    snapshots = store.snapshots(spark)
    refused = _refused(rows, snapshots).count()
    appended = store.append_frame(new_events(rows, store.log_ids(spark), snapshots), "path", "pos")
    release(spark, at)
    return {"documentos": docs.count(), "rechazados": refused, "appended": appended}


def ingest_file(spark: SparkSession, path: str, store: EventStore, root_key: str, db: str | None = None) -> dict:
    """One YAML document into the log, once: raises :class:`LintError` and stores nothing if it does not pass.

    The log is searched for the document's ids by Spark and never read by the
    driver.  With ``db`` the projection is rebuilt there and its orphans are
    counted.
    """
    with open(path, encoding="utf-8") as f:
        docs = one_document(spark, path, f.read())
    against = [f"{r.regla}: {r.mensaje}" for r in lint(docs, store.snapshots(spark), root_key).orderBy("pos").collect()]  # bounded by one document
    if against:
        raise LintError("; ".join(against))
    events = derived_events(docs, root_key)
    every = events.orderBy("pos").collect()
    fresh = [json.loads(r.evento) for r in fresh_events(events, store.log_ids(spark)).orderBy("pos").collect()]
    stored = store.append(fresh)
    done = {
        "session_id": every[0].session_id, "appended": len(stored), "noop": not stored,
        "afirmaciones": [r.id for r in every if r.ev == "afirmacion"], "necesidad": next((r.id for r in every if r.ev == "necesidad"), None),
    }
    if db:
        tables = rebuild(store.log(spark))
        write_projection(tables, db)
        done["huerfanos"] = orphans(tables["afirmacion"]).count()
    return done
