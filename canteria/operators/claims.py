"""Relational operators on claims, versions and the log: each takes and gives DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE_CLASS, is_pending, signature

UNSAFE_STATUS = "afirmado"


def first_write_wins(df: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The first row of each key in log order; rows with a null key are all kept.

    A partial aggregate keeps one row per key before the shuffle, so a key
    with any number of repeats costs one row per task.
    """
    value = F.struct(*[F.col(c) for c in df.columns if c != key])
    group = F.when(F.col(key).isNull(), F.struct(F.lit(None).cast(df.schema[key].dataType).alias("k"), F.col(order).alias("o"))).otherwise(F.struct(F.col(key).alias("k"), F.lit(None).cast(df.schema[order].dataType).alias("o")))
    first = df.groupBy(group.alias("_g")).agg(F.min_by(value, order).alias("_v"))
    return first.select(*[F.col("_g.k").alias(c) if c == key else F.col(f"_v.{c}").alias(c) for c in df.columns])


def current_version(versions: DataFrame, key: str = "referente_id", latest: tuple[str, ...] = ("capture_ts", "id")) -> DataFrame:
    """The last version of each referent by text order of ``latest``; a null sorts before any text.

    Texts are compared as texts.  A top-1 by aggregation, not by a window: the
    versions of one referent are never brought into one task.
    """
    rank = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in latest])
    top = versions.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in versions.columns if c != key]), rank).alias("_v"))
    return top.select(*[F.col(c) if c == key else F.col(f"_v.{c}").alias(c) for c in versions.columns])


def first_capture(versions: DataFrame, key: str = "referente_id", capture: str = "capture_ts", order: str = "seq") -> DataFrame:
    """(key, primera_captura): the least capture in text order; null stays null where the first event had none."""
    g = versions.groupBy(key).agg(F.min_by(F.struct(F.col(capture)), order).alias("_first"), F.min(capture).alias("_least"))
    return g.select(key, F.when(F.col(f"_first.{capture}").isNotNull(), F.col("_least")).alias("primera_captura"))


def orphans(claims: DataFrame) -> DataFrame:
    """Claims without a reference or without an inference; a dangling or empty id is not null and so no orphan."""
    return claims.where(F.col("ref_id").isNull() | F.col("insc_id").isNull()).select("id", "txt")


def unsafe_claims(claims: DataFrame, versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(aid): asserted claims whose version has no snapshot; the empty hash counts as present.

    Claims without a stored version are not reported.  ``snapshots`` has
    content_hash.  Plain equi-joins: the optimizer broadcasts a side only
    where its statistics say that it is small.
    """
    stated = claims.where(F.col("estatus") == UNSAFE_STATUS).select(F.col("id").alias("aid"), F.col("ref_id"))
    bare = versions.select("id", "content_hash").where(F.coalesce(F.col("content_hash"), F.lit("\x00")) != "").join(snapshots.select("content_hash").distinct(), "content_hash", "left_anti")
    return stated.join(bare.select(F.col("id").alias("ref_id")), "ref_id").select("aid")


def trace_up(claims: DataFrame, inferences: DataFrame, versions: DataFrame, queries: DataFrame, needs: DataFrame) -> DataFrame:
    """From every claim to the need that caused it, one row per claim.

    Left joins all the way; a missing step leaves its columns null.  A null
    model or time is written ``None`` in the signature.
    """
    i = inferences.select(F.col("id").alias("insc_id"), "conclusion", signature(F.col("inferidor_model"), F.col("inferidor_ts")).alias("inferida_por"), F.left("huella", F.lit(12)).alias("huella"))
    v = versions.select(F.col("id").alias("ref_id"), "referente_id", "content_hash", "url_cruda", "capture_ts", "q_id")
    q = queries.select(F.col("id").alias("q_id"), F.col("formulacion").alias("consulta"), "nec_id")
    n = needs.select(F.col("id").alias("nec_id"), "pregunta", "gatillo", F.col("origen_nodo").alias("ancla"))
    origin = v.join(q, "q_id", "left").join(n, "nec_id", "left").drop("q_id", "nec_id")
    a = claims.select("id", F.col("txt").alias("afirmacion"), F.nullif("insc_id", F.lit("")).alias("insc_id"), F.nullif("ref_id", F.lit("")).alias("ref_id"))
    return a.join(i, "insc_id", "left").join(origin, "ref_id", "left").drop("insc_id", "ref_id")


def pinned_versions(claims: DataFrame, versions: DataFrame) -> DataFrame:
    """Claims with the version they are pinned to."""
    return claims.select(F.col("id").alias("aid"), "ref_id").join(versions.select(F.col("id").alias("ref_id"), "content_hash", "capture_ts"), "ref_id")


def load_bearing(versions: DataFrame, claims: DataFrame) -> DataFrame:
    """Versions with a flag: does some claim survive from it?"""
    used = claims.where(F.col("ref_id").isNotNull() & (F.col("ref_id") != "")).select(F.col("ref_id").alias("id")).distinct().withColumn("load_bearing", F.lit(True))
    return versions.join(used, "id", "left").withColumn("load_bearing", F.coalesce("load_bearing", F.lit(False)))


def missing_events(derived: DataFrame, log_ids: DataFrame, key: str = "id") -> DataFrame:
    """Derived events whose id the log does not have; repeats inside ``derived`` stay."""
    return derived.join(log_ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def consumption_state(derived: DataFrame, log_ids: DataFrame, doc: str, key: str = "id") -> DataFrame:
    """(doc, total, presentes, estado) of every document in ``derived``, repeats counted."""
    seen = log_ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_in", F.lit(1))
    g = derived.join(seen, key, "left").groupBy(doc).agg(F.count(F.lit(1)).alias("total"), F.count("_in").alias("presentes"))
    return g.withColumn("estado", F.when(F.col("presentes") == 0, "NO-CONSUMIDO").when(F.col("presentes") == F.col("total"), "CONSUMIDO").otherwise("PARCIAL"))


def severity(state: Column, bears: Column) -> Column:
    """Of a probe that is not OK: blocking where a claim rests on the reference, else a notice."""
    return F.when(state.isin("OK", "YA"), F.lit(None).cast("string")).when(bears, F.lit("BLOQUEANTE")).otherwise(F.lit("AVISO"))


def probe_state(content_hash: Column, probed: Column) -> Column:
    """YA for what is not pending, else what the probe said."""
    return F.when(is_pending(content_hash), probed).otherwise(F.lit("YA"))


def upsert_new(lines: DataFrame, existing: DataFrame, key: str = "line_sha") -> DataFrame:
    """What an insert-if-absent adds: one row of each key that ``existing`` lacks."""
    return lines.dropDuplicates([key]).join(existing.select(key).distinct(), key, "left_anti")


def words(text: Column) -> Column:
    """Distinct lower-case words, split at every kind of white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), f"{SPACE_CLASS}+"), lambda x: x != ""))


def divergence_counts(a: Column, b: Column) -> tuple[Column, Column]:
    """Sizes of intersection and union of the words of two texts."""
    return F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))


def dump(tables: dict[str, DataFrame]) -> DataFrame:
    """All rows of all tables as (tabla, fila) with the row as a sorted JSON-like text; equal for equal contents."""
    parts = [df.select(F.lit(name).alias("tabla"), F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c) for c in sorted(df.columns)])).alias("fila")) for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)
