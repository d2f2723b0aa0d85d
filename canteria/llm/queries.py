"""Queries of the llm problems 6 to 8.  SQL can express none of them; the tests hold them against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize, read, shipped
from . import mixing, packing, sentences, tokens


def _lengths(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Texts are tokenized once; what follows reads the stored lengths."""
    return materialize(tokens.with_lengths(read(spark, sf_dir, "documents"), *keep), "lengths")[0]


def _containers(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    return [(r["envase"], r["capacidad"]) for r in read(spark, sf_dir, "envase", "envase", "capacidad").orderBy("envase").collect()]


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in containers of each capacity."""
    return packing.pack(_lengths(spark, sf_dir, "doc_id"), _containers(spark, sf_dir))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and space left over, for each capacity."""
    return packing.packing_report(p6_packing(spark, sf_dir), _containers(spark, sf_dir))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture as large as the corpus; sources too small for their share are used as often as allowed."""
    return mixing.mix(_lengths(spark, sf_dir, "source", "doc_id"), mixing.weights_of(read(spark, sf_dir, "mezcla")))


def p7_mixture_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mixture in which every source that has texts holds exactly its share."""
    return mixing.mix(_lengths(spark, sf_dir, "source", "doc_id"), mixing.weights_of(read(spark, sf_dir, "mezcla")), strict=True)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source in p7_mixture."""
    return mixing.shares(p7_mixture(spark, sf_dir), read(spark, sf_dir, "mezcla"))


def p7_shares_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source in p7_mixture_strict."""
    return mixing.shares(p7_mixture_strict(spark, sf_dir), read(spark, sf_dir, "mezcla"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every document."""
    return sentences.sentences(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: shipped(f) for f in (p6_packing, p6_report, p7_mixture, p7_mixture_strict, p7_shares, p7_shares_strict, p8_found)}


def oracle_sql() -> dict[str, str]:
    return {}
