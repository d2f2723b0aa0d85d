"""Plans stay as they should be: few exchanges, pruned scans, no cross joins, no row-at-a-time Python."""

import re

import pytest

from canteria.operators import claims
from canteria.plans import registry

QUERIES = registry.queries()


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def exchanges(df):
    return len(re.findall(r"^[^(\n]*\bExchange \(\d+\)", plan_of(df).split("\n\n(1)")[0], re.M))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_plain_udf(spark, data, name):
    plan = plan_of(QUERIES[name](spark, data))
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize(
    ("name", "most"),
    [("p4_found", 0), ("canonical_urls", 0), ("det_ids", 0), ("lint_versions", 0), ("integrity", 0), ("first_write_wins", 1), ("current_version", 2), ("orphans", 1), ("first_capture", 1)],
)
def test_shuffles(spark, data, name, most):
    assert exchanges(QUERIES[name](spark, data)) <= most


@pytest.mark.parametrize(
    ("name", "columns"),
    [("p4_found", {"seq", "busqueda", "resultados_crudos", "consultas"}), ("canonical_urls", {"seq", "url_cruda"}), ("first_capture", {"seq", "referente_id", "capture_ts"}), ("content_hashes", {"doc_id", "text"})],
)
def test_scans_read_only_what_is_needed(spark, data, name, columns):
    found = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES[name](spark, data)))
    assert found and {c.split(":")[0] for s in found for c in s.split(",")} <= columns


@pytest.mark.parametrize(
    ("query", "pushed"),
    [
        (lambda spark, d: claims.orphans(spark.read.parquet(f"{d}/afirmacion.parquet")), r"Or\(IsNull\(ref_id\),IsNull\(insc_id\)\)"),
        (lambda spark, d: claims.unsafe_claims(*(spark.read.parquet(f"{d}/{t}.parquet") for t in ("afirmacion", "version", "version"))), r"EqualTo\(estatus,afirmado\)"),
        (QUERIES["divergence"], r"IsNotNull\(huella\)"),
    ],
)
def test_filters_reach_the_scan(spark, data, query, pushed):
    assert re.search(rf"PushedFilters: \[[^\]]*{pushed}", plan_of(query(spark, data)))
