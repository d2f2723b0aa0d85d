"""Every query over tables without rows, and over rows of nulls, blanks and repeats with extra columns of clashing names."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__

QUERIES = __spark_entry__.queries()
CLASHING = ["raw", "clave", "destino", "ruta", "tipo_", "_n", "_k", "_salt", "utc_us", "entidad", "tokens", "lote", "parte", "grupo", "evento", "path"]


def _written(data, folder, change):
    for name in os.listdir(data):
        pq.write_table(change(pq.read_table(f"{data}/{name}"), name.removesuffix(".parquet")), folder / name)
    return str(folder)


@pytest.fixture(scope="module")
def empty(data, tmp_path_factory):
    return _written(data, tmp_path_factory.mktemp("empty"), lambda t, _: t.slice(0, 0))


def _hostile(table, name):
    """Rows of nulls, of '' and of white space, each twice, keys apart; with text columns whose names clash."""
    if name in ("equipo", "envase", "mezcla"):
        return table
    columns = {}
    for f in table.schema:
        if f.name in ("seq", "doc_id"):
            columns[f.name] = pa.array(range(6), f.type)
        elif pa.types.is_string(f.type):
            columns[f.name] = pa.array([None, None, "", "", " \t \n", " \t \n"], f.type)
        else:
            columns[f.name] = pa.nulls(6, f.type)
    columns |= {c: pa.array(["x"] * 6) for c in CLASHING if c not in columns}
    return pa.table(columns)


@pytest.fixture(scope="module")
def hostile(data, tmp_path_factory):
    return _written(data, tmp_path_factory.mktemp("hostile"), _hostile)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert len(rows) <= 10  # counts of nothing, at most


EXPECTED = {"p1_found": 0, "p2_found": 0, "p3_found": 0, "p4_found": 0, "p5_found": 0, "p8_found": 0, "p6_packing": 18, "p7_mixture": 0}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_hostile_rows(spark, hostile, name):
    rows = QUERIES[name](spark, hostile).collect()
    assert name not in EXPECTED or len(rows) == EXPECTED[name]
