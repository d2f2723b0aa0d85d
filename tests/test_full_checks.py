"""Queries SQL cannot state, over all rows of the smallest tables, against plain Python written down again here."""

import hashlib
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from canteria.functions.instants import to_utc_us
from canteria.functions.text import key_text
from canteria.operators import history, instants
from canteria.plans import found, registry

QUERIES = registry.queries()


def stored(data, table):
    return sorted(pq.read_table(f"{data}/{table}.parquet").to_pylist(), key=lambda r: r["seq"])


def loaded(text):
    try:
        return True, json.loads(text)
    except (TypeError, ValueError):
        return False, None


def test_p1_without_dictionary_and_join(spark, data):
    zones = {r["equipo"]: (r["zona"], r["orden_fecha"]) for r in pq.read_table(f"{data}/equipo.parquet").to_pylist()}
    want = set()
    for table, fields in (("version", ["capture_ts"]), ("inscripcion", ["inferidor_ts", "ts"])):
        for r in stored(data, table):
            for f in fields:
                us = to_utc_us(r[f], *zones.get(r["equipo"], (None, None)))
                want |= {(table, f, r["seq"], us)} if us is not None else set()
    got = QUERIES["p1_found"](spark, data).collect()
    assert {(r.tabla, r.campo, r.seq, r.utc_us) for r in got} == want and len(got) == len(want) > 300


def test_p3_as_islands_in_sql_over_its_captures(spark, data):
    duckdb = pytest.importorskip("duckdb")
    instant = {r.seq: r.utc_us for r in QUERIES["p1_found"](spark, data).where("tabla = 'version'").collect()}
    captures = found._captures(spark, data).withColumn("content_hash", key_text(F.col("content_hash"))).toPandas()
    first = {}
    for r in stored(data, "version"):
        first.setdefault(r["id"] if r["id"] is not None else r["seq"], r["seq"])
    kept = {s for s in first.values() if s in instant}
    assert set(captures["seq"]) <= kept and all(instant[s] == us for s, us in zip(captures["seq"], captures["utc_us"]))
    con = duckdb.connect()
    con.register("captures", captures)
    want = con.execute("""
        with one as (select * from captures qualify row_number() over (partition by referente_id, utc_us order by seq desc) = 1),
          marked as (select *, content_hash is distinct from lag(content_hash) over w or lag(seq) over w is null as begins from one window w as (partition by referente_id order by utc_us)),
          runs as (select referente_id, any_value(content_hash) content_hash, min(utc_us) desde_us from (select *, sum(begins::int) over (partition by referente_id order by utc_us) run from marked) group by referente_id, run)
        select * from (select *, coalesce(lead(desde_us) over (partition by referente_id order by desde_us), -1) hasta_us from runs) where content_hash is not null""").fetchall()
    got = [tuple(r) for r in QUERIES["p3_found"](spark, data).select("referente_id", "content_hash", "desde_us", "hasta_us").collect()]
    assert sorted(got) == sorted(want) and len(got) > 100


def test_p3_parses_nothing_of_its_own(spark, data):
    dictionary = instants.InstantDictionary(spark)
    QUERIES["p1_found"](spark, data).count()
    before = spark.read.parquet(dictionary.path).count()
    df = QUERIES["p3_found"](spark, data)
    assert "ArrowEvalPython" not in df._jdf.queryExecution().toString()
    assert spark.read.parquet(dictionary.path).count() == before
    assert "ArrowEvalPython" not in found._captures(spark, data)._jdf.queryExecution().toString()


def test_integrity(spark, data):
    want = {}
    for r in stored(data, "inscripcion"):
        (a, searches), (b, results) = (loaded(r[c]) if r[c] is not None else (True, None) for c in ("busqueda", "resultados_crudos"))
        rock = json.dumps({"premisa": r["premisa"], "busqueda": searches, "resultados_crudos": results}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        want[r["seq"]] = hashlib.sha256(rock.encode()).hexdigest() == r["huella"] if a and b and r["huella"] is not None else None
    assert {r.seq: r.integra for r in QUERIES["integrity"](spark, data).collect()} == want and {True, False} <= set(want.values())


def test_canonical_json(spark, data):
    def form(text, **how):
        good, value = loaded(text)
        return json.dumps(value, ensure_ascii=False, sort_keys=True, **how) if good else None

    want = {r["seq"]: (form(r["busqueda"]), form(r["resultados_crudos"], separators=(",", ":"))) for r in stored(data, "inscripcion")}
    assert {r.seq: (r.busqueda, r.resultados_crudos) for r in QUERIES["canonical_json"](spark, data).collect()} == want


def test_rounded_divergence(spark, data):
    first, want = {}, set()
    for r in stored(data, "inscripcion"):
        if r["huella"] is None:
            continue
        base = first.setdefault(r["huella"], r)
        if base is r or base["conclusion"] is None or r["conclusion"] is None:
            continue
        x, y = set(base["conclusion"].lower().split()), set(r["conclusion"].lower().split())
        alike = len(x & y) / len(x | y) if x | y else 1.0
        want.add((r["seq"], r["huella"][:12], round(alike, 3), round(1 - alike, 3)))
    assert {(r.seq, r.huella, r.similitud, r.divergencia) for r in QUERIES["divergence_rounded"](spark, data).collect()} == want


def test_open_runs_of_a_block_are_three_at_most():
    import pyarrow as pa

    runs = pa.table([pa.array(["e"] * 9), pa.array(list("aabbcabca")), pa.array(range(9)), pa.array([-1] * 9), pa.array([False] * 9)], names=history._RUN)
    closed, opened = history.reduce_block(runs)
    assert opened["desde_us"].to_pylist() == [0, 7, 8] and opened["hueco"].to_pylist() == [False, True, False] and closed["desde_us"].to_pylist() == [2, 4, 5, 6] and closed["hasta_us"].to_pylist() == [4, 5, 6, 7]
