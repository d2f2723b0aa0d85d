"""Queries on the whole log against plain Python over the stored rows."""

import hashlib
import json
from collections import Counter

import pyarrow.parquet as pq

from canteria.plans import registry
from canteria.plans.projection import COLUMNS, rebuild

QUERIES = registry.queries()


def stored(data, table):
    return sorted(pq.read_table(f"{data}/{table}.parquet").to_pylist(), key=lambda r: r["seq"])


def projected(data):
    out = {}
    for t, columns in COLUMNS.items():
        if t == "referente":
            continue
        first = {}
        for r in stored(data, t):
            first.setdefault(r["seq"] if t == "referente_assert" or r["id"] is None else r["id"], r)
        out[t] = [{c: r[c] for c in columns} for r in first.values()]
    least = {}
    for r in stored(data, "version"):
        ref, ts = r["referente_id"], r["capture_ts"]
        old = least.setdefault(ref, ts)
        least[ref] = ts if old is not None and ts is not None and ts < old else old
    return out | {"referente": [{"referente_id": k, "primera_captura": v} for k, v in least.items()]}


def test_dump_holds_every_row_of_the_seven_tables_in_order(spark, data):
    got = [(r.tabla, r.fila) for r in QUERIES["dump_projection"](spark, data).collect()]
    assert [t for t, _ in got] == sorted(t for t, _ in got) and {t for t, _ in got} == set(COLUMNS)
    rows = sorted((t, sorted(json.loads(f).items())) for t, f in got)
    assert rows == sorted((t, sorted((c, "\x00" if v is None else v) for c, v in r.items())) for t, rs in projected(data).items() for r in rs)


def events(data):
    """(seq, line) of every row of the six log tables."""
    kinds = {"version": "referencia"}
    out = []
    for t, columns in COLUMNS.items():
        for r in stored(data, t) if t != "referente" else []:
            e = {"ev": kinds.get(t, t)} | {c: r[c] for c in columns}
            for c in {"busqueda", "resultados_crudos"} & set(e):
                try:
                    e[c] = None if e[c] is None else json.loads(e[c])
                except ValueError:
                    pass
            out.append((r["seq"], json.dumps(e, ensure_ascii=False, sort_keys=True)))
    return out


def sha(line):
    return hashlib.sha256(line.encode()).hexdigest()


def test_export_has_the_lines_of_all_six_kinds(spark, data):
    got = QUERIES["export_log_lines"](spark, data).collect()
    assert Counter((r.line_sha, r.event) for r in got) == Counter((sha(e), e) for _, e in events(data))
    assert {json.loads(r.event)["ev"] for r in got} == {"inscripcion", "necesidad", "consulta", "referencia", "afirmacion", "referente_assert"}


def test_upsert_adds_each_line_of_the_later_half_once(spark, data):
    log = events(data)
    half = max(s for s, _ in log) // 2
    want = {e for _, e in log} - {e for s, e in log if s <= half}
    assert Counter((r.line_sha, r.event) for r in QUERIES["export_log_upsert"](spark, data).collect()) == Counter((sha(e), e) for e in want)


def test_exported_lines_rebuild_to_the_projection(spark, data):
    log = spark.createDataFrame([((s,), e) for s, e in events(data)], "seq struct<fila:long>, linea string")
    for t, df in rebuild(log).items():
        want = projected(data)[t]
        if t == "inscripcion":  # JSON columns are held above
            df, want = df.drop("busqueda", "resultados_crudos"), [{c: v for c, v in r.items() if c not in ("busqueda", "resultados_crudos")} for r in want]
        assert Counter(tuple(sorted(r.asDict().items())) for r in df.collect()) == Counter(tuple(sorted(r.items())) for r in want), t


def test_missing_ids_of_all_kinds(spark, data):
    known = {r["id"] for t in COLUMNS if t != "referente" for r in stored(data, t)}
    want = Counter((t, c, r[c], r["seq"]) for t, c in (("afirmacion", "ref_id"), ("afirmacion", "insc_id"), ("consulta", "nec_id"), ("version", "q_id")) for r in stored(data, t) if r[c] is not None and r[c] not in known)
    assert Counter((r.tabla, r.campo, r.id, r.seq) for r in QUERIES["missing_log_events"](spark, data).collect()) == want
