import json
import socket
import sys
import urllib.error
import uuid

import pytest
from pyspark import cloudpickle

from canteria import cli
from canteria.functions import canonical, document
from canteria.operators import claims
from canteria.plans.projection import COLUMNS, rebuild, write_projection
from canteria.sources import emission, fetching, grains, sinks
from canteria.sources.store import EventStore, canonical_log, log_path, read_log
from canteria.streaming.log_stream import ingest_stream, stream_lines

CLOCK = "2026-01-01T00:00:00"


@pytest.fixture(params=["", "file://"])
def store(tmp_path, request):
    return EventStore(f"{request.param}{tmp_path}/store", clock=lambda: CLOCK)


def document_of(**changes):
    body = {
        "meta": {"schema_version": "aec-1", "session_id": "s1"},
        "inscripciones": [{"local_id": "i1", "premisa": "p", "busqueda": ["b"], "resultados_crudos": [{"x": 1}], "conclusion": "c", "inferidor": {"model": "m", "ts": "t"}}],
        "necesidad": {"pregunta": "why", "gatillo": "explicito:x"},
        "consultas": [{"formulacion": "q", "referencias": [{"local_id": "r1", "url": "http://H.test/a/", "content_hash": "MATERIALIZAR"}, {"local_id": "r2", "url": "http://h.test/b", "content_hash": "MATERIALIZAR"}]}],
        "afirmaciones": [{"txt": "claim", "survived_from": "r1", "inferida_por": "i1"}],
    }
    return {"x_aec": {**body, **changes}}


ROOT = "x_aec"


def fetched(spark, doc, store, fetcher, by=None):
    outcomes = fetching.materialize(fetching.document_references(spark, doc, ROOT), store, fetcher, clock=lambda: CLOCK).collect()
    return fetching.filled(doc, outcomes, ROOT, by), fetching.summary(outcomes)


def ready(spark, store):
    return fetched(spark, document_of(), store, lambda u: u.encode(), "me")[0]


def written(path, doc):
    import yaml

    path.write_text(yaml.safe_dump(doc, sort_keys=False))
    return str(path)


def land(store, **more):
    inference = {"premisa": "p", "busqueda": ["b"], "resultados_crudos": [{"fuente": "f"}], "conclusion": "some words", "inferidor_model": "m", "inferidor_ts": "t"}
    return emission.land(store, b"page", **{"necesidad": {"pregunta": "why", "gatillo": "explicito:x"}, "consulta": {"formulacion": "q"}, "referencia": {"url_cruda": "http://H.test/a/"}, "inscripcion": inference} | more)


def dumped(tables):
    return sorted(map(tuple, claims.dump(tables).collect()))


def test_rebuild_twice_is_the_same_and_has_all_columns(spark, store, tmp_path):
    land(store)
    one, two = rebuild(store.log(spark)), rebuild(store.log(spark))
    assert dumped(one) == dumped(two)
    assert {t: df.columns for t, df in one.items()} == COLUMNS
    write_projection(one, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "version")).count() == 1


def test_first_write_wins_and_sticky_null(spark, store):
    def ref(i, captured, q):
        return {"ev": "referencia", "id": i, "referente_id": "r", "content_hash": "h", "url_cruda": "u", "capture_ts": captured, "fecha_fuente": "capture", "q_id": q}

    store.append([ref("v", None, "q1"), ref("v", "2026-01-02", "q2"), ref("w", "2026-01-01", "q1"), {"ev": "other"}, {"ev": "afirmacion", "id": None, "txt": True, "insc_id": None, "tipo": "t", "estatus": "e"}] + [{"ev": "afirmacion", "id": None, "txt": False, "insc_id": None, "tipo": "t", "estatus": "e"}])
    tables = rebuild(store.log(spark))
    assert {(r.id, r.q_id) for r in tables["version"].collect()} == {("v", "q1"), ("w", "q1")}
    assert [r.primera_captura for r in tables["referente"].collect()] == [None]
    assert sorted(r.txt for r in tables["afirmacion"].collect()) == ["0", "1"]


def test_log_order_survives_partitioning(spark, store):
    store.append([{"ev": "consulta", "id": f"k{i % 50}", "nec_id": str(i), "formulacion": "f"} for i in range(5000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        log = store.log(spark)
        assert log.rdd.getNumPartitions() > 5
        assert {(r.id, r.nec_id) for r in rebuild(log)["consulta"].collect()} == {(f"k{i}", str(i)) for i in range(50)}
        shuffled = log.repartition(7)
        assert {(r.id, r.nec_id) for r in rebuild(shuffled)["consulta"].collect()} == {(f"k{i}", str(i)) for i in range(50)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_log_reading(spark, tmp_path):
    assert read_log(spark, str(tmp_path / "none.jsonl")).count() == 0
    bad = tmp_path / "bad.jsonl"
    bad.write_text('\n  {"ev": "x"}\t\nnot json\n')
    assert read_log(spark, str(bad), strict=False).count() == 1
    with pytest.raises(Exception, match="no JSON in the log"):
        read_log(spark, str(bad)).collect()
    lacking = tmp_path / "lacking.jsonl"
    lacking.write_text('{"ev": "consulta", "id": "a"}\n')
    with pytest.raises(Exception, match="lacks"):
        rebuild(read_log(spark, str(lacking)))["consulta"].collect()
    assert rebuild(read_log(spark, str(lacking)), strict=False)["consulta"].first().nec_id is None


def test_lines_are_json_as_python_takes_it(spark, tmp_path):
    lines = ['{"a":1.0,"b":[1,{"z":1}]}', '{"a":1,"a":2}', '{"a":NaN}', '{"a":-Infinity}', '{"a":1} x', '{"a":1}{"b":2}', '1,2', "{'a':1}", "[1]", "5", '"s"', "nan", "NaN", '{"a":1e400}', '{"a":"\\ud800"}', '{"a":1', '{"a":01}', "{a:1}", '{"a":1,}', '{"a":"\\x"}', "", "[]", "null", "] [", "1] [2", "[1]]"]

    def good(line):
        try:
            json.loads(line)
            return True
        except ValueError:
            return False

    (tmp_path / "log").write_text("\n".join(lines))
    assert sorted(r.linea for r in read_log(spark, str(tmp_path / "log"), strict=False).collect()) == sorted(x for x in lines if good(x))
    assert "Python" not in plan_of(read_log(spark, str(tmp_path / "log")))


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_rebuild_reads_the_log_once(spark, store):
    store.append([{"ev": "consulta", "id": "a", "nec_id": "true", "formulacion": True}, {"ev": "afirmacion", "id": "b", "txt": 1.50, "insc_id": None, "tipo": "t", "estatus": "e"}, {"ev": "inscripcion", "id": "c", "premisa": "p", "busqueda": ["é", {"b": 1.0, "a": 2}], "resultados_crudos": "text", "conclusion": "c", "inferidor_model": "m", "inferidor_ts": "t", "huella": "h"}])
    tables = rebuild(store.log(spark))
    assert all("Scan text" not in plan_of(df) for df in tables.values())
    assert [tuple(r) for r in tables["consulta"].collect()] == [("a", "true", "1", CLOCK)] and tables["afirmacion"].first().txt == "1.5"
    assert tuple(tables["inscripcion"].first())[2:4] == ('["é", {"a": 2, "b": 1.0}]', "text")


def test_snapshots_are_written_once(spark, store):
    a, b = store.put_snapshot(b"x"), store.put_snapshot(b"x")
    assert a == b and store.has_snapshot(a) and store.read_snapshot(a) == b"x"
    assert [r.content_hash for r in store.snapshots(spark).collect()] == [a]
    assert bytes(store.snapshot_contents(spark).first().content) == b"x"
    assert not any(hasattr(store, verb) for verb in ("update", "delete", "remove"))


def test_trace_and_safety(spark, store):
    ids = land(store)
    gone = emission.emit(store, "referencia", q_id=ids["consulta"], url_cruda="http://h.test/z", content_hash="0" * 64)
    unsafe = emission.emit(store, "afirmacion", txt="unsafe", insc_id=ids["inscripcion"], ref_id=gone)
    lost = emission.emit(store, "afirmacion", txt="lost", insc_id=ids["inscripcion"])
    empty = emission.emit(store, "afirmacion", txt="empty", insc_id="", ref_id="")
    emission.emit(store, "referente_assert", referente_a="a", referente_b="b", relacion="mirror", gatillo="explicito:x")
    t = rebuild(store.log(spark))
    assert {r.aid for r in claims.unsafe_claims(t["afirmacion"], t["version"], store.snapshots(spark)).collect()} == {unsafe}
    assert {r.id for r in claims.orphans(t["afirmacion"]).collect()} == {lost}
    rows = {r.id: r for r in claims.trace_up(t["afirmacion"], t["inscripcion"], t["version"], t["consulta"], t["necesidad"]).collect()}
    assert rows[ids["afirmacion"]].pregunta == "why" and rows[ids["afirmacion"]].inferida_por == "m@t" and rows[ids["afirmacion"]].referente_id == "https://h.test/a"
    assert rows[lost].referente_id is None and rows[lost].conclusion == "some words"
    assert rows[empty].conclusion is None
    # A claim stays on its version when a newer one of the referent arrives.
    emission.emit(store, "referencia", q_id=ids["consulta"], url_cruda="https://h.test/a", content_hash="1" * 64, capture_ts="2999-01-01")
    t = rebuild(store.log(spark))
    assert claims.current_version(t["version"]).where("referente_id = 'https://h.test/a'").first().content_hash == "1" * 64
    assert {r.content_hash for r in claims.pinned_versions(t["afirmacion"], t["version"]).where(f"aid = '{ids['afirmacion']}'").collect()} == {ids["snapshot"]}


def test_incomplete_inference_stores_nothing(spark, store):
    lacking = {"premisa": " ", "busqueda": ["b"], "resultados_crudos": [1], "conclusion": "c", "inferidor_model": "m"}
    with pytest.raises(ValueError, match="premise"):
        land(store, inscripcion=lacking)
    with pytest.raises(ValueError, match="missing or unknown"):
        emission.emit(store, "consulta", formulacion="f")
    assert list(store.iter_events()) == [] and store.snapshots(spark).count() == 0


def test_inferences_read_again(spark):
    columns = "premisa string, busqueda string, resultados_crudos string, conclusion string, inferidor_model string, inferidor_ts string, huella string"
    a = emission.with_fingerprint(spark.createDataFrame([("p", '["b"]', "[1]", "one two", "m", "t", ""), ("q", "[]", "[]", None, "m", "t", None), ("r", '["b"]', "[1]", " ", "m", "t", "kept")], columns))
    want = {"p": canonical.fingerprint("p", ["b"], [1]), "q": canonical.fingerprint("q", [], []), "r": "kept"}
    assert {r.premisa: r.huella for r in a.collect()} == want
    b = emission.reinfer(a, lambda p, s, r: "two three four" if p == "p" else "\n", "n", "u")
    assert {(r.premisa, r.huella, r.inferidor_model, r.inferidor_ts) for r in b.collect()} == {(p, h, "n", "u") for p, h in want.items()}
    assert sorted(map(tuple, emission.divergence(a, b).collect())) == sorted([(want["p"][:12], 0.25, 0.75), (want["q"][:12], 1.0, 0.0), ("kept", 1.0, 0.0)])
    assert emission.divergence(a, a.limit(0)).count() == 0


def test_ingest_is_idempotent_and_gated(spark, store, tmp_path):
    with pytest.raises(grains.LintError, match="C3"):
        grains.ingest_file(spark, written(tmp_path / "raw.yaml", document_of()), store, ROOT)
    assert list(store.iter_events()) == []
    doc = ready(spark, store)
    path = written(tmp_path / "a.yaml", doc)
    done = grains.ingest_file(spark, path, store, ROOT)
    assert done["appended"] == 6 and not done["noop"] and done["session_id"] == "s1" and len(done["afirmaciones"]) == 1 and done["necesidad"]
    assert grains.ingest_file(spark, path, store, ROOT)["noop"]
    events = dict(document.derive_events(doc, ROOT))
    assert [e["id"] for e in store.iter_events()] == list(events)
    assert rebuild(store.log(spark))["version"].where("referente_id = 'https://h.test/a'").count() == 1


def test_ingest_of_many_documents_is_one_append(spark, store, tmp_path):
    folder = tmp_path / "granos"
    folder.mkdir()
    doc = ready(spark, store)
    for k in range(5):
        written(folder / f"{k}.yaml", {ROOT: {**doc[ROOT], "meta": {"schema_version": "aec-1", "session_id": f"s{k}"}}})
    written(folder / "bad.yaml", document_of())
    docs = grains.read_grains(spark, str(folder))
    # The rock, and the two versions, are the same in all five; need, query and claim are each document's own.
    assert grains.ingest(docs, store, ROOT) == {"documentos": 6, "rechazados": 1, "appended": 3 + 5 * 3}
    assert grains.ingest(docs, store, ROOT)["appended"] == 0
    ids = [e["id"] for e in store.iter_events()]
    assert len(ids) == len(set(ids)) == 18 and all(e["ts"] == CLOCK for e in store.iter_events())
    first = [i for i, _ in document.derive_events({ROOT: {**doc[ROOT], "meta": {"session_id": "s0"}}}, ROOT)]
    assert ids[: len(first)] == first
    # What the driver appends afterwards is read after the segment.
    store.append([{"ev": "consulta", "id": "last", "nec_id": "n", "formulacion": "f"}, {"ev": "consulta", "id": first[2], "nec_id": "late", "formulacion": "f"}])
    assert [e["id"] for e in store.iter_events()][-2:] == ["last", first[2]]
    log = store.log(spark)
    assert log.count() == 20 and json.loads(log.orderBy("seq").collect()[-2].linea)["id"] == "last"
    assert "late" not in {r.nec_id for r in rebuild(log)["consulta"].collect()}


def test_snapshots_of_many_tasks(spark, store):
    there = store.put_snapshot(b"x")
    rows = spark.createDataFrame([(bytearray(b"x"), 1), (bytearray(b"y"), 2), (bytearray(b"y"), 3), (None, 4), (bytearray(b""), 5)], "content binary, content_hash int").repartition(3)
    got = {r.content_hash: r.nueva for r in store.put_snapshots(rows.select("content")).collect()}
    assert got[there] is False and sorted(got.values()) == [False, True, True] and all(store.has_snapshot(h) for h in got)
    assert store.snapshots(spark).count() == 3


@pytest.mark.parametrize(
    ("changes", "rule"),
    [
        ({"meta": {"schema_version": "x"}}, "C1"), ({"inscripciones": [{"local_id": "i1", "premisa": "\n", "busqueda": ["b"], "resultados_crudos": [1]}]}, "C2"), ({"necesidad": {"pregunta": "w", "gatillo": "Explicito:x"}}, "C6"),
        ({"necesidad": {"pregunta": " ", "gatillo": "explicito:x"}}, "C6"), ({"afirmaciones": [{"txt": "t"}]}, "C4"), ({"afirmaciones": [{"txt": "t", "survived_from": "zz", "inferida_por": "i1"}]}, "C4"),
        ({"consultas": [{"referencias": [{"local_id": "r1", "url": "u", "content_hash": "", "capture_ts": "yesterday"}]}]}, "C5"),
    ],
)
def test_lint_rules(changes, rule):
    assert rule in {r for r, _, _ in document.lint(document_of(**changes), ROOT)}


def test_lint_without_a_root():
    assert [r for r, _, _ in document.lint({"other": 1}, ROOT)] == ["C1"] and document.derive_events([1], ROOT) == []
    assert [e["ev"] for _, e in document.derive_events({ROOT: {}}, ROOT)] == ["necesidad"]
    assert [r for r, _, _ in document.lint({"foreign_aec": {}}, ROOT)] == ["C1"] and document.derive_events({"foreign_aec": {}}, ROOT) == []


def test_last_local_id_counts():
    refs = [{"local_id": "r", "url": "http://a.test", "content_hash": "sha256:1", "capture_ts": "2026"}, {"local_id": "r", "url": "http://b.test", "content_hash": "2", "capture_ts": "2026"}]
    pairs = document.derive_events(document_of(consultas=[{"formulacion": "q", "referencias": refs}], afirmaciones=[{"txt": "t", "survived_from": "r", "inferida_por": "none"}]), ROOT)
    versions = [(i, e) for i, e in pairs if e["ev"] == "referencia"]
    claim = pairs[-1][1]
    assert claim["ref_id"] == versions[1][0] and claim["insc_id"] is None and versions[0][1]["content_hash"] == "1" and claim["tipo"] == "claim" and claim["estatus"] == "afirmado"


def test_folder_of_documents(spark, store, tmp_path):
    folder = tmp_path / "granos"
    folder.mkdir()
    doc = ready(spark, store)
    path = written(folder / "a.yaml", doc)
    edited = json.loads(json.dumps(doc))
    edited[ROOT]["afirmaciones"][0]["txt"] = "edited"
    written(folder / "b.yml", edited)
    (folder / "c.yaml").write_text("a: [")
    (folder / "d.yaml").write_text("other: 1")
    written(folder / "e.yaml", document_of(meta={"schema_version": "aec-1", "session_id": "s2"}))
    (folder / "f.txt").write_text("no document")
    (folder / "g.yaml").write_text(f"{ROOT}: {{consultas: [x]}}")
    docs = grains.read_grains(spark, str(folder))
    new = grains.new_events(grains.examined(docs, ROOT), store.log_ids(spark), store.snapshots(spark)).count()
    grains.ingest_file(spark, path, store, ROOT)
    rows = {r.path[-6:]: r for r in grains.states(docs, store.log_ids(spark), ROOT).collect()}
    assert [rows[k].estado for k in ("a.yaml", "/b.yml", "c.yaml", "d.yaml", "e.yaml", "g.yaml")] == ["CONSUMIDO", "PARCIAL", "ERROR", "VACIO", "PARCIAL", "ERROR"]
    assert [x.ev for x in rows["/b.yml"].faltantes] == ["afirmacion"] and new == 7 and rows["a.yaml"].session_id == "s1"
    assert {(r.path[-6:], r.regla) for r in grains.lint(docs, store.snapshots(spark), ROOT).collect()} == {("c.yaml", "YAML"), ("d.yaml", "C1"), ("e.yaml", "C3"), ("e.yaml", "C5"), ("g.yaml", "YAML")}


def test_materialize_goes_on_after_a_failure(spark, store):
    def flaky(url):
        if url.endswith("/a/"):
            raise OSError("down")
        return b"bytes"

    doc, report = fetched(spark, document_of(), store, flaky)
    assert [f["load_bearing"] for f in report["fallidas"]] == [True] and report["fallidas"][0]["error"] == "OSError: down" and len(report["materializadas"]) == 1
    refs = doc[ROOT]["consultas"][0]["referencias"]
    assert refs[0]["content_hash"] == "MATERIALIZAR" and refs[1]["capture_ts"] == CLOCK and list(store.iter_events()) == []
    assert store.read_snapshot(refs[1]["content_hash"]) == b"bytes" and report["materializadas"][0]["bytes"] == 5
    again, report = fetched(spark, doc, store, lambda u: b"x", "me")
    assert report["ya_materializadas"] == ["r2"] and again[ROOT]["meta"]["consolidado_por"] == "me" and "consolidado_por" not in doc[ROOT]["meta"]
    assert fetched(spark, {}, store, flaky) == ({}, {"materializadas": [], "ya_materializadas": [], "fallidas": []})


def test_many_documents_materialize_at_once(spark, store):
    refs = spark.createDataFrame([(f"d{k}", k, f"r{k}", f"u{k % 3}", None if k % 2 else "h", False) for k in range(40)], "path string, place int, local_id string, url string, content_hash string, load_bearing boolean").repartition(4)
    got = fetching.materialize(refs, store, lambda u, timeout: u.encode(), clock=lambda: CLOCK).groupBy("estado").count().collect()
    assert {r.estado: r["count"] for r in got} == {"ya": 20, "materializada": 20} and store.snapshots(spark).count() == 3


def test_preflight(spark):
    rows = [("r1", "dead", None, True), ("r2", "slow", "", False), ("r3", "fine", "MATERIALIZAR", True), ("r4", "dead", "abc", True)]
    refs = spark.createDataFrame(rows, "local_id string, url string, content_hash string, load_bearing boolean")
    answers = {"dead": ("DNS", "x"), "slow": ("TIMEOUT", "y"), "fine": ("OK", "200")}
    out = fetching.preflight(refs, lambda url: answers[url])
    assert {(r.local_id, r.estado, r.severidad) for r in out.collect()} == {("r1", "DNS", "BLOQUEANTE"), ("r2", "TIMEOUT", "AVISO"), ("r3", "OK", None), ("r4", "YA", None)}
    assert tuple(fetching.preflight_counts(out).first()) == (1, 1, 1, 1)


@pytest.mark.parametrize(
    ("error", "state"),
    [(urllib.error.HTTPError("u", 404, "m", None, None), "HTTP"), (urllib.error.URLError(socket.gaierror("no")), "DNS"), (TimeoutError(), "TIMEOUT"), (urllib.error.URLError(TimeoutError()), "TIMEOUT"), (urllib.error.URLError("refused"), "ERROR"), (ValueError("x"), "ERROR")],
)
def test_probe_never_raises(monkeypatch, error, state):
    def fail(*a, **k):
        raise error

    monkeypatch.setattr(fetching.urllib.request, "urlopen", fail)
    assert fetching.probe("http://h.test")[0] == state


def test_fetch_and_probe_of_a_file(tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    assert fetching.fetch(f"file://{tmp_path}/f") == b"abc" and fetching.probe(f"file://{tmp_path}/f")[0] == "OK"


def test_export(spark, store, tmp_path):
    land(store)
    store.put_snapshot(b"secret")
    lines = {r.line_sha: r.event for r in canonical_log(spark, store.log_path).collect()}
    loose = tmp_path / "loose.jsonl"
    loose.write_text("\n".join(json.dumps(dict(reversed(json.loads(x).items())), indent=None, separators=(" ,", " :")) for x in lines.values()))
    assert {r.line_sha for r in canonical_log(spark, str(loose)).collect()} == set(lines)
    sink = sinks.MemorySink(dict(list(lines.items())[:2]))
    assert sinks.export_log(spark, store.log_path, sink) == {"read": 5, "inserted": 3, "conflicts": 2}
    assert sinks.export_log(spark, store.log_path, sink) == {"read": 5, "inserted": 3, "conflicts": 7}
    assert "secret" not in "".join(sink.store.values())
    table = sinks.ParquetSink(spark, str(tmp_path / "replica"))
    assert sinks.export_log(spark, store.log_path, table) == {"read": 5, "inserted": 5, "conflicts": 0}
    assert sinks.export_log(spark, store.log_path, table) == {"read": 5, "inserted": 5, "conflicts": 5}


class Replica:
    """A stand-in for a database: tables in files, a transaction's rows written by its commit."""

    def __init__(self, folder):
        self.folder, self.rowcount, self.pending = folder, 0, []

    cursor = lambda self: self

    def __enter__(self):
        return self

    def __exit__(self, *a):
        return False

    def executemany(self, sql, rows):
        self.pending += [json.dumps(r) for r in rows]

    def execute(self, sql):
        staged = [json.loads(x) for f in sorted(self.folder.glob("staged-*")) for x in f.read_text().splitlines()]
        if sql.startswith("INSERT INTO aec_log (line_sha, event) SELECT DISTINCT ON"):
            assert sql.endswith("ON CONFLICT (line_sha) DO NOTHING")
            target = self.folder / "replica"
            there = set(target.read_text().split()) if target.exists() else set()
            new = {sha for attempt, sha, _ in staged if f"'{attempt}'" in sql} - there
            target.write_text("\n".join(there | new))
            self.rowcount = len(new)
        elif sql.startswith("DROP"):
            for f in self.folder.glob("staged-*"):
                f.unlink()

    def commit(self):
        if self.pending:
            (self.folder / f"staged-{uuid.uuid4().hex}").write_text("\n".join(self.pending))

    def close(self):
        pass


def test_postgres_sink_stages_and_commits_once(spark, store, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that tasks have the stand-in
    folder = tmp_path / "db"
    folder.mkdir()
    (folder / "staged-given-up").write_text(json.dumps(["other attempt", "no sha", "{}"]))
    land(store)
    lines = canonical_log(spark, store.log_path).select("line_sha", "event").repartition(3)
    sink = sinks.PostgresSink("", lambda: Replica(folder), rows_at_once=2)
    sink.write(lines.unionByName(lines))
    assert not (folder / "replica").exists() and sink.inserted == 0
    sink.close()
    sink.close()
    assert (sink.inserted, sink.conflicts) == (5, 5) and len((folder / "replica").read_text().split()) == 5
    assert sinks.export_log(spark, store.log_path, sinks.PostgresSink("", lambda: Replica(folder))) == {"read": 5, "inserted": 0, "conflicts": 5}


def test_dry_run_counts(spark, store):
    land(store)
    assert sinks.export_log(spark, store.log_path, sinks.CountingSink()) == {"read": 5, "inserted": 5, "conflicts": 0}


def test_stream(spark, store, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    (folder / "1.jsonl").write_text('{"ev":"a","id":"1"}\n\n{"ev":"a","id":"1"}\n{"ev":"b","id":"2"}\n')
    ingest_stream(stream_lines(spark, str(folder)), table, str(tmp_path / "cp")).awaitTermination()
    (folder / "2.jsonl").write_text('{"ev":"b","id":"2"}\n{"ev":"c","id":"3"}\n')
    ingest_stream(stream_lines(spark, str(folder)), table, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == ["1", "2", "3"]


def test_command_line(spark, store, tmp_path, capsys, monkeypatch):
    import yaml

    monkeypatch.setattr(cli, "_spark", lambda: spark)
    path = tmp_path / "o.yaml"
    doc = document_of()
    for r in doc["x_aec"]["consultas"][0]["referencias"]:  # pages of their own: the same one fetched in two seconds would be two versions
        page = tmp_path / r["local_id"]
        page.write_text("x")
        r["url"] = f"file://{page}"
    path.write_text(yaml.safe_dump(doc))
    root = ["--store", store.root]
    key = ["--root-key", ROOT]
    assert cli.main(["ingest", str(path), *root, *key]) == 1
    assert cli.main(["ingest", str(path), *root, *key, "--lint-only"]) == 1
    assert cli.main(["preflight", str(path), *key]) == 0
    assert cli.main(["materialize", str(path), *root, *key]) == 0
    assert cli.main(["state", str(path), *root, *key]) == 1
    assert cli.main(["ingest", str(path), *root, *key, "--db", str(tmp_path / "db")]) == 0
    assert cli.main(["state", str(path), *root, *key]) == 0
    assert cli.main(["export", *root, "--db-url", ""]) == 2
    assert cli.main(["export", *root, "--dry-run"]) == 0
    assert "'inserted': 6" in capsys.readouterr().out
    assert log_path(store.root) == store.log_path


def test_stream_keeps_first_writes_null_ids_and_the_bag(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    bag = '{"ev":"referente_assert","id":"r"}'
    (folder / "1.jsonl").write_text("\n".join(['{"ev":"a","id":"1","x":1}', '{"ev":"a","id":null,"x":1}', bag, '{"ev":"a","id":"1","x":2}', '{"ev":"a","x":2}', bag, '{"ev":"b","id":"1"}']) + "\n")
    ingest_stream(stream_lines(spark, str(folder)), table, str(tmp_path / "cp")).awaitTermination()
    (folder / "2.jsonl").write_text("\n".join([bag, '{"ev":"a","id":null,"x":1}', '{"ev":"a","id":"1","x":3}', '{"ev":"c","id":"2"}']) + "\n")
    ingest_stream(stream_lines(spark, str(folder)), table, str(tmp_path / "cp")).awaitTermination()
    want = ['{"ev":"a","id":"1","x":1}', '{"ev":"a","id":null,"x":1}', '{"ev":"a","id":null,"x":1}', '{"ev":"a","x":2}', '{"ev":"b","id":"1"}', '{"ev":"c","id":"2"}', bag, bag, bag]
    assert sorted(r.linea for r in spark.read.parquet(table).collect()) == sorted(want)
    # the first batch again, as after a failure
    (folder / "2.jsonl").unlink()
    ingest_stream(stream_lines(spark, str(folder)), table, str(tmp_path / "cp-again")).awaitTermination()
    assert spark.read.parquet(table).count() == len(want)
