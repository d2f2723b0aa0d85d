"""Command line: python -m canteria.cli {ingest,materialize,preflight,state,export,demo} ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession

from .operators.claims import dump
from .plans.projection import rebuild
from .session import ship
from .sources import emission, fetching, grains, sinks
from .sources.store import EventStore, log_path


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("canteria").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    return spark


def _document(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        return grains.one_document(spark, path, f.read())


def ingest(a: argparse.Namespace) -> int:
    store, spark = EventStore(a.store), _spark()
    if a.lint_only:
        found = grains.lint(_document(spark, a.yaml), store.snapshots(spark), a.root_key).orderBy("pos").collect()  # bounded by one document
        print("\n".join(f"{r.regla}: {r.mensaje}" for r in found) or "lint ok")
        return int(bool(found))
    if os.path.isdir(a.yaml):
        done = grains.ingest(grains.read_grains(spark, a.yaml), store, a.root_key)
        print(json.dumps(done))
        return int(done["rechazados"] > 0)
    try:
        done = grains.ingest_file(spark, a.yaml, store, a.root_key, a.db)
    except grains.LintError as e:
        print("refused:", e)
        return 1
    print(json.dumps(done, ensure_ascii=False))
    return 0


def materialize(a: argparse.Namespace) -> int:
    report = fetching.materialize_file(_spark(), a.orden, EventStore(a.store), a.root_key, a.out, by=a.consolidado_por, timeout=a.timeout)
    print(json.dumps(report, ensure_ascii=False, indent=1))
    return int(bool(report["fallidas"]))


def preflight(a: argparse.Namespace) -> int:
    spark = _spark()
    with open(a.grano, encoding="utf-8") as f:
        refs = fetching.document_references(spark, grains.load_yaml(f.read()), a.root_key)
    out = fetching.preflight(refs, timeout=a.timeout).persist()
    for r in out.orderBy("place").collect():  # bounded by one document
        print(r["local_id"], "[LB]" if r["load_bearing"] else "    ", r["severidad"] or r["estado"], r["url"], r["detalle"])
    counts = fetching.preflight_counts(out).first().asDict()
    print(counts)
    return int(counts["bloqueantes"] > 0)


def state(a: argparse.Namespace) -> int:
    """Prints document by document as they come, and says whether all are consumed; nothing is gathered on the driver."""
    spark, every = _spark(), True
    rows = grains.states(grains.read_grains(spark, a.grano or a.granos_dir), EventStore(a.store).log_ids(spark), a.root_key)
    for r in rows.toLocalIterator():
        every &= r["estado"] == "CONSUMIDO"
        print(json.dumps(r.asDict(True), ensure_ascii=False) if a.json else f"{r['estado']:12} {r['presentes']}/{r['total']} {os.path.basename(r['path'])}")
    return int(not every)


def export(a: argparse.Namespace) -> int:
    if not a.dry_run and not a.db_url:
        print("no database URL; --dry-run needs none", file=sys.stderr)
        return 2
    sink = sinks.CountingSink() if a.dry_run else sinks.PostgresSink(a.db_url)
    print(sinks.export_log(_spark(), log_path(a.store), sink))
    sink.close()
    return 0


def demo(a: argparse.Namespace) -> int:
    """A path from need to claim, rebuilt twice: 0 if both are the same."""
    spark = _spark()
    with tempfile.TemporaryDirectory() as root:
        store = EventStore(root)
        emission.land(
            store, b"page", necesidad={"pregunta": "why?", "gatillo": "explicito:demo"}, consulta={"formulacion": "a search"}, referencia={"url_cruda": "https://site.example/x/"},
            inscripcion={"premisa": "a premise", "busqueda": ["a search"], "resultados_crudos": [{"fuente": "x", "texto": "y"}], "conclusion": "a conclusion", "inferidor_model": "model"},
        )
        one, two = rebuild(store.log(spark)), rebuild(store.log(spark))
        for name, df in one.items():
            print(name)
            df.show(truncate=20)
        apart = dump(one).exceptAll(dump(two)).count() + dump(two).exceptAll(dump(one)).count()
        print("rebuilt twice:", "the same" if not apart else f"{apart} rows differ")
    return int(apart > 0)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="canteria")
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *arguments: tuple) -> None:
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        for flags, options in arguments:
            s.add_argument(*flags, **options)

    where = (["--store", "--aec"], {"default": "store", "dest": "store"})
    root = os.environ.get("CANTERIA_ROOT_KEY")
    key = (["--root-key"], {"default": root, "required": not root, "help": "the key a document's tree is under"})
    command("ingest", ingest, (["yaml"], {}), where, key, (["--db"], {}), (["--lint-only"], {"action": "store_true"}))
    command("materialize", materialize, (["orden"], {}), where, key, (["--out"], {}), (["--consolidado-por"], {}), (["--timeout"], {"type": int, "default": fetching.FETCH_TIMEOUT}))
    command("preflight", preflight, (["grano"], {}), key, (["--timeout"], {"type": int, "default": fetching.PROBE_TIMEOUT}))
    command("state", state, (["grano"], {"nargs": "?"}), where, key, (["--granos-dir"], {"default": "granos"}), (["--json"], {"action": "store_true"}))
    command("export", export, where, (["--db-url"], {"default": os.environ.get("DATABASE_URL")}), (["--dry-run"], {"action": "store_true"}))
    command("demo", demo)
    a = p.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
