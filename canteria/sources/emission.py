"""Emitting events, and reading inferences again.

What an event of each kind holds is stated once, in the projection's table of
kinds; a path from a need to its claim is a chain of kinds and the fields that
tie them.  Inferences are rows: their fingerprint, completeness and divergence
are the column operators the queries use.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions.document import canonical as canonical_form
from ..operators.claims import divergence_counts
from ..plans.projection import KINDS
from .store import EventStore

# Fields that may be left out, and what they then are.
DEFAULTS = {"necesidad": {"origen_nodo": None}, "referencia": {"fecha_fuente": "capture"}, "afirmacion": {"ref_id": None, "tipo": "claim", "estatus": "afirmado"}}
#: The steps of a path, and the field of each that names an earlier step.
CHAIN = (("necesidad", {}), ("consulta", {"nec_id": "necesidad"}), ("referencia", {"q_id": "consulta"}), ("inscripcion", {}), ("afirmacion", {"insc_id": "inscripcion", "ref_id": "referencia"}))


def new_event(kind: str, clock: Callable[[], str], **fields: object) -> dict:
    """An event of a kind with a fresh random id, its fields checked against the table of kinds.

    A reference gets its referent from the raw URL and, unless given, the time
    of capture; an inference its fingerprint.  One that lacks an input is
    refused.
    """
    _, mandatory, optional = KINDS[kind]
    names = [n.rstrip("*") for n in (*mandatory, *optional)]
    derived = {}
    if kind == "referencia":
        derived = {"referente_id": canonical_form(str(fields["url_cruda"])), "capture_ts": fields.get("capture_ts") or clock()}
    elif kind == "inscripcion":
        inputs = [fields.get(n) for n in names[:3]]
        if not all(x.strip() if isinstance(x, str) else x for x in inputs):
            raise ValueError("an inference needs a premise, searches and results")
        derived = {"huella": fields.get("huella") or canonical.fingerprint(*inputs), "inferidor_ts": fields.get("inferidor_ts") or clock()}
    known = DEFAULTS.get(kind, {}) | fields | derived
    wrong = set(names) ^ set(known)
    if wrong:
        raise ValueError(f"{kind}: {', '.join(sorted(wrong))} missing or unknown")
    return {"ev": kind, "id": uuid.uuid4().hex} | {n: known[n] for n in names}


def emit(store: EventStore, kind: str, **fields: object) -> str:
    """Add one event; its id."""
    return store.append_event(new_event(kind, store.clock, **fields))["id"]


def land(store: EventStore, snapshot: bytes, **steps: dict) -> dict[str, str]:
    """A whole path with one write: the bytes of a snapshot and the fields of each step of the chain; the ids by step.

    Nothing is stored if a step is refused.  A claim without a text says what
    the inference concludes.
    """
    steps = {"afirmacion": {}} | steps
    steps["afirmacion"] = {"txt": steps["inscripcion"].get("conclusion")} | steps["afirmacion"]
    steps["referencia"] = steps["referencia"] | {"content_hash": hashlib.sha256(snapshot).hexdigest()}
    ids, events = {}, []
    for kind, ties in CHAIN:
        events.append(new_event(kind, store.clock, **steps[kind], **{field: ids[step] for field, step in ties.items()}))
        ids[kind] = events[-1]["id"]
    ids["snapshot"] = store.put_snapshot(snapshot)
    store.append(events)
    return ids


def with_fingerprint(inferences: DataFrame) -> DataFrame:
    """Inferences (premisa, busqueda and resultados_crudos as JSON, ...) with huella filled in where it is null or empty."""
    own = canonical.huella(F.col("premisa"), F.col("busqueda"), F.col("resultados_crudos"))
    kept = F.col("huella") if "huella" in inferences.columns else F.lit(None).cast("string")
    return inferences.withColumn("huella", F.coalesce(F.nullif(kept, F.lit("")), own))


def reinfer(inferences: DataFrame, conclude: Callable[[str, str, str], str | None], model: str, ts: str) -> DataFrame:
    """The same inputs read by another model: conclusion, inferidor_model and inferidor_ts are new, huella stays.

    ``conclude`` gets premise, searches and results (JSON) of one inference and
    runs in the tasks, over Arrow batches.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(conclusion=[conclude(*x) for x in zip(f["premisa"], f["busqueda"], f["resultados_crudos"])], inferidor_model=model, inferidor_ts=ts)

    rows = with_fingerprint(inferences)
    return rows.mapInPandas(run, rows.schema)


def divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """(huella, similitud, divergencia) of the conclusions in ``a`` and ``b`` that were drawn from the same inputs, three digits as Python rounds.

    Inferences with other inputs are not comparable and give no row; two
    conclusions without a word are alike.
    """
    pairs = a.select("huella", F.col("conclusion").alias("x")).join(b.select("huella", F.col("conclusion").alias("y")), "huella")
    common, both = divergence_counts(F.coalesce("x", F.lit("")), F.coalesce("y", F.lit("")))
    alike = F.when(both == 0, F.lit(1.0)).otherwise(F.try_divide(common, both))
    return pairs.select(F.left("huella", F.lit(12)).alias("huella"), canonical.round3(alike).alias("similitud"), canonical.round3(1 - alike).alias("divergencia"))
