"""Deeply nested JSON turned into flat rows that keep their place under the parent.

Each Arrow batch becomes one token tape; every nesting level is then a list
array whose offsets give the parents, and keys and places are carried to the
children by ``take`` on the parent index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.jsontape import OPEN_ARR, OPEN_OBJ, STRING, Tape

_OUT = "tipo string, seq long, ruta string, valor string"
#: Bytes of text made into one tape; a longer text has a tape of its own.
TAPE_BYTES = 2_000_000
_DOT = pa.scalar(".", pa.large_string())


@dataclass(frozen=True)
class Level:
    """An array: the kind its elements get, the member that is their value (None: the element itself), and the arrays below."""

    tipo: str
    valor: str | None = None
    below: dict[str, Level] = field(default_factory=dict)


def _emit(tape: Tape, tokens: np.ndarray, level: Level, seq: pa.Array, ruta: pa.Array | None, unwrap: bool = True) -> Iterator[tuple]:
    """Rows of the arrays that ``tokens`` stand for, and of those below them."""
    if not len(tokens):
        return
    if unwrap:
        strings = np.flatnonzero(tape.kind[tokens] == STRING)
        if len(strings):
            texts = tape.text(tokens[strings])
            boxed = pc.match_substring_regex(texts, r"\A[ \t\n\r]*[\[{]").to_numpy(zero_copy_only=False).astype(bool)
            inner = Tape(texts.filter(pa.array(boxed)))
            which, roots = inner.roots()
            held = strings[boxed][which]
            yield from _emit(inner, roots, level, seq.take(pa.array(held)), ruta.take(pa.array(held)) if ruta is not None else None, unwrap=False)
            rest = np.ones(len(tokens), bool)
            rest[held] = False
            at = pa.array(np.flatnonzero(rest))
            tokens, seq, ruta = tokens[rest], seq.take(at), ruta.take(at) if ruta is not None else None
    lists = tape.lists.take(pa.array(tokens))
    parent = pc.list_parent_indices(lists)
    item = pc.list_flatten(lists).to_numpy()
    above = parent.to_numpy()
    place = np.arange(len(above)) - np.searchsorted(above, above)
    kept = ~tape.is_null[item]
    item, parent, place = item[kept], parent.filter(pa.array(kept)), pa.array(place[kept]).cast(pa.large_string())
    if not len(item):
        return
    seq = seq.take(parent)
    ruta = place if ruta is None else pc.binary_join_element_wise(ruta.take(parent), place, _DOT)
    kind = tape.kind[item]
    if level.valor is None:
        value = tape.text(item)
    else:
        is_obj = kind == OPEN_OBJ
        named = np.where(is_obj, tape.member(np.where(is_obj, item, len(tape.kind)), level.valor), np.where(kind == OPEN_ARR, -1, item))
        value = tape.text(named)
    yield level.tipo, seq, ruta, value
    objects = np.flatnonzero(kind == OPEN_OBJ)
    for name, below in level.below.items():
        inside = tape.member(item[objects], name)
        has = inside >= 0
        at = pa.array(objects[has])
        yield from _emit(tape, inside[has], below, seq.take(at), ruta.take(at))


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about TAPE_BYTES of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at, base = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, base + TAPE_BYTES, "right")))
        yield at, to
        at, base = to, int(size[to - 1])


def flatten_batch(texts: pa.Array, seq: pa.Array, level: Level) -> Iterator[pa.RecordBatch]:
    for a, b in _pieces(texts):
        tape = Tape(texts.slice(a, b - a))
        rows, roots = tape.roots()
        for tipo, keys, ruta, value in _emit(tape, roots, level, seq.slice(a, b - a).take(pa.array(rows)), None):
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([tipo], pa.string()).take(pa.array(np.zeros(n, np.int64))), keys, ruta.cast(pa.string()), value.cast(pa.string())], names=["tipo", "seq", "ruta", "valor"])


def flatten_json(df: DataFrame, column: str, level: Level, key: str = "seq") -> DataFrame:
    """(tipo, seq, ruta, valor): one row per array element that is not null, at every level of ``level``.

    ruta is the 0-based places from the outermost array inward, joined with
    ``.``, nulls counted; a row's parent is the row with one place less.  One
    value where an array is expected is an array of one; a string that holds a
    JSON array or object there is that array or object.  A scalar where an
    object is expected is its own valor, an array there has valor ''.  A
    missing or null valor is '', numbers and containers are as written; of a
    repeated member the last counts.  Null, empty and invalid text gives no
    rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from flatten_batch(b.column(1), b.column(0), level)

    return df.select(key, column).mapInArrow(run, _OUT)
