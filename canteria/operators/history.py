"""History of changing attributes by tree-reduction coalescing.

Every snapshot is a unit interval at its place in (entity, instant) order.
Neighbouring runs of equal entity and payload are merged pairwise over a
logarithmic number of rounds, in three layers of one tree: the units of an
Arrow batch, the runs the batches of a sorted partition leave open, and those
the partitions leave open.  A block hands on only the three runs that touch
its ends, so an entity of any size is spread over many tasks, and no task
holds more than a batch and those end runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions

#: Per run: entity, payload (null: no content), first instant, end (-1: not known or none), whether runs lie between it and the run before.
_RUN = ["entidad", "contenido", "desde_us", "hasta_us", "hueco"]


def merge_rounds(entity: np.ndarray, payload: np.ndarray) -> np.ndarray:
    """Index of the first unit of every run, by pairwise merging of neighbouring blocks.

    In round r the blocks have 2**r units; the last run of a left block and
    the first of its right neighbour become one where entity and payload agree.
    """
    n = len(entity)
    start = np.arange(n)
    for r in range(max(n - 1, 0).bit_length()):
        block = start >> r
        meet = (block[1:] >> 1 == block[:-1] >> 1) & (block[1:] != block[:-1])
        # The left run ends where the right one begins; runs are compared by any of their units.
        same = meet & (entity[start[1:]] == entity[start[:-1]]) & (payload[start[1:]] == payload[start[:-1]])
        # A run that spans several blocks begins in an earlier one; its neighbours still meet at this boundary.
        start = start[np.concatenate([[True], ~same])]
    return start


def _codes(column: pa.Array) -> np.ndarray:
    encoded = pc.dictionary_encode(column, null_encoding="encode").indices
    return encoded.to_numpy(zero_copy_only=False).astype(np.int64)


def reduce_block(runs: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(closed, open) runs of a block of neighbouring ones, in order of entity and instant.

    Of runs that begin at one instant of one entity the last counts: the
    others last no time.  A run ends where the next one of its entity begins.
    The first run and the last two stay open, as what lies before or after the
    block may still be part of them or take the place of the last.
    """
    entity, payload = _codes(runs["entidad"].combine_chunks()), _codes(runs["contenido"].combine_chunks())
    desde, hasta, hueco = (runs[k].to_numpy() for k in ("desde_us", "hasta_us", "hueco"))
    apart = np.cumsum(hueco)
    over = np.concatenate([(entity[1:] == entity[:-1]) & (desde[1:] == desde[:-1]), [False]])
    kept = np.flatnonzero(~over)
    entity, payload, apart, desde, hasta = entity[kept], payload[kept], apart[kept], desde[kept], hasta[kept].copy()
    start = merge_rounds(entity * (int(apart[-1]) + 1) + apart, payload)
    last = np.concatenate([start[1:], [len(kept)]]) - 1
    end = hasta[last]
    goes_on = (end[:-1] == -1) & (entity[start[1:]] == entity[start[:-1]])
    end[:-1][goes_on] = desde[start[1:]][goes_on]
    gap = np.concatenate([[apart[0] > 0], np.diff(apart[start]) > 0])
    names = runs.select(["entidad", "contenido"]).take(pa.array(kept[start]))
    out = pa.table([*names.columns, pa.array(desde[start]), pa.array(end), pa.array(gap)], names=_RUN)
    is_open = np.zeros(len(start), bool)
    is_open[0] = True
    is_open[-2:] = True
    closed, opened = out.filter(pa.array(~is_open)), out.filter(pa.array(is_open))
    if len(closed):  # they lie between the first run and the last two
        opened = opened.set_column(4, "hueco", pa.array([gap[0], True, *gap[-1:]]))
    return closed, opened


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one sorted partition: those its batches close, then those all batches together close or leave open."""
    from pyspark import TaskContext

    part, serial, waiting = TaskContext.get().partitionId(), 0, []

    def out(t: pa.Table, is_open: bool) -> pa.RecordBatch:
        nonlocal serial
        at = np.arange(serial, serial + len(t))
        serial += len(t)
        whole = pa.table([pa.array(np.full(len(t), part, np.int32)), pa.array(at), *t.columns, pa.array(np.full(len(t), is_open))], names=["parte", "orden", *t.column_names, "abierta"])
        return whole.combine_chunks().to_batches()[0]

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        units = pa.table([b.column(k) for k in ("entidad", "contenido", "us")] + [pa.array(np.full(n, -1)), pa.array(np.zeros(n, bool))], names=_RUN)
        closed, opened = reduce_block(units)
        waiting.append(opened)
        if len(closed):
            yield out(closed, False)
    if waiting:
        closed, opened = reduce_block(pa.concat_tables(waiting))
        if len(closed):
            yield out(closed, False)
        yield out(opened, True)


def _across(runs: pa.Table) -> pa.Table:
    """Joins the open runs of one entity over all partitions: three a partition at most, so their number is bounded by that of partitions."""
    closed, opened = reduce_block(runs.sort_by([("parte", "ascending"), ("orden", "ascending")]).select(_RUN))
    return pa.concat_tables([closed, opened]).select(["entidad", "contenido", "desde_us", "hasta_us"])


def coalesce_history(df: DataFrame, entity: str, payload: str, instant: str, newest: str) -> DataFrame:
    """(entity, payload, desde_us, hasta_us): the periods in which each payload held.

    Entity and payload are text or bytes; ``instant`` is microseconds (bigint); of several rows of one entity at one
    instant the one with the highest ``newest`` counts alone (of equal ones
    too the greatest payload).  A null payload ends the running period and
    opens none.  hasta_us is the first instant of what follows, -1 if nothing
    does.  Rows with a null entity or instant are no snapshots and are left
    out.  Ties are settled by order, so that even an instant with a third of
    all rows is spread over partitions.
    """
    spark = df.sparkSession
    order = ["entidad", "us", "nuevo", "contenido"]
    rows = df.where(F.col(entity).isNotNull() & F.col(instant).isNotNull()).select(F.col(entity).alias("entidad"), F.col(payload).alias("contenido"), F.col(instant).alias("us"), F.col(newest).alias("nuevo"))
    units = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("entidad", "contenido")}
    named = f"entidad {kinds['entidad']}, contenido {kinds['contenido']}, desde_us long, hasta_us long"
    runs, _ = materialize(units.mapInArrow(_local, f"parte int, orden long, {named}, hueco boolean, abierta boolean"), "runs")
    closed = runs.where("not abierta and contenido is not null").select("entidad", "contenido", "desde_us", "hasta_us")
    joined = runs.where("abierta").select("parte", "orden", "entidad", "contenido", "desde_us", "hasta_us", "hueco").groupBy("entidad").applyInArrow(_across, named)
    both = closed.unionByName(joined.where(F.col("contenido").isNotNull()))
    return both.select(F.col("entidad").alias(entity), F.col("contenido").alias(payload), "desde_us", "hasta_us")
