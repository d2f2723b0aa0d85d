"""Texts packed into containers of fixed capacity by minimum bin slack.

A container is filled around the longest text still open: a subset-sum over
bitsets finds the multiset of remaining lengths that brings it closest to its
capacity, and walking the bitsets back gives the counts.  The same filling is
repeated as often as the counts allow, so the work depends on the number of
different lengths, not of texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts solved together; a shard is one task's work, and loses at most about one container.
SHARD_DOCS = 50_000


def closest_fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` as far as possible without passing it.

    ``lengths`` are those with a positive count, in falling order.
    """
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    full = 1 << room
    for length in lengths:
        if length > room:
            continue
        most, chunk = min(counts[length], room // length), 1
        while most > 0 and not bits & full:
            take = min(chunk, most)
            steps.append((length, take, bits))
            bits |= (bits << (take * length)) & mask
            most -= take
            chunk *= 2
        if bits & full:
            break
    reached, out = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> reached & 1:
            out[length] = out.get(length, 0) + take
            reached -= take * length
    return out


def solve(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(filling, times): fillings of containers that use up all lengths, each 1 to ``capacity``."""
    counts = dict(counts)
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        filling = closest_fill(counts, [x for x in lengths if counts[x]], capacity - seed)
        counts[seed] += 1
        filling[seed] = filling.get(seed, 0) + 1
        times = min(counts[x] // k for x, k in filling.items())
        for x, k in filling.items():
            counts[x] -= k * times
        lengths = [x for x in lengths if counts[x]]
        out.append((filling, times))
    return out


def assign(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item; items are 1 to ``capacity`` long."""
    values, counts = np.unique(lengths, return_counts=True)
    order = np.argsort(lengths, kind="stable")
    cursor = dict(zip(values.tolist(), (np.cumsum(counts) - counts).tolist()))
    out, box = np.empty(len(lengths), np.int64), 0
    for filling, times in solve(dict(zip(values.tolist(), counts.tolist())), capacity):
        for length, k in filling.items():
            a = cursor[length]
            out[order[a : a + k * times]] = box + np.arange(k * times) // k
            cursor[length] = a + k * times
        box += times
    return out


def pack_shard(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(container, text, part, start, size) of every piece of one shard's texts; containers count from 0, -1 for a text without tokens."""
    full = np.where(tokens > capacity, tokens // capacity, 0)
    rest = tokens - full * capacity
    whole = np.repeat(np.arange(len(tokens)), full)
    part = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
    item, none = np.flatnonzero(rest > 0), np.flatnonzero(tokens == 0)
    box = assign(rest[item], capacity) if len(item) else np.zeros(0, np.int64)
    used = int(box.max()) + 1 if len(box) else 0
    zeros = np.zeros(len(none), np.int64)
    return (
        np.concatenate([used + np.arange(len(whole)), box, zeros - 1]),
        np.concatenate([whole, item, none]),
        np.concatenate([part, full[item], zeros]),
        np.concatenate([part * capacity, full[item] * capacity, zeros]),
        np.concatenate([np.full(len(whole), capacity), rest[item], zeros]),
    )


def _usable(containers: list[tuple[str, int]]) -> list[tuple[str, int]]:
    return [(name, int(c)) for name, c in containers if name is not None and c is not None and c > 0]


def pack(lengths: DataFrame, containers: list[tuple[str, int]], shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(envase, contenedor, doc_id, parte, inicio, tokens): every text in containers of every kind.

    ``lengths`` has doc_id and tokens, one row per text (a repeated row is one
    more text, a null doc_id is kept).  A text longer than the capacity is cut
    into full containers and a rest, its pieces numbered by ``parte`` and
    starting at token ``inicio``; no other text is split.  A text without
    tokens needs none: its contenedor is null.  Kinds without a positive
    capacity are left out.  ``lengths`` is read twice, so it should be a
    stored table.
    """
    kinds = _usable(containers)
    shards = max(1, math.ceil(lengths.count() / shard_docs))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("tokens", "ascending")]).combine_chunks()
        lote, tokens, parts = table["lote"][0].as_py(), table["tokens"].to_numpy(), []
        for name, capacity in kinds:
            box, text, part, start, size = pack_shard(tokens, capacity)
            number = pa.array(box * shards + lote, mask=box < 0)
            columns = [pa.array([name] * len(box), pa.string()), number, table["doc_id"].take(pa.array(text)).combine_chunks(), pa.array(part.astype(np.int32)), pa.array(start), pa.array(size)]
            parts.append(pa.Table.from_arrays(columns, names=["envase", "contenedor", "doc_id", "parte", "inicio", "tokens"]))
        return pa.concat_tables(parts) if parts else _NOTHING

    sharded = lengths.select(F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(shards)).alias("lote"), "doc_id", "tokens")
    return sharded.groupBy("lote").applyInArrow(run, "envase string, contenedor long, doc_id long, parte int, inicio long, tokens long")


_NOTHING = pa.schema([("envase", pa.string()), ("contenedor", pa.int64()), ("doc_id", pa.int64()), ("parte", pa.int32()), ("inicio", pa.int64()), ("tokens", pa.int64())]).empty_table()


def packing_report(packed: DataFrame, containers: list[tuple[str, int]]) -> DataFrame:
    """(envase, contenedores, piezas, tokens, hueco): what was packed, and the tokens of space left over; no kind of container gives no row."""
    capacity = F.create_map(*[x for name, c in dict(_usable(containers)).items() for x in (F.lit(name), F.lit(c))]).cast("map<string, long>")
    boxes = packed.where(F.col("contenedor").isNotNull()).groupBy("envase", "contenedor").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    total = boxes.groupBy("envase").agg(F.count(F.lit(1)).alias("contenedores"), F.sum("n").alias("piezas"), F.sum("t").alias("tokens"))
    return total.withColumn("hueco", F.col("contenedores") * capacity[F.col("envase")] - F.col("tokens"))
