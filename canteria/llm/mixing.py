"""Sources mixed to target weights.

The texts of each source, laid end to end, are cut into blocks of a fixed
number of tokens.  Each output shard draws how many blocks it takes from each
source; the draws of a source count its slots, a keyed permutation of its
block numbers per pass turns slots into blocks, and blocks are joined by
source and number.  Draws and permutations are functions of a seed and a
number, so each task makes those of its own shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import materialize, shuffle_partitions

BLOCK_TOKENS = 512
SHARD_BLOCKS = 1024
#: Beyond so many blocks numpy has no exact draw without replacement.
EXACT_BLOCKS = 1_000_000_000
SEED = 20_240_607


def weights_of(mezcla: DataFrame) -> dict[str, tuple[float, int]]:
    """source to (weight, most uses), from the fixed table of weights; sources without a positive weight and use are left out."""
    rows = mezcla.where(F.col("source").isNotNull() & (F.col("peso") > 0) & (F.col("max_rep") > 0)).groupBy(F.lower(py_strip(F.col("source"))).alias("source")).agg(F.max("peso").alias("peso"), F.max("max_rep").alias("max_rep"))
    return {r["source"]: (float(r["peso"]), int(r["max_rep"])) for r in rows.collect()}


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: four Feistel rounds, walked on until within range."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    low = np.uint64((1 << half) - 1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(4):
            mixed = (right + np.uint64((key + r * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            mixed = (mixed * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)
            left, right = right, left ^ (mixed & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= n
    return out.astype(np.int64)


def quotas(tokens: dict[str, int], weights: dict[str, tuple[float, int]], total: float | None = None, strict: bool = False) -> dict[str, float]:
    """Tokens to take from each source.

    ``total`` defaults to all tokens there are.  A source whose share would
    need more than its tokens times its most uses gives all of those, and the
    others share the rest by weight.  ``strict`` takes instead the largest
    total at which every source with tokens has exactly its share.
    """
    there = {s: (w, tokens[s] * rep) for s, (w, rep) in weights.items() if tokens.get(s)}
    if not there:
        return {}
    whole = sum(w for w, _ in there.values())
    most = min(c * whole / w for w, c in there.values()) if strict else sum(c for _, c in there.values())
    want = min(most, total if total is not None else most if strict else sum(tokens[s] for s in there))
    fixed: dict[str, float] = {}
    while True:
        free = {s: w for s, (w, _) in there.items() if s not in fixed}
        left, scale = want - sum(fixed.values()), sum(free.values())
        over = {s: there[s][1] for s, w in free.items() if left * w / scale > there[s][1] * (1 + 1e-12)}
        if not over:
            return fixed | {s: left * w / scale for s, w in free.items()}
        fixed |= over


def _split(left: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``left`` blocks of each source fall among the first ``size`` of all of them."""
    total = int(left.sum())
    if total < EXACT_BLOCKS:
        return rng.multivariate_hypergeometric(left, size, method="marginals")
    out, room, rest = np.zeros(len(left), np.int64), size, total
    for k in np.argsort(left, kind="stable"):  # the rarest first, so that the commonest takes up what is over
        rest -= int(left[k])
        drawn = int(rng.binomial(int(left[k]), room / (rest + int(left[k])))) if room else 0
        out[k] = min(max(drawn, room - rest), room, int(left[k]))
        room -= int(out[k])
    return out


def draw_counts(quota: np.ndarray, shard_blocks: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of each source in a shard, those in all shards before it).

    A multinomial draw under the condition that all shards together take each
    source's quota exactly.  The shards are halved again and again; at each
    halving the counts are drawn that fall to the left half, by a generator
    keyed with the place of the halving.  So a shard's draw costs a logarithm
    of their number, needs no other shard's, and is the same wherever it is made.
    """
    quota, before = np.asarray(quota, np.int64), np.zeros(len(quota), np.int64)
    begin, end = 0, -(-int(quota.sum()) // shard_blocks)
    while end - begin > 1:
        middle = (begin + end) // 2
        left = _split(quota, (middle - begin) * shard_blocks, np.random.default_rng([seed, begin, end]))
        if shard < middle:
            quota, end = left, middle
        else:
            quota, before, begin = quota - left, before + left, middle
    return quota, before


def _local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running start of each text within its source and sorted partition."""
    from pyspark import TaskContext

    part, totals = TaskContext.get().partitionId(), {}
    for b in batches:
        source, tokens = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
        start = np.zeros(len(tokens), np.int64)
        for s in pd.unique(source):
            at = np.flatnonzero(source == s)
            run = np.cumsum(tokens[at])
            start[at] = run - tokens[at] + totals.get(s, 0)
            totals[s] = totals.get(s, 0) + int(run[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), part, np.int32)), b.column(0), b.column(1), b.column(2), pa.array(start)], names=["parte", "source", "doc_id", "tokens", "inicio"])


def source_stream(lengths: DataFrame, sources: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """Texts with the place of their first token in their source's stream, ordered by doc_id, and the tokens of each source.

    The sums run inside sorted partitions; only one number per partition and
    source goes to the driver, so no source is ever in one task.
    """
    spark = lengths.sparkSession
    rows = lengths.where(F.col("source").isin(*sources) & (F.col("tokens") > 0)).select("source", "doc_id", "tokens")
    placed = rows.repartitionByRange(shuffle_partitions(spark), "source", "doc_id").sortWithinPartitions("source", "doc_id")
    placed, _ = materialize(placed.mapInArrow(_local_sums, "parte int, source string, doc_id long, tokens long, inicio long"), "stream")
    sums = {(r["parte"], r["source"]): r["t"] for r in placed.groupBy("parte", "source").agg(F.sum("tokens").alias("t")).collect()}
    totals: dict[str, int] = {}
    offsets = []
    for (part, source), t in sorted(sums.items()):
        offsets.append((part, source, totals.get(source, 0)))
        totals[source] = totals.get(source, 0) + t
    table = spark.createDataFrame(offsets, "parte int, source string, base long")
    stream = placed.join(F.broadcast(table), ["parte", "source"]).select("source", "doc_id", "tokens", (F.col("inicio") + F.col("base")).alias("inicio"))
    return stream, totals


def mix(lengths: DataFrame, weights: dict[str, tuple[float, int]], total_tokens: float | None = None, strict: bool = False, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """(lote, posicion, source, bloque, doc_id, inicio, tokens): the mixture, one row per text in a block.

    ``lengths`` has source, doc_id and tokens.  lote and posicion are the
    output shard and the place of the block in it; inicio is the first token
    of the text that lies in the block.  No block, and so no token of a text,
    is used more often than its source allows; every pass over a source uses
    each of its blocks once.  Sources are compared trimmed and in lower case;
    texts without a weighted source or without tokens are not part of it, and
    the last block of a source may be short.
    """
    spark = lengths.sparkSession
    lengths = lengths.withColumn("source", F.lower(py_strip(F.col("source"))))
    stream, totals = source_stream(lengths, sorted(weights))
    blocks = {s: math.ceil(t / block_tokens) for s, t in totals.items()}
    wanted = quotas(totals, weights, total_tokens, strict)
    quota = {s: min(blocks[s] * weights[s][1], round(wanted[s] * blocks[s] / totals[s])) for s in sorted(wanted)}
    quota = {s: n for s, n in quota.items() if n}
    names, sizes, wants = list(quota), [blocks[s] for s in quota], np.array(list(quota.values()), np.int64)
    shards = spark.range(-(-int(wants.sum()) // SHARD_BLOCKS), numPartitions=shuffle_partitions(spark)).withColumnRenamed("id", "lote")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lote in b.column(0).to_pylist():
                n, desde = draw_counts(wants, SHARD_BLOCKS, lote, seed)
                which, block = [], []
                for k, size in enumerate(sizes):
                    slot = desde[k] + np.arange(n[k])
                    lap = slot // size
                    for e in np.unique(lap):
                        at = slot[lap == e] % size
                        block.append(permute(at, size, seed + 1_000_003 * k + int(e)))
                        which.append(np.full(len(at), k))
                which, block = np.concatenate(which), np.concatenate(block)
                place = np.random.default_rng([seed, lote]).permutation(len(block))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), lote)), pa.array(place), pa.array(names).take(pa.array(which)), pa.array(block)], names=["lote", "posicion", "source", "bloque"])

    taken = shards.mapInArrow(slots, "lote long, posicion long, source string, bloque long")
    first, last = F.floor(F.col("inicio") / block_tokens), F.floor((F.col("inicio") + F.col("tokens") - 1) / block_tokens)
    spread = stream.select("source", "doc_id", "tokens", "inicio", F.explode(F.sequence(first, last)).alias("bloque"))
    begin = F.greatest(F.col("inicio"), F.col("bloque") * block_tokens)
    end = F.least(F.col("inicio") + F.col("tokens"), (F.col("bloque") + 1) * block_tokens)
    pieces = spread.select("source", "bloque", "doc_id", (begin - F.col("inicio")).alias("inicio"), (end - begin).alias("tokens"))
    return taken.join(pieces, ["source", "bloque"]).select("lote", "posicion", "source", "bloque", "doc_id", "inicio", "tokens")


def shares(mixture: DataFrame, mezcla: DataFrame) -> DataFrame:
    """(source, objetivo, alcanzado, tokens, bloques): target and reached share of every source of the table of weights."""
    spark = mixture.sparkSession
    weights = weights_of(mezcla)
    whole = sum(w for w, _ in weights.values()) or 1.0
    rows = mixture.groupBy("source", "lote", "posicion").agg(F.sum("tokens").alias("t")).groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("bloques")).collect()  # one row per source
    got = {r["source"]: (int(r["tokens"]), int(r["bloques"])) for r in rows}
    total = sum(t for t, _ in got.values()) or 1
    out = [(s, w / whole, got.get(s, (0, 0))[0] / total, *got.get(s, (0, 0))) for s, (w, _) in sorted(weights.items())]
    return spark.createDataFrame(out, "source string, objetivo double, alcanzado double, tokens long, bloques long")
