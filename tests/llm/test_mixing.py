from collections import Counter

import numpy as np
import pytest

from canteria.llm import mixing


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    a, b = mixing.permute(np.arange(n), n, 1), mixing.permute(np.arange(n), n, 2)
    assert sorted(a) == list(range(n)) == sorted(b)
    assert n < 100 or ((a != b).mean() > 0.9 and (a != np.arange(n)).mean() > 0.9)


def test_quotas():
    got = mixing.quotas({"a": 1000, "b": 1000, "c": 10}, {"a": (6.0, 1), "b": (3.0, 1), "c": (1.0, 2), "d": (5.0, 9)})
    assert got["c"] == 20 and sum(got.values()) == 2010 and got["a"] == got["b"] + 0 * got["a"] or got["a"] == 1000
    assert got["a"] == 1000 and got["b"] == 990
    strict = mixing.quotas({"a": 1000, "b": 1000, "c": 10}, {"a": (6.0, 1), "b": (3.0, 1), "c": (1.0, 2)}, strict=True)
    assert strict == {"a": 120, "b": 60, "c": 20}
    assert mixing.quotas({}, {"a": (1.0, 1)}) == {}


def all_draws(quota, shard_blocks, seed):
    pairs = [mixing.draw_counts(quota, shard_blocks, k, seed) for k in range(-(-sum(quota) // shard_blocks))]
    return np.array([n for n, _ in pairs]), np.array([b for _, b in pairs])


@pytest.mark.parametrize("exact", [10**9, 0, 2000])
def test_draws_add_up_to_the_quotas(monkeypatch, exact):
    monkeypatch.setattr(mixing, "EXACT_BLOCKS", exact)
    counts, before = all_draws([5000, 300, 7], 100, 3)
    assert counts.sum(axis=0).tolist() == [5000, 300, 7] and (counts.sum(axis=1)[:-1] == 100).all() and (counts >= 0).all()
    assert (before == np.cumsum(counts, axis=0) - counts).all()
    assert counts[:, 0].std() > 0.5  # drawn, not dealt out evenly
    assert abs(counts[:-1, 1].mean() - 300 / 53.07) < 0.5


def test_a_draw_of_very_many_shards_needs_no_other():
    quota = np.array([6 * 10**13, 3 * 10**12, 5, 0])
    shards = -(-int(quota.sum()) // mixing.SHARD_BLOCKS)
    for shard in (0, 1, shards // 3, shards - 1):
        (n, before), (_, following) = mixing.draw_counts(quota, mixing.SHARD_BLOCKS, shard, 1), mixing.draw_counts(quota, mixing.SHARD_BLOCKS, min(shard + 1, shards - 1), 1)
        assert n.sum() == mixing.SHARD_BLOCKS or shard == shards - 1
        assert shard == shards - 1 or (before + n == following).all()
        assert (before + n <= quota).all()
    assert (before + n == quota).all()


def table(spark, docs):
    return spark.createDataFrame([(s, i, t, 9) for s, i, t in docs], "source string, doc_id long, tokens long, lote int")


DOCS = [("big", i, 50 + i % 7) for i in range(2000)] + [(" Small ", 10_000 + i, 100) for i in range(10)] + [("other", 20_000, 5000), (None, 20_001, 50), ("big", 20_002, 0), ("BIG", 20_003, 7000)]
WEIGHTS = {"big": (3.0, 1), "small": (2.0, 4), "absent": (1.0, 3)}


def test_mixture(spark):
    rows = mixing.mix(table(spark, DOCS), WEIGHTS, block_tokens=64).collect()
    used = Counter((r.source, r.bloque, r.doc_id, r.inicio) for r in rows)
    assert max(n for (s, *_), n in used.items() if s == "big") == 1
    assert max(n for (s, *_), n in used.items() if s == "small") == 4
    per_token = Counter()
    for r in rows:
        per_token[r.doc_id] += r.tokens
    sizes = {i: t for _, i, t in DOCS}
    assert all(n <= sizes[i] * (4 if 10_000 <= i < 20_000 else 1) for i, n in per_token.items())
    assert {r.source for r in rows} == {"big", "small"}
    blocks = Counter()
    for r in rows:
        blocks[(r.lote, r.posicion, r.source, r.bloque)] += r.tokens
    assert max(blocks.values()) == 64 and len({k[:2] for k in blocks}) == len(blocks)
    assert sum(1 for n in blocks.values() if n < 64) <= 1 + 4
    again = mixing.mix(table(spark, DOCS).repartition(3), WEIGHTS, block_tokens=64).collect()
    assert sorted(rows) == sorted(again)


def test_strict_shares_hold(spark):
    mezcla = spark.createDataFrame([("Big ", 3.0, 1), ("small", 2.0, 4), ("absent", 1.0, 3), (None, 1.0, 1), ("zero", 0.0, 1), ("off", 1.0, 0)], "source string, peso double, max_rep int")
    assert mixing.weights_of(mezcla) == WEIGHTS
    mixture = mixing.mix(table(spark, DOCS), WEIGHTS, strict=True, block_tokens=20)
    got = {r.source: r for r in mixing.shares(mixture, mezcla).collect()}
    assert got["small"].alcanzado == pytest.approx(0.4, abs=0.01) and got["big"].alcanzado == pytest.approx(0.6, abs=0.01)
    assert got["absent"].tokens == 0 and got["small"].tokens == 4000


def test_nothing(spark):
    assert mixing.mix(table(spark, []), WEIGHTS).count() == 0
    assert mixing.mix(table(spark, DOCS), {}).count() == 0
