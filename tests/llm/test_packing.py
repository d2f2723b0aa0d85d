import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canteria.llm import packing

KINDS = [("corto", 16), ("medio", 64), ("raro", None), ("nada", 0)]


def best_sum(items, room):
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=14), st.integers(0, 60))
def test_closest_fill_is_the_closest(items, room):
    counts = Counter(items)
    got = packing.closest_fill(counts, sorted(counts, reverse=True), room)
    assert all(got[x] <= counts[x] for x in got)
    assert sum(x * k for x, k in got.items()) == best_sum(items, room)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=200))
def test_assign_fits(items):
    box = packing.assign(np.array(items), 40)
    fill = np.bincount(box, weights=items)
    assert fill.max() <= 40 and (fill > 0).all()
    # No worse than any-fit: two containers never fit into one.
    small = np.sort(fill)[:2]
    assert len(fill) < 2 or small.sum() > 40


def rows(spark, lengths, shard_docs=10_000):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in lengths], "doc_id long, tokens long, envase string, lote int")
    return packing.pack(df, KINDS, shard_docs).collect()


@pytest.mark.parametrize("shard_docs", [10_000, 150])
def test_pack(spark, shard_docs):
    rng = random.Random(5)
    lengths = [(i, rng.choice([0, 3, 5, 7, 16, 17, 40, 64, 65, 300, rng.randint(1, 64)])) for i in range(1000)]
    out = rows(spark, lengths, shard_docs)
    for kind, capacity in KINDS[:2]:
        mine = [r for r in out if r.envase == kind]
        fill = Counter()
        for r in mine:
            if r.contenedor is not None:
                fill[r.contenedor] += r.tokens
        assert max(fill.values()) <= capacity
        per_doc = {}
        for r in mine:
            per_doc.setdefault(r.doc_id, []).append(r)
        for i, t in lengths:
            pieces = sorted(per_doc[i], key=lambda r: r.parte)
            assert sum(r.tokens for r in pieces) == t
            assert [r.inicio for r in pieces] == [sum(x.tokens for x in pieces[:k]) for k in range(len(pieces))]
            assert len(pieces) == 1 or t > capacity
            assert (pieces[0].contenedor is None) == (t == 0)
        total = sum(t for _, t in lengths)
        assert len(fill) <= -(-total // capacity) + 3 * -(-1000 // shard_docs)
    assert {r.envase for r in out} == {"corto", "medio"}


def test_nulls_repeats_and_nothing(spark):
    out = rows(spark, [(None, 5), (None, 5), (2**60 + 1, 16), (2**60 + 1, 16)])
    mine = sorted((str(r.doc_id), r.tokens) for r in out if r.envase == "corto")
    assert mine == sorted([("None", 5), ("None", 5), (str(2**60 + 1), 16), (str(2**60 + 1), 16)])
    assert rows(spark, []) == []


def test_report(spark):
    df = packing.pack(spark.createDataFrame([(1, 10), (2, 6), (3, 20), (4, 0)], "doc_id long, tokens long"), KINDS[:2])
    got = {r.envase: (r.contenedores, r.piezas, r.tokens, r.hueco) for r in packing.packing_report(df, KINDS[:2]).collect()}
    assert got == {"corto": (3, 4, 36, 12), "medio": (1, 3, 36, 28)}


def test_no_usable_container(spark):
    lengths = spark.createDataFrame([(1, 5)], "doc_id long, tokens long")
    for kinds in ([], [(None, 5), ("x", None), ("y", 0)]):
        assert packing.packing_report(packing.pack(lengths, kinds), kinds).count() == 0
