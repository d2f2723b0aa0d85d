import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canteria.operators.history import coalesce_history, merge_rounds

SCHEMA = "e string, p string, t long, s long, entidad string, desde_us int"


def brute(rows):
    seen = {}
    for e, p, t, s in rows:
        if e is not None and t is not None and ((e, t) not in seen or seen[(e, t)][0] < s):
            seen[(e, t)] = (s, p)
    out = set()
    for e in {k[0] for k in seen}:
        run = None
        for t in sorted(t for x, t in seen if x == e):
            p = seen[(e, t)][1]
            if run and run[0] == p:
                continue
            if run and run[0] is not None:
                out.add((e, run[0], run[1], t))
            run = (p, t)
        if run[0] is not None:
            out.add((e, run[0], run[1], -1))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = [tuple(r) for r in coalesce_history(df, "e", "p", "t", "s").select("e", "p", "desde_us", "hasta_us").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_one_entity_over_all_partitions(spark):
    rng = random.Random(1)
    check(spark, [("hot", rng.choice("ab") if rng.random() < 0.9 else None, rng.randrange(2500), i) for i in range(3000)])


def test_long_runs_across_partitions(spark):
    check(spark, [("hot", "a" if i < 1700 else "b", i, i) for i in range(2000)] + [("z", "a", 5, 9000)])
    check(spark, [("hot", "a", i, i) for i in range(2000)])


def test_many_entities_ties_and_nulls(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), rng.choice([None, *range(20)]), i) for i in range(400)]
    check(spark, rows + [(e, p, t, s + 10_000) for e, p, t, s in rows[:50]])


def test_one_instant_over_all_partitions(spark):
    rng = random.Random(3)
    hot = [("hot", rng.choice("ab"), 5, i) for i in range(3000)]
    check(spark, [("hot", "a", 1, -1), *hot, ("hot", "b", 9, 5000)])
    check(spark, [("hot", "b", 1, -1), *hot, ("hot", hot[-1][1], 5, 6000), ("a", "x", 5, 1), ("z", "x", 5, 1)])


@pytest.mark.parametrize("batch", [1, 2, 7])
def test_small_batches_make_the_same_tree(spark, batch):
    rng = random.Random(batch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        check(spark, [(rng.choice("eee f".replace(" ", "g")), rng.choice(["x", "y", None]), rng.randrange(40), i) for i in range(300)])
        check(spark, [("e", "x" if i < 90 else "y", i // 3, i) for i in range(120)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    check(spark, [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), max_size=70))
def test_merge_rounds_finds_every_change(pairs):
    e, p = (np.array([x[k] for x in pairs], np.int64) for k in (0, 1))
    want = [i for i in range(len(pairs)) if i == 0 or pairs[i] != pairs[i - 1]]
    assert merge_rounds(e, p).tolist() == want
