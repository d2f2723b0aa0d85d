import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canteria.operators import groups, skew


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {(root(x), x) for x in parent}


def grouped(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    return [tuple(r) for r in groups.connected_groups(df).collect()]


@pytest.mark.parametrize("in_task", [0, 40, 4096])
@pytest.mark.parametrize("shape", ["path", "star", "random", "cycle"])
def test_shapes(spark, monkeypatch, shape, in_task):
    monkeypatch.setattr(groups, "TASK_EDGES", in_task)
    rng = random.Random(3)
    names = [f"n{rng.random()}" for _ in range(120)]
    pairs = {
        "path": list(zip(names, names[1:])),
        "star": [(names[7], x) for x in names],
        "cycle": list(zip(names[:60], names[1:60] + names[:1])) + list(zip(names[61:], names[62:])),
        "random": [(rng.choice(names), rng.choice(names)) for _ in range(90)],
    }[shape]
    got = grouped(spark, pairs + pairs[:5] + [(b, a) for a, b in pairs[:9]])
    assert len(got) == len(set(got))
    assert set(got) == union_find(pairs)


@pytest.mark.parametrize("shape", ["star", "path"])
def test_hot_names_are_salted(spark, monkeypatch, shape):
    monkeypatch.setattr(groups, "TASK_EDGES", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    monkeypatch.setattr(skew, "HOT_SHARE", 10)
    names = [f"n{k}" for k in range(150)]
    pairs = [(names[7], x) for x in names] if shape == "star" else list(zip(names, names[1:]))
    assert set(grouped(spark, pairs + [("z1", "z2")])) == union_find([*pairs, ("z1", "z2")])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_rounds_in_memory(pairs):
    edges = sorted({tuple(sorted(p)) for p in pairs if p[0] != p[1]})
    c, p = groups.hook_all(*(np.array([e[k] for e in edges], np.int64) for k in (0, 1)))
    assert set(zip(p.tolist(), c.tolist())) == union_find(edges)


def test_nothing_and_self(spark):
    assert grouped(spark, []) == []
    assert grouped(spark, [("x", "x"), (None, "x"), (None, None)]) == []


def test_newest_assertion_decides(spark):
    rows = [
        (1, "http://A.test/x/", "https://b.test/y", "mirror"), (2, "https://b.test/y", "https://a.test/x", " Split "), (3, "https://a.test/x", "https://b.test/y", "similar"),
        (4, "https://c.test/", "https://d.test", "ESPEJO"), (5, None, "https://d.test", "mirror"), (6, " ", "https://d.test", "mirror"), (7, "https://e.test/?utm_x=1", "https://e.test", "mirror"),
        (8, "https://c.test/", "https://f.test/p?b=2&a=1#z", "mirror"), (9, "https://c.test/", "https://f.test/p?a=1&b=2", None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "seq long, referente_a string, referente_b string, relacion string, a string")
    got = {tuple(r) for r in groups.connected_groups(groups.decided_links(df)).collect()}
    c = "https://c.test/"
    assert got == {(c, c), (c, "https://d.test/"), (c, "https://f.test/p?a=1&b=2")}


def test_salted_lookup_is_a_join(spark):
    left = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 60_000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w")).unionByName(spark.createDataFrame([(7, 70)], "k long, w long"))
    plain = left.join(right, "k").select("v", "w")
    salted = skew.salted_lookup(left, right, ["k"], 60_000).select("v", "w")
    assert plain.count() == salted.count()
    assert plain.exceptAll(salted).count() == 0
