import json
import random
import re

import pyarrow as pa
import pytest

from canteria.operators import flatten
from canteria.operators.flatten import Level
from canteria.plans.found import JSON_LEVELS

RESULTS = JSON_LEVELS[1][2]


class Number(str):
    pass


def loads(text):
    def no(x):
        raise ValueError(x)

    return json.loads(text, parse_float=Number, parse_int=Number, parse_constant=no)


def unwrapped(x):
    if isinstance(x, str) and not isinstance(x, Number):
        try:
            y = loads(x)
            x = y if isinstance(y, (list, dict)) else x
        except ValueError:
            pass
    return x if isinstance(x, list) else [x]


def said(x):
    return {None: "", True: "true", False: "false"}[x] if x is None or isinstance(x, bool) else re.sub("[\ud800-\udfff]", "�", x)


def brute(x, level, place, seq, out):
    for i, e in enumerate(unwrapped(x)):
        if e is None:
            continue
        here = [*place, str(i)]
        value = e if level.valor is None or not isinstance(e, (dict, list)) else e.get(level.valor) if isinstance(e, dict) else None
        out.append((level.tipo, seq, ".".join(here), None if isinstance(value, (dict, list)) else said(value)))
        if isinstance(e, dict):
            for name, below in level.below.items():
                if name in e:
                    brute(e[name], below, here, seq, out)


def compare(texts, level):
    want = []
    for seq, t in enumerate(texts):
        if t is not None:
            try:
                brute(loads(t), level, [], seq, want)
            except ValueError:
                continue
    got = []
    for b in flatten.flatten_batch(pa.array(texts, pa.string()), pa.array(range(len(texts)), pa.int64()), level):
        got += zip(*(c.to_pylist() for c in b.columns))
    assert {x[:3] for x in got} == {x[:3] for x in want}
    assert len(got) == len(want)
    values = {x[:3]: x[3] for x in got}
    for x in want:
        if x[3] is not None:
            assert values[x[:3]] == x[3]


EDGES = [
    "", " ", "{}x", "[]", "[1,]", "[,1]", '{"fuente":1,"fuente":2}', '{"fuente":}', '{"a" "b"}', '["a\\u00e9\\ud83d\\ude00"]', "[nul]", "[1 2]", '"\\""', '"[1,2]"', '"{\\"fuente\\":\\"x\\"}"', "[[1,2],3]",
    '{"f\\u0075ente":"k"}', "[-0.0,1.50,1E5,01]", "[1.50,1E+5]", '["\t"]', '  [ null , "a" ]  ', '"', '\\"', "[}", "{]", "[]]", '{"citas":"[{\\"txt\\":1}]"}', '{"citas":["[1]"]}', '{"citas":{"notas":"n","txt":null}}',
    "nulll", "null", "true", '"a"x', "[NaN]", None, "[1]\\", '["ok"]', '["unfinished', "[1]", '{"a":[1,{"b":2}],"fuente":"z"}', '{"fuente":"' + "y" * 300_000 + '"}', "[" * 50 + "]" * 50,
]


@pytest.mark.parametrize("level", [x[2] for x in JSON_LEVELS], ids=[x[1] for x in JSON_LEVELS])
def test_edges(level):
    compare(EDGES, level)


def test_broken_copies():
    rng = random.Random(4)
    base = [t for t in EDGES if t and len(t) < 1000] + [json.dumps([{"fuente": "a", "citas": [{"txt": "q", "notas": ["n", None]}, "s"]}, None, "w"], indent=rng.choice([None, 1]))] * 5
    texts = []
    for _ in range(4000):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            i, op = rng.randrange(len(t) + 1), rng.random()
            t[i : i + (op < 0.7)] = rng.choice('{}[]:,"\\ \n0eE.-+nul tx') if op > 0.3 else ""
        texts.append("".join(t))
    compare(texts, RESULTS)


def test_lone_surrogate_becomes_a_replacement_mark():
    rows = [b.to_pylist() for b in flatten.flatten_batch(pa.array(['["\\ud800x"]']), pa.array([1], pa.int64()), Level("t"))]
    assert rows[0][0]["valor"] == "�x"


def test_small_pieces_give_the_same(monkeypatch):
    monkeypatch.setattr(flatten, "TAPE_BYTES", 7)
    compare(EDGES[:30], RESULTS)


def test_frames(spark):
    df = spark.createDataFrame([(1, '["a"]', "x"), (None, '["b"]', "x"), (3, None, "x"), (1, '["a"]', "x")], "seq long, j string, valor string")
    got = sorted((str(r.seq), r.ruta, r.valor) for r in flatten.flatten_json(df, "j", Level("t")).collect())
    assert got == [("1", "0", "a"), ("1", "0", "a"), ("None", "0", "b")]
    assert flatten.flatten_json(df.limit(0), "j", Level("t")).count() == 0
