"""The queries over all rows of the smallest tables: what they must hold whatever the draw or the order."""

import subprocess
import sys
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

import __spark_entry__
from canteria.llm import mixing, queries, tokens

QUERIES = queries.queries()


def stored(data, table):
    return pq.read_table(f"{data}/{table}.parquet").to_pylist()


@pytest.fixture(scope="module")
def lengths(data):
    enc = tokens.encoding(tokens.TOKENIZER_DIR, tokens.VOCABULARY)
    return {r["doc_id"]: len(enc.encode_ordinary(r["text"] or "")) for r in stored(data, "documents")}


@pytest.fixture(scope="module")
def source_of(data):
    return {r["doc_id"]: (r["source"] or "").strip().lower() for r in stored(data, "documents")}


def test_p6_places_every_token_once_and_splits_only_what_is_too_long(spark, data, lengths):
    rows = QUERIES["p6_packing"](spark, data).collect()
    report = {r.envase: r for r in QUERIES["p6_report"](spark, data).collect()}
    for box in stored(data, "envase"):
        mine, capacity = [r for r in rows if r.envase == box["envase"]], box["capacidad"]
        pieces = defaultdict(list)
        for r in mine:
            pieces[r.doc_id].append((r.inicio, r.tokens, r.parte, r.contenedor))
        assert set(pieces) == set(lengths)
        for doc, parts in pieces.items():
            parts.sort()
            n = lengths[doc]
            assert sum(t for _, t, _, _ in parts) == n and [a for a, *_ in parts] == [k * capacity for k in range(len(parts))] and [p for _, _, p, _ in parts] == list(range(len(parts)))
            assert len(parts) == max(1, -(-n // capacity)) and all((c is None) == (n == 0) for *_, c in parts)
        filled = Counter()
        for r in mine:
            if r.contenedor is not None:
                filled[r.contenedor] += r.tokens
        total = sum(lengths.values())
        assert max(filled.values()) <= capacity and sum(filled.values()) == total
        assert len(filled) - -(-total // capacity) <= 1 + sum(2 * n > capacity for n in lengths.values() if n <= capacity)
        r = report[box["envase"]]
        assert (r.contenedores, r.tokens, r.hueco) == (len(filled), total, len(filled) * capacity - total) and r.piezas == sum(x.contenedor is not None for x in mine)


def _weights(data):
    return {r["source"]: (r["peso"], r["max_rep"]) for r in stored(data, "mezcla")}


@pytest.mark.parametrize("strict", [False, True])
def test_p7_uses_no_token_too_often_and_reaches_its_shares(spark, data, lengths, source_of, strict):
    tail = "_strict" if strict else ""
    rows, weights = QUERIES[f"p7_mixture{tail}"](spark, data).collect(), _weights(data)
    whole = Counter()
    for doc, n in lengths.items():
        whole[source_of[doc]] += n
    used, blocks, got = defaultdict(Counter), defaultdict(int), Counter()
    for r in rows:
        assert source_of[r.doc_id] == r.source and 0 <= r.inicio and r.inicio + r.tokens <= lengths[r.doc_id]
        used[r.source][(r.doc_id, r.inicio)] += 1
        blocks[(r.lote, r.posicion)] += r.tokens
        got[r.source] += r.tokens
    assert all(max(c.values()) <= weights[s][1] for s, c in used.items())
    assert max(blocks.values()) <= mixing.BLOCK_TOKENS and len({(r.lote, r.posicion, r.source, r.bloque) for r in rows}) == len(blocks)
    there = {s: w for s, (w, _) in weights.items() if whole[s]}
    wanted = mixing.quotas(whole, weights, strict=strict)
    assert set(got) == {s for s in wanted if round(wanted[s] / mixing.BLOCK_TOKENS)} and all(abs(got[s] - wanted[s]) <= 2 * mixing.BLOCK_TOKENS * max(1, weights[s][1]) for s in got)
    if strict:
        assert all(wanted[s] == pytest.approx(sum(wanted.values()) * w / sum(there.values())) for s, w in there.items())
    shares = {r.source: r for r in QUERIES[f"p7_shares{tail}"](spark, data).collect()}
    assert set(shares) == set(weights) and sum(r.alcanzado for r in shares.values()) == pytest.approx(1.0)
    assert {s: r.tokens for s, r in shares.items() if r.tokens} == dict(got) and all(r.objetivo == pytest.approx(weights[s][0] / sum(w for w, _ in weights.values())) for s, r in shares.items())


def test_p8_covers_every_text_with_spans_that_do_not_meet(spark, data):
    spans = defaultdict(list)
    for r in QUERIES["p8_found"](spark, data).collect():
        spans[r.doc_id].append((r.inicio, r.fin))
    for d in stored(data, "documents"):
        text, mine = d["text"] or "", sorted(spans[d["doc_id"]])
        assert all(a < b for a, b in mine) and all(x[1] <= y[0] for x, y in zip(mine, mine[1:]))
        assert all(text[a:b] == text[a:b].strip() for a, b in mine)
        assert not "".join(text[a:b] for a, b in zip([0, *(b for _, b in mine)], [*(a for a, _ in mine), len(text)])).strip()
        assert all("\n\n" not in text[a:b] for a, b in mine)


def test_entry_has_them():
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_nothing_else_imports_this_package():
    code = "import sys; import canteria.plans.registry, canteria.cli, canteria.streaming.log_stream; sys.exit(any(m.startswith('canteria.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0
