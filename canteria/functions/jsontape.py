"""JSON texts of a whole Arrow batch as one tape of tokens, by array arithmetic.

Nothing here loops over rows: quotes, brackets and scalars are found by their
bytes in the batch's data buffer, nesting by running sums, parents by binary
search, and the grammar is checked between neighbouring tokens.  A row whose
text is not valid JSON is marked and has no values.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COLON, COMMA, STRING, SCALAR = range(1, 9)

_STRUCT = np.zeros(256, np.int8)
for _ch, _kind in (("{", OPEN_OBJ), ("}", CLOSE_OBJ), ("[", OPEN_ARR), ("]", CLOSE_ARR), (":", COLON), (",", COMMA)):
    _STRUCT[ord(_ch)] = _kind
_OTHER = np.ones(256, bool)
for _ch in '{}[]:,"':
    _OTHER[ord(_ch)] = False
for _ch in " \t\n\r":
    _OTHER[ord(_ch)] = False
_HEX = np.zeros(256, bool)
for _ch in "0123456789abcdefABCDEF":
    _HEX[ord(_ch)] = True
_ESCAPABLE = np.zeros(256, bool)
for _ch in '"\\/bfnrtu':
    _ESCAPABLE[ord(_ch)] = True

_SCALARS = r"\A(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)\z"


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges [start, end) of ``data`` as a string array."""
    length = end - start
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    picked = data[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(picked))])


class Tape:
    """Tokens of all rows in order: ``kind``, ``start`` and ``end`` (byte range), ``row``, ``parent`` (its bracket token, -1 at the top)."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        raw = texts.buffers()[2]
        whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = b = whole[offsets[0] : offsets[-1]]
        self.bounds = bounds = offsets - offsets[0]
        self.valid = np.ones(n, bool)
        self._tokens(b, bounds, n)
        self._nest(n)
        self._grammar()
        self._scalars(b)
        self._children()

    def _row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1

    def _tokens(self, b: np.ndarray, bounds: np.ndarray, n: int) -> None:
        size = len(b)
        back = np.flatnonzero(b == 92)
        if len(back):
            fresh = np.concatenate([[True], np.diff(back) != 1]) | np.isin(back, bounds)
            index = np.arange(len(back))
            back = back[(index - np.maximum.accumulate(np.where(fresh, index, 0))) % 2 == 0]  # the backslashes that escape
        escaped = back + 1
        escaped = escaped[~np.isin(escaped, bounds)]  # a backslash at the end of a row escapes nothing
        is_escaped = np.zeros(size + 1, bool)
        is_escaped[escaped] = True
        quote = np.flatnonzero((b == 34) & ~is_escaped[:size])
        quote_row = self._row(quote)
        count = np.bincount(quote_row, minlength=n)
        self.valid &= count % 2 == 0
        quote = quote[self.valid[quote_row]]
        opening, closing = quote[0::2], quote[1::2]
        inside = np.zeros(size + 1, np.int8)
        inside[opening] = 1
        inside[closing + 1] -= 1
        inside = np.cumsum(inside[:size], dtype=np.int8).astype(bool)
        # Escapes, and no control characters, within strings.
        within = escaped[inside[escaped - 1]]
        bad = within[~_ESCAPABLE[b[within]]]
        uni = within[b[within] == ord("u")]
        padded = np.concatenate([b, np.zeros(5, np.uint8)])
        hexed = np.ones(len(uni), bool)
        for k in range(1, 5):
            hexed &= _HEX[padded[uni + k]]
        for wrong in (bad, uni[~hexed], np.flatnonzero(inside & (b < 32))):
            self.valid[self._row(wrong)] = False
        kinds = np.where(inside, 0, _STRUCT[b]) if size else np.zeros(0, np.int8)
        struct = np.flatnonzero(kinds)
        other = _OTHER[b] & ~inside
        edge = np.zeros(size + 1, bool)
        edge[bounds] = True
        before = np.concatenate([[False], other[:-1]]) if size else other
        first = np.flatnonzero(other & (~before | edge[:size]))
        after = np.concatenate([other[1:], [False]]) if size else other
        last = np.flatnonzero(other & (~after | edge[1:]))
        start = np.concatenate([struct, opening, first])
        end = np.concatenate([struct + 1, closing + 1, last + 1])
        kind = np.concatenate([kinds[struct], np.full(len(opening), STRING, np.int8), np.full(len(first), SCALAR, np.int8)])
        order = np.argsort(start, kind="stable")
        self.start, self.end, self.kind = start[order], end[order], kind[order].astype(np.int8)
        self.row = self._row(self.start)
        escapes = np.zeros(size + 1, np.int32)
        escapes[1:] = np.cumsum(b == 92)
        self._escapes = escapes

    def _nest(self, n: int) -> None:
        kind, row = self.kind, self.row
        opens = (kind == OPEN_OBJ) | (kind == OPEN_ARR)
        closes = (kind == CLOSE_OBJ) | (kind == CLOSE_ARR)
        total = np.cumsum(opens.astype(np.int64) - closes)
        first = np.searchsorted(row, np.arange(n))
        base = np.where(first > 0, total[np.maximum(first - 1, 0)], 0) if len(total) else np.zeros(n, np.int64)
        depth = total - base[row] if len(total) else total
        level = depth - opens
        if len(level):
            self.valid[row[depth < 0]] = False
            final = np.flatnonzero(np.concatenate([row[1:] != row[:-1], [True]]))
            self.valid[row[final][depth[final] != 0]] = False
        self.valid[np.bincount(row, minlength=n) == 0] = False
        level = np.maximum(level, 0)
        deepest = int(level.max(initial=0)) + 2
        opening = np.flatnonzero(opens)
        width = len(kind) + 1
        place = (row[opening] * deepest + level[opening]) * width + opening
        order = np.argsort(place)
        sorted_open, sorted_place = opening[order], place[order]

        def enclosing(tokens: np.ndarray, at_level: np.ndarray) -> np.ndarray:
            """The last bracket opened at a level before each token."""
            if not len(sorted_open):
                return np.full(len(tokens), -1)
            base = (row[tokens] * deepest + at_level) * width
            found = np.searchsorted(sorted_place, base + tokens, "right") - 1
            ok = (found >= 0) & (sorted_place[np.maximum(found, 0)] >= base)
            return np.where(ok, sorted_open[np.maximum(found, 0)], -1)

        tokens = np.arange(len(kind))
        self.parent = np.where(level > 0, enclosing(tokens, np.maximum(level - 1, 0)), -1)
        self.close = np.full(len(kind), -1)
        closing = np.flatnonzero(closes)
        mate = enclosing(closing, level[closing])
        wrong = (mate < 0) | (kind[np.maximum(mate, 0)] != kind[closing] - 1)
        self.valid[row[closing[wrong]]] = False
        self.close[mate[~wrong]] = closing[~wrong]
        self.level = level

    def _grammar(self) -> None:
        kind, row = self.kind, self.row
        if not len(kind):
            self.is_key = self.is_value = np.zeros(0, bool)
            return
        prev = np.concatenate([[0], kind[:-1]])
        prev[np.concatenate([[True], row[1:] != row[:-1]])] = 0
        holder = np.where(self.parent >= 0, kind[np.maximum(self.parent, 0)], 0)
        begins = np.isin(kind, (OPEN_OBJ, OPEN_ARR, STRING, SCALAR))
        in_obj, in_arr = holder == OPEN_OBJ, holder == OPEN_ARR
        after_start = np.isin(prev, (OPEN_OBJ, COMMA))
        is_key = (kind == STRING) & in_obj & after_start
        prev_key = np.concatenate([[False], is_key[:-1]]) & (prev != 0)
        ended = np.isin(prev, (STRING, SCALAR, CLOSE_OBJ, CLOSE_ARR)) & ~prev_key
        fine = np.select(
            [begins & (self.level == 0), begins & in_arr, begins & in_obj, kind == COLON, kind == COMMA, kind == CLOSE_OBJ, kind == CLOSE_ARR],
            [prev == 0, np.isin(prev, (OPEN_ARR, COMMA)), is_key | (prev == COLON), prev_key, ended & (self.level > 0), ended | (prev == OPEN_OBJ), ended | (prev == OPEN_ARR)],
            False,
        )
        fine &= ~prev_key | (kind == COLON)
        self.valid[row[~fine]] = False
        self.is_key, self.is_value = is_key, begins & ~is_key

    def _scalars(self, b: np.ndarray) -> None:
        at = np.flatnonzero(self.kind == SCALAR)
        good = pc.match_substring_regex(slices(b, self.start[at], self.end[at]), _SCALARS).to_numpy(zero_copy_only=False).astype(bool)
        self.valid[self.row[at[~good]]] = False
        self.is_null = np.zeros(len(self.kind), bool)
        four = at[(self.end[at] - self.start[at]) == 4]
        self.is_null[four[b[self.start[four]] == ord("n")]] = True

    def _children(self) -> None:
        """For each token the list of elements it stands for where an array is expected; nulls included, in order."""
        keep = self.valid[self.row] if len(self.row) else np.zeros(0, bool)
        n = len(self.kind)
        child = np.flatnonzero(self.is_value & keep & (self.parent >= 0))
        child = child[self.kind[self.parent[child]] == OPEN_ARR]
        child = child[np.argsort(self.parent[child], kind="stable")]
        alone = np.flatnonzero(self.is_value & keep & (self.kind != OPEN_ARR))
        owner = np.concatenate([self.parent[child], alone])
        item = np.concatenate([child, alone])
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=n)
        self.lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)), pa.array(item[order].astype(np.int64)))

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, token) of every valid row."""
        at = np.flatnonzero(self.is_value & (self.level == 0))
        at = at[self.valid[self.row[at]]]
        return self.row[at], at

    def member(self, objects: np.ndarray, name: str) -> np.ndarray:
        """The value token of a member of each object, the last where a name repeats; -1 where there is none."""
        keys = np.flatnonzero(self.is_key)
        plain = self._escapes[self.end[keys]] == self._escapes[self.start[keys]]
        want = name.encode()
        match = plain & (self.end[keys] - self.start[keys] == len(want) + 2)
        at = self.start[keys[match]] + 1
        same = np.ones(len(at), bool)
        for k, ch in enumerate(want):
            same &= self.data[at + k] == ch
        match[np.flatnonzero(match)[~same]] = False
        odd = np.flatnonzero(~plain & self.valid[self.row[keys]])
        if len(odd):
            match[odd] = [x == name for x in self._loads(keys[odd])]
        found = keys[match]
        value = np.full(len(self.kind) + 1, -1)
        value[self.parent[found]] = found + 2  # key, colon, value; later ones overwrite
        return value[objects]

    def _loads(self, tokens: np.ndarray) -> list[str]:
        text = slices(self.data, self.start[tokens], self.end[tokens])
        joined = b"".join([b"[", b",".join(x.encode() for x in text.to_pylist()), b"]"])
        return [re.sub("[\ud800-\udfff]", "�", x) for x in json.loads(joined)]

    def text(self, tokens: np.ndarray) -> pa.Array:
        """What each value says: a string its characters, a scalar and a container what is written; -1 and null ''."""
        kind = np.where(tokens >= 0, self.kind[tokens], 0)
        start, end = self.start[tokens].copy(), self.end[tokens].copy()
        box = (kind == OPEN_OBJ) | (kind == OPEN_ARR)
        end[box] = self.end[self.close[tokens[box]]]
        is_str = kind == STRING
        start[is_str] += 1
        end[is_str] -= 1
        nothing = (tokens < 0) | self.is_null[tokens]
        end[nothing] = start[nothing]
        out = slices(self.data, start, end)
        odd = is_str & (self._escapes[end] != self._escapes[start])
        if odd.any():
            out = pc.replace_with_mask(out, pa.array(odd), pa.array(self._loads(tokens[odd]), pa.large_string()))
        return out
