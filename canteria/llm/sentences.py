"""Sentence boundaries by a linear-chain model over characters.

A text is cut into blocks at blank lines and list items.  In a block every
character is tagged as boundary (the last one of a sentence) or inside by a
first-order model decoded with Viterbi.  Characters that can end a sentence
carry features of what stands around them; all others are inside.  Among them
are what the word before a period is known to be and its shape, and, hashed,
how the clause after a closed quotation begins and ends, so that verbs of
speech are learned and not listed.  The model is trained in a second or two on
text joined from the labelled sentences of :mod:`canteria.llm.seeds`; for
Thai they are stripped of the marks they end in.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import seeds

# Character classes.
(LETTER, UPPER, LOWER, DIGIT, SPACE, NEWLINE, DOT, MARK, HAN_DOT, HAN_MARK, DANDA, ELLIPSIS, OPEN_Q, CLOSE_Q, OPEN_B, CLOSE_B, STRAIGHT, INVERTED, BARE, PUNCT) = range(20)
# Which characters are which.
_GROUPS = {
    DOT: ".", MARK: "!?؟;‼⁉⁇⁈", HAN_DOT: "。｡．", HAN_MARK: "！？", DANDA: "।॥۔።။។៕", ELLIPSIS: "…", INVERTED: "¿¡",
    OPEN_Q: "«“„‟「『〈《‹", CLOSE_Q: "»”」』〉》›", OPEN_B: "([{（【［｛", CLOSE_B: ")]}）】］｝", STRAIGHT: '"',
}
#: Pairs that are counted together when balance is checked.
_PAIRS = ["«»", "“”", "「」", "『』", "()", "[]", "（）", "【】", "{}", "〈〉", "《》", "‹›", "［］", "｛｝"]
#: Scripts that write no sentence marks: Thai, Lao.
_BARE_RANGES = ((0x0E01, 0x0E5C), (0x0E81, 0x0EE0))
#: Vowels of the scripts whose abbreviations often have none.
_VOWELS = "aeiouyáéíóúàèìòùâêîôûäëïöüãõаеёиоуыэюяіїєαειουωηάέήίόύώ"

# Values of the features of a candidate.
NO_TERM, T_DOT, T_MARK, T_HAN, T_HAN_MARK, T_DANDA, T_ELLIPSIS, T_BARE = range(8)
NO_ABBR, A_TITLE, A_REF, A_NEVER, A_END, A_INITIAL, A_ORDINAL = range(7)
N_END, N_UPPER, N_LOWER, N_FILE, N_DIGIT, N_OPEN, N_INVERTED, N_PUNCT, N_LETTER = range(9)
G_NONE, G_SPACE, G_LINE, G_END = range(4)
K_NONE, K_QUOTE, K_QUOTE_IN, K_BRACKET, K_BRACKET_IN = range(5)

def _any_of(*kinds: int) -> np.ndarray:
    """A table to look up whether a class is one of these."""
    out = np.zeros(20, bool)
    out[list(kinds)] = True
    return out


_CLOSING = _any_of(CLOSE_Q, CLOSE_B)
_ENDING = _any_of(DOT, MARK, HAN_DOT, HAN_MARK, DANDA, ELLIPSIS)
_STRONG = _ENDING | _CLOSING
_BLANK = _any_of(SPACE, NEWLINE)
_WORD = _any_of(LETTER, UPPER, LOWER, BARE, DIGIT)
_NAME = _any_of(LOWER, DIGIT)

_BASE = 1_000_003
_MASK = np.uint64(0x7FFFFFFFFFFFFFFF)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every code point of the basic plane."""
    kind, low = np.zeros(0x10000, np.uint8), np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        cat = unicodedata.category(ch)
        kind[c] = UPPER if cat in ("Lu", "Lt") else LOWER if cat == "Ll" else DIGIT if cat in ("Nd", "No") else SPACE if ch.isspace() or cat == "Zs" else LETTER if cat[0] in "LMN" else PUNCT
        lower = ch.lower()
        if len(lower) == 1:
            low[c] = ord(lower)
    for a, b in _BARE_RANGES:
        part = kind[a:b]
        part[part == LETTER] = BARE
    kind[ord("\n")] = NEWLINE
    for value, chars in _GROUPS.items():
        for ch in chars:
            kind[ord(ch)] = value
    return kind, low


@lru_cache(maxsize=1)
def _vowel_table() -> np.ndarray:
    out = np.zeros(0x10000, bool)
    out[[ord(ch) for ch in _VOWELS]] = True
    return out


def _word_hash(word: str) -> int:
    h = 0
    for ch in reversed(word):
        h = (h * _BASE + ord(ch)) & 0x7FFFFFFFFFFFFFFF
    return h


@lru_cache(maxsize=1)
def _lexicon() -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Hashes of single abbreviations, of two-part ones, and of the leads of ordinals."""
    single: dict[int, int] = {}
    for value, words in ((A_TITLE, seeds.TITLES), (A_REF, seeds.REFERENCES), (A_NEVER, seeds.NEVER), (A_END, seeds.ENDING)):
        single |= {_word_hash(w): value for w in words}
    pair: dict[int, int] = {}
    for value, words in ((A_NEVER, seeds.PAIR_NEVER), (A_END, seeds.PAIR_ENDING)):
        for w in words:
            a, b = w.split(".")
            pair[(_word_hash(a) * 31 + _word_hash(b)) & 0x7FFFFFFFFFFFFFFF] = value

    def table(d: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(sorted(d), np.uint64)
        return keys, np.array([d[int(k)] for k in keys], np.int64)

    return table(single), table(pair), np.array(sorted(_word_hash(w) for w in seeds.ORDINAL_LEADS), np.uint64)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class Features:
    """Candidates of many blocks, laid end to end with two newlines between, and their features."""

    def __init__(self, blocks: list[str]):
        self.text = "\n\n".join(blocks) + "\n\n"
        code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(b) for b in blocks], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes + 2)])[:-1] if len(blocks) else np.zeros(0, np.int64)
        self.last = self.first + sizes - 1
        kinds, lows = _tables()
        basic = np.minimum(code, 0xFFFF)
        kind = kinds[basic].copy()
        kind[code > 0xFFFF] = LETTER
        self.code, self.kind, self.low = code, kind, np.where(code > 0xFFFF, code, lows[basic])
        self.block = np.repeat(np.arange(len(blocks), dtype=np.int32), sizes + 2)
        self._marks()
        self._pair_quotes()
        self._candidates()

    def _marks(self) -> None:
        code, kind = self.code, self.kind
        before = np.concatenate([[0], code[:-1]])
        greek = ((before >= 0x370) & (before < 0x400) & (before != 0x37E)) | ((before >= 0x1F00) & (before < 0x2000))
        kind[(code == ord(";")) & greek] = MARK
        dot = code == ord(".")
        run = (dot & np.concatenate([[False], dot[:-1]])) | (dot & np.concatenate([dot[1:], [False]]))
        kind[run] = ELLIPSIS

    def _pair_quotes(self) -> None:
        """Depth after each character, and the opener of each closer, over the kinds of marks that balance in their block."""
        code, kind, block = self.code, self.kind, self.block
        n = len(code)
        step = np.zeros(n, np.int8)
        # German style: a quote opened low is closed by the mark that elsewhere opens.
        curly = np.flatnonzero(np.isin(code, [0x201C, 0x201D, 0x201E]))
        role = np.where(code[curly] == 0x201D, -1, 1)
        low_open = np.concatenate([[False], (code[curly][:-1] == 0x201E) & (block[curly][1:] == block[curly][:-1])]) if len(curly) else np.zeros(0, bool)
        role[(code[curly] == 0x201C) & low_open] = -1
        kind[curly] = np.where(role > 0, OPEN_Q, CLOSE_Q)
        straight = np.flatnonzero(kind == STRAIGHT)
        if len(straight):
            rank = np.arange(len(straight)) - np.searchsorted(block[straight], block[straight])
            kind[straight] = np.where(rank % 2 == 0, OPEN_Q, CLOSE_Q)
        groups = [(straight, np.where(kind[straight] == OPEN_Q, 1, -1)), (curly, role)]
        for a, b in _PAIRS:
            if a != "“":
                at = np.flatnonzero((code == ord(a)) | (code == ord(b)))
                groups.append((at, np.where(code[at] == ord(a), 1, -1)))
        for at, sign in groups:
            if not len(at):
                continue
            total = np.cumsum(sign)
            start = np.searchsorted(block[at], block[at])
            depth = total - np.where(start > 0, total[np.maximum(start - 1, 0)], 0)
            final = np.concatenate([block[at][1:] != block[at][:-1], [True]])
            bad = np.unique(block[at[(depth < 0) | (final & (depth != 0))]])
            good = ~np.isin(block[at], bad)
            step[at[good]] = sign[good]
        self.depth = np.cumsum(step, dtype=np.int32)
        self.opener = np.full(n, -1, np.int64)
        at = np.flatnonzero(step)
        if len(at):
            level = self.depth[at].astype(np.int64) - (step[at] > 0)
            key = level * (n + 1) + at
            opens = np.sort(key[step[at] > 0])
            closes = at[step[at] < 0]
            want = self.depth[closes].astype(np.int64) * (n + 1) + closes
            where = np.searchsorted(opens, want) - 1
            ok = where >= 0
            found = np.where(ok, opens[np.maximum(where, 0)], -1)
            same = ok & (found // (n + 1) == self.depth[closes])
            self.opener[closes[same]] = found[same] % (n + 1)

    def _candidates(self) -> None:
        kind, code, block = self.kind, self.code, self.block
        n = len(kind)
        blank = _BLANK[kind]
        index = np.arange(n)
        after = np.minimum.accumulate(np.where(blank, n, index)[::-1])[::-1]  # next character that is no white space, from here on
        before = np.maximum.accumulate(np.where(blank, -1, index))
        next_blank = np.concatenate([blank[1:], [True]])
        strong = _STRONG[kind]
        c = np.flatnonzero(~blank & (next_blank | strong))
        begin, end = self.first[block[c]], self.last[block[c]]
        nxt = after[np.minimum(c + 1, n - 1)]
        at_end = (nxt > end) | (c >= end)
        nxt = np.minimum(nxt, n - 1)
        # Back over closing marks (and the space French puts before them) to what they close.
        j = self._closed(blank)[c]
        term = np.select(
            [kind[j] == DOT, kind[j] == MARK, kind[j] == HAN_DOT, kind[j] == HAN_MARK, kind[j] == DANDA, kind[j] == ELLIPSIS, kind[j] == BARE],
            [T_DOT, T_MARK, T_HAN, T_HAN_MARK, T_DANDA, T_ELLIPSIS, T_BARE], NO_TERM)
        # In a script without marks a token that ends in figures or another script is its too.
        bare = np.cumsum(kind == BARE)
        gap_before = np.maximum.accumulate(np.where(blank, index, 0))
        term[(term == NO_TERM) & (bare[j] > bare[gap_before[j]])] = T_BARE
        abbr, shape = self._abbreviations(j, begin, term == T_DOT)
        gap = np.where(at_end, G_END, np.where(nxt == c + 1, G_NONE, G_SPACE))
        breaks = np.cumsum(kind == NEWLINE)
        gap[(gap == G_SPACE) & (breaks[nxt] > breaks[c])] = G_LINE
        nk = kind[nxt]
        follow = np.select(
            [at_end, nk == UPPER, nk == LOWER, nk == DIGIT, np.isin(nk, (OPEN_Q, OPEN_B)), nk == INVERTED, np.isin(nk, (LETTER, BARE))],
            [N_END, N_UPPER, N_LOWER, N_DIGIT, N_OPEN, N_INVERTED, N_LETTER], N_PUNCT)
        follow[(follow == N_LOWER) & self._file_name(nxt)] = N_FILE
        opener = np.where(j < c, self.opener[c], -1)
        prior = before[np.maximum(opener - 1, 0)]
        alone = (opener >= 0) & ((opener <= begin) | _STRONG[kind[np.maximum(prior, 0)]] | ((term == T_BARE) & (kind[np.maximum(opener - 1, 0)] == SPACE)))
        bracket = kind[c] == CLOSE_B
        closed = np.where(opener < 0, K_NONE, np.where(bracket, np.where(alone, K_BRACKET, K_BRACKET_IN), np.where(alone, K_QUOTE, K_QUOTE_IN)))
        inside = (self.depth[c] > 0).astype(np.int64)
        self.at = c
        self.adjacent = np.concatenate([[False], (c[1:] == c[:-1] + 1) & (block[c[1:]] == block[c[:-1]])])
        full = (((term * 8 + abbr) * 10 + follow) * 4 + gap) * 12 + closed * 2 + inside
        wide = (term * 10 + follow) * 12 + closed * 2 + inside
        parts = [full, wide, (term * 8 + abbr) * 10 + follow, (term * 4 + gap) * 2 + inside, term * 8 + abbr, closed * 10 + follow, np.where(term == T_DOT, shape * 10 + follow + 1, 0)]
        self.ids = np.stack([offset + part for offset, part in zip(_OFFSETS, [*parts, *self._clause(nxt, end, closed, at_end)])])

    def _clause(self, nxt: np.ndarray, end: np.ndarray, closed: np.ndarray, at_end: np.ndarray) -> list[np.ndarray]:
        """What follows a closed quotation or bracket, hashed: how its clause begins, and how it ends."""
        n, term = len(self.kind), _ENDING[self.kind]
        stop = np.minimum.accumulate(np.where(term, np.arange(n), n)[::-1])[::-1]
        out = [np.zeros(len(nxt), np.int64) for _ in range(_CLAUSE_FEATURES)]
        k = np.flatnonzero((closed > K_NONE) & ~at_end)
        if len(k):
            a, z, low = nxt[k], np.minimum(stop[nxt[k]], end[k] + 1), self.low.astype(np.uint64)

            def mixed(*places: np.ndarray) -> np.ndarray:
                h = closed[k].astype(np.uint64) + np.uint64(64 * len(places))
                for p in places:
                    inside = (p >= a) & (p < z)
                    h = h * np.uint64(_BASE) + np.where(inside, low[np.clip(p, 0, n - 1)], 0)
                h ^= h >> np.uint64(17)
                return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _CLAUSE_BITS)).astype(np.int64) + 1

            for column, places in zip(out, ((a,), (a, a + 1, a + 2), (z - 1,), (z - 1, z - 2), (z - 1, z - 2, z - 3))):
                column[k] = mixed(*places)
        return out

    def _back(self, pos: np.ndarray, begin: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The word that ends just before ``pos``: its hash (0 if there is none, or it is longer than any abbreviation), its length up to there, and whether it is a number."""
        longest = seeds.LONGEST_WORD
        h, size = np.zeros(len(pos), np.uint64), np.zeros(len(pos), np.int64)
        live, digits = on.copy(), on.copy()
        for k in range(1, longest + 2):
            p = pos - k
            ok = live & (p >= begin)
            p = np.maximum(p, 0)
            ok &= _WORD[self.kind[p]]
            digits &= ~ok | (self.kind[p] == DIGIT)
            h = np.where(ok, (h * np.uint64(_BASE) + self.low[p].astype(np.uint64)) & _MASK, h)
            size += ok
            live = ok
        h[(size == 0) | (size > longest)] = 0
        return h, size, digits & (size > 0)

    def _abbreviations(self, j: np.ndarray, begin: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the word before a period is known to be, and its shape: length, whether it lacks a vowel, whether it begins with a capital."""
        out, shape = np.zeros(len(j), np.int64), np.zeros(len(j), np.int64)
        k = np.flatnonzero(on)
        if not len(k):
            return out, shape
        pos, begin = j[k], begin[k]
        (single, single_v), (pair, pair_v), leads = _lexicon()
        h, size, number = self._back(pos, begin, np.ones(len(k), bool))
        found = _find(single, single_v, h)
        # A lone letter is an initial, unless it is a unit after a number.
        u = np.maximum(pos - 2, 0)
        u = np.where(_BLANK[self.kind[u]], np.maximum(u - 1, 0), u)
        unit = (self.kind[np.maximum(pos - 1, 0)] == LOWER) & (self.kind[u] == DIGIT) & (u >= begin)
        initial = (size == 1) & ~number & (found == 0) & ~unit
        # The word before, if it too ends in a period; a space may stand between.
        q = pos - size - 1
        qk = self.kind[np.maximum(q, 0)]
        q = np.where((q >= begin) & _BLANK[qk], q - 1, q)
        dotted = (q >= begin) & (self.code[np.maximum(q, 0)] == ord(".")) & (size > 0)
        h2, size2, _ = self._back(np.maximum(q, 0), begin, dotted)
        both = _find(pair, pair_v, (h2 * np.uint64(31) + h) & _MASK)
        result = np.where(dotted & (both > 0), both, np.where(found > 0, found, np.where(initial, A_INITIAL, NO_ABBR)))
        # An ordinal: a number after an article or preposition.
        h3, _, _ = self._back(np.maximum(np.where(_BLANK[self.kind[np.maximum(pos - size - 1, 0)]], pos - size - 1, 0), 0), begin, number & (size <= 2))
        result[number & (size <= 2) & np.isin(h3, leads)] = A_ORDINAL
        street = (size > 3) & np.all([self.low[np.maximum(pos - 3 + i, 0)] == ord(ch) for i, ch in enumerate("str")], axis=0)
        result[street & (result == NO_ABBR)] = A_NEVER
        out[k] = result
        vowels = np.cumsum(_vowel_table()[np.minimum(self.low, 0xFFFF)])
        head = np.maximum(pos - size, 0)
        lacks = (size > 1) & ~number & (vowels[np.maximum(pos - 1, 0)] == vowels[np.maximum(head - 1, 0)])
        shape[k] = (np.minimum(size, 5) * 2 + lacks) * 2 + (self.kind[head] == UPPER)
        return out, shape

    def _closed(self, blank: np.ndarray) -> np.ndarray:
        """For every character the place of what it closes, by way of any number of closing marks; itself if it is none."""
        to = np.arange(len(self.kind))
        marks = np.flatnonzero(_CLOSING[self.kind])
        begin = self.first[self.block[marks]]
        marks, begin = marks[marks > begin], begin[marks > begin]
        before = marks - 1
        to[marks] = before - (blank[before] & (before > begin))
        while len(marks):  # pointer doubling
            on = to[to[marks]]
            if (on == to[marks]).all():
                break
            to[marks] = on
        return to

    def _file_name(self, at: np.ndarray) -> np.ndarray:
        """Does a name with an extension begin here, such as a sentence may begin with in lower case?"""
        n = len(self.code)
        word = _NAME[self.kind] | (self.code == ord("_")) | (self.code == ord("-"))
        stop = np.minimum.accumulate(np.where(word, n - 1, np.arange(n))[::-1])[::-1][at]
        return (stop > at) & (self.code[stop] == ord(".")) & _NAME[self.kind[np.minimum(stop + 1, n - 1)]]


_CLAUSE_BITS, _CLAUSE_FEATURES = 12, 5
_SIZES = (8 * 8 * 10 * 4 * 12, 8 * 10 * 12, 8 * 8 * 10, 8 * 4 * 2, 8 * 8, 6 * 10, 24 * 10 + 1, *[(1 << _CLAUSE_BITS) + 1] * _CLAUSE_FEATURES)
_OFFSETS = tuple(int(x) for x in np.concatenate([[0], np.cumsum(_SIZES)]))


class BoundaryModel:
    """Weights of the features, and of the steps between two tags."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def decode(self, f: Features, cost: np.ndarray | float = 0.0) -> np.ndarray:
        """For each candidate, is it tagged as a boundary?  Viterbi over all chains of candidates that touch, side by side.

        ``cost`` is added to the scores of the candidates.
        Between two candidates that do not touch lie inside characters only;
        the steps into and out of them say no more than the weights of the
        candidates do, so they are 0, and only steps between characters that
        touch are learned.
        """
        score = np.zeros(len(f.at)) + cost
        for part in f.ids:
            score += self.weights[part]
        out = score > 0  # a chain of one
        begin = np.flatnonzero(~f.adjacent)
        count = np.diff(np.concatenate([begin, [len(score)]]))
        begin, count = begin[count > 1], count[count > 1]
        order = np.argsort(count, kind="stable")
        for lane in np.array_split(order, max(1, len(order) // 2048)):
            if not len(lane):
                continue
            longest = int(count[lane].max())
            best, tag = np.zeros((len(lane), 2)), np.zeros(len(lane), bool)
            came = np.zeros((longest, len(lane), 2), bool)
            for t in range(longest):
                live = t < count[lane]
                path = best[:, :, None] + (self.steps if t else np.zeros((2, 2)))
                came[t] = path[:, 1, :] > path[:, 0, :]
                now = path.max(axis=1)
                now[:, 1] += score[np.minimum(begin[lane] + t, len(score) - 1)]
                best = np.where(live[:, None], now, best)
            tag = best[:, 1] > best[:, 0]
            rows = np.arange(len(lane))
            for t in range(longest - 1, -1, -1):
                live = t < count[lane]
                out[begin[lane][live] + t] = tag[live]
                tag = np.where(live, came[t, rows, tag.astype(int)], tag)
        return out


#: How much faster the many features of clauses learn than the others.
CLAUSE_RATE = 2.0
#: Share of the boundaries shown without what follows them.
MASKED = 0.5
#: By how much a right tag must be better than a wrong one.
MARGIN = 100.0
#: Parts the labelled sentences are dealt into, where one is to be held out.
FOLDS = 4


def training_blocks(documents: int = 8000, seed: int = 11, fold: int | None = None, held: bool = False, langs: tuple[str, ...] = ()) -> tuple[list[str], list[list[int]]]:
    """Blocks joined from the labelled sentences, and where their sentences end.

    ``documents`` bounds the training sample.  Scripts without sentence marks
    are stripped of all punctuation at the ends of sentences and joined by a
    space.  With ``fold`` the sentences of that part are left out, or, with
    ``held``, are all there is.  ``langs``: only these.
    """
    rng = random.Random(seed)
    known = {lang: [s for k, s in enumerate(every) if fold is None or (k % FOLDS == fold) == held] for lang, every in seeds.SENTENCES.items()}
    langs = langs or tuple(sorted(known))
    blocks, ends = [], []
    for d in range(documents):
        lang = langs[d % len(langs)]
        text, marks, prior = "", [], ""
        for _ in range(rng.randint(2, 7)):
            use = lang if rng.random() < 0.88 else rng.choice(langs)
            s = rng.choice(known[use])
            if use in seeds.UNMARKED:
                s = s.rstrip(seeds.END_MARKS)
            if text:
                glued = use == prior and use in ("zh", "ja")
                missing = rng.random() < 0.04 and text[-1] == "." and len(text) > 3 and text[-4:-1].isalpha() and text[-4:-1].islower() and s[0].isupper()
                text += "" if glued or missing else rng.choice([" ", " ", " ", " ", "  ", "\xa0"])
            if use not in ("zh", "ja", *seeds.UNMARKED) and rng.random() < 0.3:
                spots = [m.start() for m in re.finditer(" ", s)]
                if spots:
                    p = rng.choice(spots)
                    s = s[:p] + "\n" + s[p + 1 :]
            text, prior = text + s, use
            marks.append(len(text) - 1)
        blocks.append(text)
        ends.append(marks)
    return blocks, ends


def held_out_counts(langs: tuple[str, ...], documents: int = 300, seed: int = 77, train_documents: int = 3000) -> tuple[int, int, int]:
    """(true, given, both) boundaries of blocks made of sentences that training did not see, over all parts in turn."""
    total = np.zeros(3, np.int64)
    for fold in range(FOLDS):
        blocks, ends = training_blocks(documents, seed, fold, True, langs)
        f = Features(blocks)
        want = np.isin(f.at, np.concatenate([f.first[k] + np.array(m) for k, m in enumerate(ends)]))
        got = train(train_documents, fold=fold).decode(f)
        total += [sum(map(len, ends)), got.sum(), (got & want).sum()]
    return tuple(total.tolist())


@lru_cache(maxsize=8)
def train(documents: int = 8000, epochs: int = 6, seed: int = 11, fold: int | None = None) -> BoundaryModel:
    """Averaged structured perceptron: decode with Viterbi, wrong tags favoured by MARGIN, and move the weights towards the labels."""
    blocks, ends = training_blocks(documents, seed, fold)
    parts = [(Features(blocks[a : a + 50]), ends[a : a + 50]) for a in range(0, len(blocks), 50)]
    weights, steps = np.zeros(_OFFSETS[-1]), np.zeros((2, 2))
    weights_sum, steps_sum, n = np.zeros_like(weights), np.zeros((2, 2)), 0

    def pairs(f: Features, tags: np.ndarray) -> np.ndarray:
        block = f.block[f.at]
        follows = np.concatenate([[False], block[1:] == block[:-1]])
        now, was = tags.astype(int), np.concatenate([[0], tags[:-1].astype(int)])
        out = np.zeros((2, 2))
        touch = follows & f.adjacent
        np.add.at(out, (was[touch], now[touch]), 1)
        return out

    gold_of = []
    for f, marks in parts:
        wanted = np.concatenate([f.first[b] + np.array(m, np.int64) for b, m in enumerate(marks)])
        gold_of.append(np.isin(f.at, wanted))
    rng, known = np.random.default_rng(seed), [f.ids for f, _ in parts]
    rates = np.array([1.0] * (len(_SIZES) - _CLAUSE_FEATURES) + [CLAUSE_RATE] * _CLAUSE_FEATURES)
    unknown = np.array(_OFFSETS[-1 - _CLAUSE_FEATURES : -1])
    for _ in range(epochs):
        for (f, _m), gold, ids in zip(parts, gold_of, known):
            # Some of the boundaries are shown without what follows, so that a clause never seen before is taken for a new sentence.
            f.ids = ids.copy()
            f.ids[-_CLAUSE_FEATURES:, gold & (rng.random(len(gold)) < MASKED)] = unknown[:, None]
            guess = BoundaryModel(weights, steps).decode(f, np.where(gold, -MARGIN, MARGIN))
            wrong = guess != gold
            if wrong.any():
                sign = np.where(gold[wrong], 1.0, -1.0)
                np.add.at(weights, f.ids[:, wrong].ravel(), (rates[:, None] * sign).ravel())
                weights[unknown] = 0.0  # as a clause never seen weighs nothing
                steps += pairs(f, gold) - pairs(f, guess)
            weights_sum += weights
            steps_sum += steps
            n += 1
    return BoundaryModel(weights_sum / n, steps_sum / n)


_BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_ITEM = re.compile(r"^[^\S\n]*(?:([-*•‣◦])|(\d+)[.)])[^\S\n]+(?=\S)", re.M)


def split_blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is_item) of every block, without outer white space.

    A numbered line begins an item where its block begins with one or it goes
    on counting from the item before; else it is a wrapped line.
    """
    text = text.replace("\r\n", " \n").replace("\r", "\n").replace(" ", "\n").replace(" ", "\n")
    bounds = [0]
    for m in _BLANK_LINE.finditer(text):
        bounds += [m.start(), m.end()]
    bounds.append(len(text))
    for a, b in zip(bounds[::2], bounds[1::2]):
        cuts, last, first_line = [], None, True
        for m in _ITEM.finditer(text, a, b):
            at_start = not text[a : m.start()].strip()
            if m[1]:
                good = True
            else:
                number = int(m[2]) if len(m[2]) < 4000 else -1  # Python reads no longer ones; nothing counts up to them
                good = at_start or (last is not None and number == last + 1) or (last is None and not cuts and number == 1)
                last = number if good else last
            if good:
                cuts.append(m.start())
        edges = [a, *cuts, b]
        for k, (s, e) in enumerate(zip(edges, edges[1:])):
            piece = text[s:e]
            left = len(piece) - len(piece.lstrip())
            size = len(piece.strip())
            if size:
                yield s + left, s + left + size, k > 0


#: Characters decoded at a time; a longer block is decoded alone.
CHARS_AT_ONCE = 1_000_000


def _decode(prose: list[tuple[int, int, str]], model: BoundaryModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the sentences of blocks (row, start, text)."""
    f = Features([p[2] for p in prose])
    row, base = np.array([p[0] for p in prose]), np.array([p[1] for p in prose])
    cut = f.at[model.decode(f)]
    cut = cut[f.depth[cut] <= 0]  # an open quotation or bracket is never left
    cut = np.unique(np.concatenate([cut, f.last]))  # a block always ends a sentence
    block = f.block[cut]
    fresh = np.concatenate([[True], block[1:] != block[:-1]])
    blank = _BLANK[f.kind]
    after = np.minimum.accumulate(np.where(blank, len(blank), np.arange(len(blank)))[::-1])[::-1]
    begin = np.where(fresh, f.first[block], after[np.minimum(np.concatenate([[0], cut[:-1]]) + 1, len(blank) - 1)])
    shift = base[block] - f.first[block]
    return row[block], begin + shift, cut + 1 + shift


def split_batch(texts: list[str | None], model: BoundaryModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every sentence of a list of texts."""
    rows, starts, ends, prose = [], [], [], []
    for r, text in enumerate(texts):
        for a, b, item in split_blocks(text or ""):
            if item:
                rows.append(r)
                starts.append(a)
                ends.append(b)
            else:
                prose.append((r, a, text[a:b]))
    found = [(np.array(rows, np.int64), np.array(starts, np.int64), np.array(ends, np.int64))]
    at = 0
    while at < len(prose):
        size, to = 0, at
        while to < len(prose) and (to == at or size + len(prose[to][2]) <= CHARS_AT_ONCE):
            size += len(prose[to][2])
            to += 1
        found.append(_decode(prose[at:to], model))
        at = to
    row, start, end = (np.concatenate(x) for x in zip(*found))
    return row, start, end


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", train_documents: int = 8000) -> DataFrame:
    """(doc_id, inicio, fin): one row per sentence, code points, no outer white space.

    Null and blank texts give none.  Rows are independent, so a text of any
    length and any repeated row gives what it gives alone.
    """

    model = train(train_documents)  # once, on the driver; a few hundred kilobytes go to the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            a = 0
            while a < len(texts):
                size, to = 0, a
                while to < len(texts) and (to == a or size + len(texts[to] or "") <= CHARS_AT_ONCE):
                    size += len(texts[to] or "")
                    to += 1
                row, start, end = split_batch(texts[a:to], model)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row + a)), pa.array(start), pa.array(end)], names=["doc_id", "inicio", "fin"])
                a = to

    return docs.select(key, text).mapInArrow(run, "doc_id long, inicio long, fin long")
