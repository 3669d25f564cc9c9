"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The base are spans of four kinds that patterns and checks define. The field
adds spans that the patterns miss: written-out e-mail addresses, numbers grouped
in other ways. It scores whole segments of tokens, so a feature may ask whether
a span's digits pass the card check or whether its parts make an address; with
scores for the turn from one segment's kind to the next, its dynamic programme,
in which an entity has a bounded number of tokens, chooses the boundaries and
kinds together. It is trained by the gradient of the exact log-likelihood on
sentences made from a rule, with fixed random numbers.

Every text is decoded as a whole. A segment that can't gain by its score and its
two turns, however favourable, is never in the best segmentation, so segments are
scored for all texts of a batch at once and only the others reach the dynamic
programme. The weights themselves say whether a segment without a digit and
without an "at" could gain; if one could, all segments are scored.

Base spans always stay; an added span that overlaps one goes. Of segmentations
that score the same, the one with fewer entities is taken.

A null or empty text has no spans. A text of any length is decoded, in parts of
bounded size. Repeated rows are judged each, and an empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import column, slices

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base. A lookbehind spares starts inside a run of digits, where none can succeed.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Tokens of an entity at most, and tokens scored at once.
ENTITY_TOKENS, SLICE = 24, 1 << 15
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def small(part: str) -> bool:
    """Whether digits are a number up to 255, however many zeros lead it."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            done = m.end()
            out.append((0, start, done))
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    for m in IP.finditer(text):
        if all(map(small, m[0].split("."))):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


# --- tokens and the features of segments ---

SPACE, LETTERS, DIGITS, MARK, FOREIGN, EDGE = range(6)
#: Classes of characters. Letters, digits, white space and characters beyond ASCII make tokens in runs, any other character is one; an EDGE ends a text.
_CLASS = np.full(128, MARK, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = SPACE
_CLASS[48:58] = DIGITS
_CLASS[65:91] = _CLASS[97:123] = LETTERS
_CLASS[0] = EDGE
#: White space beyond ASCII.
_WIDE_SPACES = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
#: Top domains that a written-out address may end with.
TOPS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "nl", "uk", "eu", "ch", "at")


def _word(codes: np.ndarray, start: np.ndarray, length: np.ndarray, word: str) -> np.ndarray:
    """Which tokens are that word, in any case."""
    out = length == len(word)
    own = start[out]
    same = np.ones(len(own), bool)
    for k, c in enumerate(word):
        same &= (codes[own + k] | 32) == ord(c)
    out[out] = same
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int32)
    np.cumsum(x, out=out[1:])
    return out


def codes_of(texts: list[str]) -> np.ndarray:
    """The code points of the texts, with an EDGE after each."""
    return np.frombuffer("".join(f"{t}\0" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")


def token_starts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens start, and the class of each."""
    kind = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], np.uint8(FOREIGN))
    wide = np.flatnonzero(codes > 127)
    kind[wide[np.isin(codes[wide], _WIDE_SPACES)]] = SPACE
    first = np.ones(len(codes), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == MARK) | (kind[1:] == EDGE)
    starts = np.flatnonzero(first)
    return starts, kind[starts]


#: Values of each feature of a segment; a segment has one value of each.
GROUPS = {"spaces": 5, "at": 7, "address": 8, "sides": 5, "digits": 9, "groups": 8, "first": 6, "last": 4, "before": 7, "after": 7, "odd": 3, "sizes": 5, "marks": 9}
#: The values that a segment can have that holds neither a digit nor an "at"; of other features, all.
PLAIN = {"at": (0, 2), "address": (7,), "sides": (4,), "digits": (0, 8), "groups": (0, 7), "sizes": (0,), "marks": (0,), "first": (0, 1, 3, 5), "last": (0, 2, 3)}
#: Features that are looked at first; a segment that can't gain whatever the others say goes no further.
EARLY, LATE = ("spaces", "odd", "before", "after", "at", "first", "last"), ("address", "sides", "digits", "groups", "sizes", "marks")


class Lattice:
    """The tokens from one to another of a row of codes, and the features of segments of them."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> None:
        """starts has one more entry than kinds: the end of the last token."""
        self.codes, self.start, self.kind = codes, starts[:-1], kinds
        length = np.diff(starts)
        n = len(kinds)
        c = codes[self.start]
        self.c, self.length = c, length
        digits, letters, space = kinds == DIGITS, kinds == LETTERS, kinds == SPACE
        self.at_word = letters & _word(codes, self.start, length, "at")
        self.dot_word = letters & _word(codes, self.start, length, "dot")
        self.at = (c == ord("@")) | self.at_word
        period = c == ord(".")
        self.dot = period | self.dot_word
        opens, closes = np.isin(c, (ord("("), ord("["), ord("{"))), np.isin(c, (ord(")"), ord("]"), ord("}")))
        mark = self.at | self.dot | opens | closes | (c == ord("-"))
        near = np.zeros(n, bool)
        near[1:] |= mark[:-1]
        near[:-1] |= mark[1:]
        broken = space & (length > 1)
        one = np.flatnonzero(space & (length == 1))
        broken[one] = codes[self.start[one]] != 32
        allowed = np.isin(c, tuple(map(ord, "@.-_+()[]{}%"))) | digits | letters | space
        self.sum = {name: _sums(x) for name, x in {
            "bare": space & ~near, "broken": broken, "at": self.at, "dot": self.dot, "letters": letters, "digits": np.where(digits, length, 0),
            "groups": digits, "edge": kinds == EDGE, "odd": ~allowed & (c != ord("/")), "slash": c == ord("/"), "period": period, "hyphen": c == ord("-"), "space": space,
            "close": closes, "three": digits & (length <= 3), "four": digits & (length == 4), "long": digits & (length > 4)}.items()}
        self.solid = ~space & (kinds != EDGE)
        # the next "at" from each token on, and what stands at its sides
        self.next_at = np.minimum.accumulate(np.where(self.at, np.arange(n), n)[::-1])[::-1]
        left, right = self._over(np.arange(n), -1, opens | space), self._over(np.arange(n), 1, closes | space)
        word = digits | letters
        side = lambda k: (k >= 0) & (k < n) & word[np.clip(k, 0, max(0, n - 1))]
        self.sides = side(left) * 2 + side(right)
        self.bracketed = self.at_word & (self._has(left + 1, np.arange(n), opens)) & (self._has(np.arange(n) + 1, right, closes))
        # what a last word of an address follows, through a bracket and spaces
        before = self._over(np.arange(n), -1, closes | space)
        after_dot = (before >= 0) & self.dot[np.clip(before, 0, max(0, n - 1))] & letters & (length >= 2)
        top = np.zeros(n, bool)
        own = np.flatnonzero(after_dot)
        for t in TOPS:
            top[own] |= _word(codes, self.start[own], length[own], t)
        direct = np.zeros(n, bool)
        direct[1:] = period[:-1]
        apart = period[np.clip(before, 0, max(0, n - 1))] & ~direct if n else direct
        self.tail = np.where(after_dot, np.where(direct, 0, np.where(apart, 4, 2)) + top, 6)
        # card check: the digits in a row, with weights from either end of a pair
        flat = np.flatnonzero(np.repeat(digits, length)) if n else np.zeros(0, np.int64)
        d = codes[(starts[0] if n else 0) + flat].astype(np.int32) - 48
        twice = 2 * d - 9 * (d > 4)
        odd = np.arange(len(d)) % 2 == 1
        self.luhn = _sums(np.where(odd, d, twice)), _sums(np.where(odd, twice, d))
        # numbers up to 255 in a row, with one to three marks between
        value = np.full(n, 999, np.int64)
        own = np.flatnonzero(digits & (length <= 3))
        value[own] = 0
        for k in range(3):
            has = own[length[own] > k]
            value[has] = value[has] * 10 + codes[self.start[has] + k] - 48
        group = np.flatnonzero(digits)
        gap = self.start[group[1:]] - starts[group[:-1] + 1] if len(group) else group
        plain = self.sum["letters"][group[1:]] == self.sum["letters"][group[:-1]] if len(group) else gap
        self.small, self.wide = _sums(value[group] <= 255), _sums(~((gap <= 3) & plain))

    @staticmethod
    def _over(at: np.ndarray, step: int, skipped: np.ndarray) -> np.ndarray:
        """The nearest token in that direction that isn't skipped, through three at most."""
        n, k = len(skipped), at + step
        for _ in range(3):
            inside = (k >= 0) & (k < n)
            k = k + step * (inside & skipped[np.clip(k, 0, max(0, n - 1))])
        return k

    @staticmethod
    def _has(low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        s, n = _sums(x), len(x)
        return s[np.clip(high, 0, n)] - s[np.clip(low, 0, n)] > 0

    def segments(self, first: int, last: int, anchored: bool) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) of the segments of tokens i to j - 1, with i from first to last: solid ends, within a text, and with a digit or an "at" if anchored."""
        n = len(self.kind)
        anchors = self.sum["groups"] + self.sum["at"]
        i = first + np.flatnonzero(self.solid[first:last])
        if anchored:
            i = i[anchors[np.minimum(i + ENTITY_TOKENS, n)] > anchors[i]]
        edge, out = self.sum["edge"], []
        for d in range(1, ENTITY_TOKENS + 1):
            i = i[i + d <= n]
            i = i[edge[i + d] == edge[i]]
            own = i[self.solid[i + d - 1]]
            if anchored:
                own = own[anchors[own + d] > anchors[own]]
            out.append((own, own + d))
        a, b = (np.concatenate(x) for x in zip(*out))
        return a, b

    def feature(self, name: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The value of a feature for each segment."""
        of = lambda x: self.sum[x][j] - self.sum[x][i]
        e, c = j - 1, self.c
        if name == "spaces":
            return np.where(of("broken") > 0, 4, np.minimum(of("bare"), 3))
        if name == "odd":
            return np.where(of("odd") > 0, 1, np.where(of("slash") > 0, 2, 0))
        if name in ("before", "after"):
            k = i - 1 if name == "before" else j
            inside = (k >= 0) & (k < len(c))
            k = np.clip(k, 0, max(0, len(c) - 1))
            kind, own = self.kind[k], c[k]
            out = np.select([~inside | (kind == SPACE) | (kind == EDGE), (kind == DIGITS) | (kind == LETTERS) | (kind == FOREIGN)], [0, 1], 6)
            here = lambda chars: np.isin(own, tuple(map(ord, chars))) & (out == 6)
            if name == "before":
                return np.select([here("@.-_"), here("\"'$#=&/"), here("(["), here("+")], [2, 3, 4, 5], out)
            follow = np.clip(k + 1, 0, max(0, len(c) - 1))
            joined = (own == ord(".")) & np.isin(self.kind[follow], (DIGITS, LETTERS)) & (k + 1 < len(c))
            return np.select([here("@-_%"), joined, here(".,;:!?"), here(")]")], [2, 3, 4, 5], out)
        if name == "at":
            n, own = of("at"), self.next_at[i]
            own = np.clip(own, 0, max(0, len(c) - 1))
            none = np.where(of("letters") == 0, 0, np.where(of("digits") > 0, 1, 2))
            return np.select([n == 0, n > 1, c[own] == ord("@"), self.bracketed[own]], [none, 6, 3, 4], 5)
        if name in ("address", "sides"):
            n, own = of("at"), np.clip(self.next_at[i], 0, max(0, len(c) - 1))
            if name == "sides":
                inner = np.where(own == i, self.sides[own] & 1, self.sides[own])
                return np.where(n == 1, np.where(own == e, inner & 2, inner), 4)
            dots = self.sum["dot"][j] - self.sum["dot"][np.minimum(own + 1, j)]
            return np.where(n == 1, np.where(dots > 0, self.tail[e], 6), 7)
        if name == "first":
            own = c[i]
            zeros = (self.kind[i] == DIGITS) & (self.length[i] >= 2) & (own == 48) & (self.codes[np.minimum(self.start[i] + 1, len(self.codes) - 1)] == 48)
            return np.select([own == ord("+"), zeros, (own == ord("(")) & (of("close") > 0), self.kind[i] == DIGITS, self.kind[i] == LETTERS], [1, 2, 3, 4, 5], 0)
        if name == "last":
            return np.select([self.kind[e] == DIGITS, self.kind[e] == LETTERS, c[e] == ord(")")], [1, 2, 3], 0)
        lettered = of("letters") > 0
        if name == "digits":
            n = of("digits")
            a, b = self.sum["digits"][i], self.sum["digits"][j]
            odd = b % 2 == 1
            # the last digit counts once: of the two sums the one that has it so
            total = np.where(odd, self.luhn[1][b] - self.luhn[1][a], self.luhn[0][b] - self.luhn[0][a])
            return np.select([lettered, n == 0, n <= 6, n <= 8, n <= 10, n <= 12, (n <= 19) & (total % 10 == 0), n <= 19], [8, 0, 1, 2, 3, 4, 5, 6], 7)
        if name == "groups":
            n = of("groups")
            a, b = self.sum["groups"][i], self.sum["groups"][j]
            close = self.wide[np.maximum(b - 1, 0)] - self.wide[np.minimum(a, np.maximum(b - 1, 0))] == 0
            quad = (n == 4) & (self.small[b] - self.small[a] == 4) & close & (self.kind[i] == DIGITS) & (self.kind[e] == DIGITS)
            return np.select([lettered, n == 0, quad, n == 4, n <= 3], [7, 0, 1, 2, 2 + n], 6)
        n = of("groups")
        if name == "sizes":
            four, three, long = of("four"), of("three"), of("long")
            last = (self.kind[e] == DIGITS) & (self.length[e] == 4)
            return np.select([(n == 0) | lettered, (n >= 3) & (four == n), last & (three == n - 1) & (n >= 2), long == 0], [0, 1, 2, 3], 4)
        bits = (of("period") > 0) + 2 * (of("hyphen") > 0) + 4 * (of("space") > 0)
        return np.where((n == 0) | lettered, 0, 1 + bits)


class Field:
    """Weights of the features' values for each kind, and of the turns between kinds; outside, kind 0 here, scores 0 and so does its turn to itself."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, turns: np.ndarray | None = None) -> None:
        k = len(KINDS)
        self.weights = weights or {g: np.zeros((n, k)) for g, n in GROUPS.items()}
        self.turns = np.zeros((k + 1, k + 1)) if turns is None else turns

    def packed(self) -> bytes:
        return np.concatenate([*(self.weights[g].ravel() for g in GROUPS), self.turns.ravel()]).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Field:
        flat, at, k, weights = np.frombuffer(data), 0, len(KINDS), {}
        for g, n in GROUPS.items():
            weights[g], at = flat[at:at + n * k].reshape(n, k), at + n * k
        return cls(weights, flat[at:].reshape(k + 1, k + 1))

    def gains(self) -> np.ndarray:
        """By kind, the most that a segment's two turns add to those of leaving it outside."""
        t = self.turns
        return (t[:, 1:] - t[:, :1]).max(0) + (t[1:] - t[:1]).max(1)

    def anchored(self) -> bool:
        """Whether no segment without a digit and an "at" can gain."""
        best = sum(self.weights[g][list(PLAIN.get(g, range(n)))].max(0) for g, n in GROUPS.items())
        return bool((best + self.gains() <= 0).all())

    def scores(self, lattice: Lattice, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros((len(i), len(KINDS)))
        for g in GROUPS:
            out += self.weights[g][lattice.feature(g, i, j)]
        return out

    def candidates(self, codes: np.ndarray, pruned: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, score by kind) of the segments that may be in the best segmentation, by characters; pruned: with the bounds."""
        starts, kinds = token_starts(codes)
        starts = np.append(starts, len(codes))
        gains, anchored, out = self.gains(), pruned and self.anchored(), []
        rest = sum(self.weights[g].max(0) for g in LATE)
        for low in range(0, len(kinds), SLICE):
            # a few more tokens on either side, so that segments and what stands beside them are whole
            a, b = max(0, low - 8), min(len(kinds), low + SLICE + ENTITY_TOKENS + 8)
            lattice = Lattice(codes, starts[a:b + 1], kinds[a:b])
            i, j = lattice.segments(low - a, min(low + SLICE, len(kinds)) - a, anchored)
            s = np.zeros((len(i), len(KINDS)))
            for groups, more in ((EARLY, rest), (LATE, 0.0)):
                for g in groups:
                    s += self.weights[g][lattice.feature(g, i, j)]
                if pruned:
                    live = (s + (more + gains) > 0).any(1)
                    i, j, s = i[live], j[live], s[live]
            out.append((starts[a + i], starts[a + j], s))
        return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(KINDS))))

    def decode(self, text: str, pruned: bool = True) -> list[Span]:
        return self.decoded(codes_of([text]), pruned)

    def decoded(self, codes: np.ndarray, pruned: bool = True) -> list[Span]:
        """The best segmentation's entities; an EDGE is always outside, so texts in a row don't touch."""
        starts, ends, scores = self.candidates(codes, pruned)
        order = np.lexsort((starts, ends))
        ending: dict[int, list] = {}
        for k in order.tolist():
            ending.setdefault(int(ends[k]), []).append((int(starts[k]), scores[k].tolist()))
        turns, many = self.turns.tolist(), len(KINDS) + 1
        none = float("-inf")
        # at a place: the best score by the kind of the segment that ends there, and where it came from
        state: dict[int, tuple[list[float], list]] = {}
        outside, origin = 0.0, None
        for p in sorted({*starts.tolist(), *ending}):
            values, back = [outside] + [none] * (many - 1), [origin] + [None] * (many - 1)
            for start, own in ending.get(p, ()):
                before = state[start][0]
                for k in range(1, many):
                    at = max(range(many), key=lambda x: before[x] + turns[x][k])
                    found = before[at] + turns[at][k] + own[k - 1]
                    if found > values[k]:
                        values[k], back[k] = found, (start, at)
            state[p] = values, back
            for k in range(1, many):  # from here on outside
                if values[k] + turns[k][0] > outside:
                    outside, origin = values[k] + turns[k][0], (p, k)
        out, at = [], origin
        while at:
            p, k = at
            start, before = state[p][1][k]
            out.append((k - 1, start, p))
            at = (start, before) if before else state[start][1][0]
        return out[::-1]

    @classmethod
    def fit(cls, sentences: list[tuple[str, list[Span]]], rounds: int = 40, rate: float = 0.7, decay: float = 2e-3) -> Field:
        """Adaptive gradient ascent on the log-likelihood of the sentences' spans."""
        field, many, reach = cls(), len(KINDS), ENTITY_TOKENS
        owner, place, width, values, gold, longest = [], [], [], [], [], 0
        turned = np.zeros_like(field.turns)
        for s, (text, spans) in enumerate(sentences):
            codes = codes_of([text])
            starts, kinds = token_starts(codes)
            lattice = Lattice(codes, np.append(starts, len(codes)), kinds)
            i, j = lattice.segments(0, len(kinds), False)
            index = {int(x): t for t, x in enumerate(starts)}
            named = {(index[a], index[b]): k for k, a, b in spans}
            owner.append(np.full(len(i), s))
            place.append(j)
            width.append(j - i)
            values.append(np.stack([lattice.feature(g, i, j) for g in GROUPS], 1))
            gold.append(np.array([named.get(x, -1) for x in zip(i.tolist(), j.tolist())]))
            longest = max(longest, len(kinds))
            at, last = 0, 0
            for (a, b), k in sorted(named.items()):
                if a > at:
                    turned[last, 0] += last > 0
                    last = 0
                turned[last, k + 1] += 1
                at, last = b, k + 1
            turned[last, 0] += last > 0
        owner, place, width, gold = map(np.concatenate, (owner, place, width, gold))
        values, n = np.concatenate(values), len(sentences)
        right = np.zeros((len(gold), many))
        right[gold >= 0, gold[gold >= 0]] = 1
        seen, seen_turns = {g: np.full_like(w, 1e-6) for g, w in field.weights.items()}, np.full_like(turned, 1e-6)

        def summed(x: np.ndarray, axis: int) -> np.ndarray:
            most = np.maximum(x.max(axis, keepdims=True), -1e30)
            return (most + np.log(np.exp(x - most).sum(axis, keepdims=True) + 1e-300)).squeeze(axis)

        for _ in range(rounds):
            table = np.full((n, longest + 1, reach + 1, many), -np.inf)
            table[owner, place, width] = sum(field.weights[g][values[:, c]] for c, g in enumerate(GROUPS))
            # into: all ways to a place and a turn to a kind there; onward: all ways on from a place with a kind that ended there
            t = field.turns
            into = np.full((n, longest + 1, many + 1), -np.inf)
            ended = np.full((n, longest + 1, many + 1), -np.inf)
            ended[:, 0, 0] = 0
            for p in range(longest + 1):
                if p:
                    ended[:, p, 0] = into[:, p - 1, 0]
                    d = min(p, reach)
                    ended[:, p, 1:] = summed(into[:, p - d:p, 1:][:, ::-1] + table[:, p, 1:d + 1], 1)
                into[:, p] = summed(ended[:, p, :, None] + t[None], 1)
            total = into[:, longest, 0]
            onward = np.full((n, longest + 1, many + 1), -np.inf)
            begun = np.full((n, longest + 1, many), -np.inf)
            onward[:, longest] = t[:, 0]
            for p in range(longest - 1, -1, -1):
                d = min(longest - p, reach)
                ways = np.stack([table[:, p + w, w] + onward[:, p + w, 1:] for w in range(1, d + 1)], 1)
                begun[:, p] = summed(ways, 1)
                onward[:, p] = summed(np.concatenate([(t[:, 0][None] + onward[:, p + 1, :1])[:, :, None], t[None, :, 1:] + begun[:, p, None, :]], 2), 2)
            share = np.exp(into[owner, place - width, 1:] + table[owner, place, width] + onward[owner, place, 1:] - total[owner, None])
            slope = right - share
            for c, g in enumerate(GROUPS):
                step = np.stack([np.bincount(values[:, c], slope[:, k], GROUPS[g]) for k in range(many)], 1) - decay * n * field.weights[g]
                seen[g] += step * step
                field.weights[g] += rate * step / np.sqrt(seen[g])
            step = turned - decay * n * t
            step[:, 1:] -= np.exp(ended[:, :-1, :, None] + t[None, None, :, 1:] + begun[:, :-1, None] - total[:, None, None, None]).sum((0, 1))
            step[:, 0] -= np.exp(ended[:, :-1] + t[:, 0] + onward[:, 1:, :1] - total[:, None, None]).sum((0, 1))
            step[:, 0] -= np.exp(ended[:, longest] + t[:, 0] - total[:, None]).sum(0)
            step[0, 0] = 0
            seen_turns += step * step
            field.turns = t + rate * step / np.sqrt(seen_turns)
        return field


# --- training sentences ---


def sentences(count: int = 300, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Texts with marked spans, and look-alikes that aren't personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(0, len(x))]
    number = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9)))

    def card() -> str:
        d = number(15)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def grouped(d: str, mark: str) -> str:
        return mark.join(d[k:k + 4] for k in range(0, len(d), 4))

    def address() -> str:
        name = word() + pick("", "", "." + word(), number(2), "_" + word())
        host, top = pick(word(), f"{word()}-{word()}", word()), str(pick(*TOPS[:12]))
        at, dot = pick((" [at] ", " [dot] "), (" (at) ", " (dot) "), (" (at) ", " dot "), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", "."), (" @ ", "."), (" AT ", " DOT "), ("@", " . "))
        return name + at + host + dot + pick("", "", f"{word()}{dot}") + top

    def entity(kind: int) -> str:
        if kind == 0:
            return pick(address(), address(), address(), f"{word()}.{number(2)}@{word()}.com")
        if kind == 1:
            p = [str(x) for x in rng.integers(1, 255, 4)]
            return pick(".", " . ", "[.]", "(.)").join(p)
        if kind == 2:
            return pick(card(), grouped(card(), "."), grouped(card(), " - "), grouped(card(), "  "))
        return pick(f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"00{number(2)} {number(3)} {number(3)} {number(3)}", f"({number(3)}) {number(3)} {number(4)}")

    def decoy() -> str:
        d = card()
        bad = d[:-1] + str((int(d[-1]) + 3) % 10)
        return pick(
            bad, number(4), f"{number(1)}.{number(1)}", f"{number(4)}-{number(2)}-{number(2)}", hashlib.md5(number(9).encode()).hexdigest(), f"{number(2)}:{number(2)}",
            f"{word()}@", f"@{word()}", f"${number(3)}.{number(2)}", f"{number(1)}.{number(2)}.{number(1)}", number(24), f"'{number(13)}x'", f"{word()}{number(2)}",
            f'token = "{hashlib.sha1(number(9).encode()).hexdigest()}"', grouped(bad, " "), number(7), number(9), number(11), f"{number(3)}, {number(3)}, {number(3)}, {number(2)}",
            f"{word()} at {word()}.", f"{word()} at the dot", f"the dot {word()}", f"(at) {word()}", f"[dot] {word()}", f"{word()} at {word()} dot {word()}{word()}", f"{number(2)} {number(2)} {number(2)}",
            f"{word()} at {word()} {word()}. {word()} {word()}", f"{word()}.{word()}", f"{number(3)}-{number(4)}-{number(2)}-{number(1)}", f"{number(2)}/{number(2)}/{number(4)}", f"v{number(1)}.{number(1)}.{number(2)}.{number(1)}-{word()}",
            f"{word()} {word()} at {word()} {word()} {word()}. {pick('It', 'At', 'Es', 'De', 'In')} {word()}", f"({word()})", f"( {word()} )", f"({word()}) -", "()", f"+ {word()}", f"({word()} {word()})", f"+{word()}",
            f"{word()} {word()}, {word()} {word()}.", f"{word()} dot {pick('com', 'net')}", f"{number(3)} {word()} {number(3)}", f"{number(1)},{number(3)},{number(3)}", f"({number(4)})", f"{word()} ({number(2)})", f"at {number(1)}:{number(2)} {word()}", f"{number(4)} - {number(4)}")

    out = []
    for _ in range(count):
        text, spans = word().capitalize() + " " + word(), []
        for _ in range(rng.integers(1, 3)):
            text += pick(" ", " ", ", ", ": ", " (")
            if rng.random() < 0.5:
                kind = int(rng.integers(0, 4))
                piece = entity(kind)
                spans.append((kind, len(text), len(text) + len(piece)))
                text += piece
            else:
                text += decoy()
            text += pick(" ", ". ", ", ", "\n", ") ") + word() + " " + pick(word(), "at", "dot", word())
        starts = token_starts(codes_of([text]))[0]
        if all(np.searchsorted(starts, e) - np.searchsorted(starts, s) <= ENTITY_TOKENS for _, s, e in spans):
            out.append((text, spans))
    return out


_fitted: list[Field] = []


def default_field(spark: SparkSession) -> Field:
    """The field of the fixed sentences, fitted once, in a task."""

    def run(_: Iterator[pa.RecordBatch]):
        yield pa.RecordBatch.from_arrays([pa.array([Field.fit(sentences()).packed()], pa.binary())], ["weights"])

    if not _fitted:
        rows = spark.range(1, numPartitions=1).mapInArrow(run, "weights binary").collect()
        _fitted.append(Field.unpacked(bytes(rows[0]["weights"])))
    return _fitted[0]


# --- the operator ---


def overlapping_base(base: list[Span], found: list[Span]) -> list[Span]:
    """Those found that touch no base span."""
    taken = sorted((s, e) for _, s, e in base)
    out, k = [], 0
    for kind, s, e in found:
        if not any(a < e and b > s for a, b in taken):
            out.append((kind, s, e))
    return out


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """What the field finds beside the base."""
    return overlapping_base(base, field.decode(text))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(field or default_field(spark))
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            edges = np.cumsum([0] + [len(t) + 1 for t in texts])
            more: list[list[Span]] = [[] for _ in texts]
            for k, s, e in sent.value.decoded(codes_of(texts)):
                own = int(np.searchsorted(edges, s, "right")) - 1
                more[own].append((k, s - int(edges[own]), e - int(edges[own])))
            for doc, text, found in zip(batch.column(0).to_pylist(), texts, more):
                base = base_spans(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                rows.append((doc, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + overlapping_base(base, found))))
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")).mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
