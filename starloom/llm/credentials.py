"""Secrets in texts: patterns, and formats inferred as probabilistic automata from labelled credentials.

Base kinds, always reported: assign (a name such as `password` or `api_key`, a sign, a value of 6 signs or
more; the span is the whole assignment), access (`AKIA` and capitals or digits, 20 signs or more) and hex
(24 small hexadecimal digits or more). Every other run of 16 or more token signs is a candidate.

A format is learned by state merging (ALERGIA). The prefix tree of a format's labelled credentials has,
per state, how many credentials came through it, ended in it and went on with which sign. States are
visited from the root; one whose frequencies, and those of all states after it, differ from an earlier
state's by less than a Hoeffding bound is merged into it, and one that differs from all becomes a state of the
automaton. So `ghp_` keeps four states in a row and the random signs after it fall into a loop.

Labelled are the values that the base patterns find in the documents, and examples drawn by rule from the
public formats below. One more automaton is learned from candidates of the documents, and these in capitals, as
the format of ordinary tokens. A candidate is added as a span of the format that gives it the highest likelihood if this
is above the ordinary format's by a margin, per sign and in all, and it is about as likely and as long as the
format's own credentials. A format learned from a base kind's values has a name of its own (`like_hex`): what only
resembles these values is not of the base kind. What the fit reads is bounded: PER_KIND values per kind and ORDINARY candidates, distinct ones
of the smallest hashes. All texts are searched whole, and all candidates scored.

A null text has no spans. Rows keep their doc_id, whatever it is; equal rows have equal spans.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import words
from starloom.llm.common import Scratch

BASE = ("assign", "access", "hex")
#: Base kind -> the kind of added spans in the format learned from its values.
LIKE = {kind: f"like_{kind}" for kind in BASE}
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
VALUE_SIGNS, ACCESS_SIGNS, HEX_SIGNS, TOKEN_SIGNS = 6, 20, 24, 16

LETTERS_DIGITS = string.ascii_letters + string.digits
BASE64 = LETTERS_DIGITS + "+/"
URL_SAFE = LETTERS_DIGITS + "-_"
#: Publicly documented credential formats. Kind, and its parts in order: a fixed text, or an
#: alphabet with the least and the greatest number of signs drawn from it.
PUBLIC_FORMATS: dict[str, list] = {
    "github": ["ghp_", (LETTERS_DIGITS, 36, 36)],
    "gitlab": ["glpat-", (URL_SAFE, 20, 20)],
    "google": ["AIza", (URL_SAFE, 35, 35)],
    "slack": ["xoxb-", (string.digits, 11, 12), "-", (string.digits, 11, 12), "-", (LETTERS_DIGITS, 24, 24)],
    "stripe": ["sk_live_", (LETTERS_DIGITS, 24, 24)],
    "npm": ["npm_", (LETTERS_DIGITS, 36, 36)],
    "sendgrid": ["SG.", (URL_SAFE, 22, 22), ".", (URL_SAFE, 43, 43)],
    "jwt": ["eyJ", (URL_SAFE, 17, 60), ".eyJ", (URL_SAFE, 20, 120), ".", (URL_SAFE, 43, 43)],
    "base64": [(BASE64, 32, 64)],
}
EXAMPLES, PER_KIND, ORDINARY = 300, 300, 1000
#: A label with fewer values is not learned.
LEAST_VALUES = 20
#: Chance of taking two equal distributions for different ones.
ALPHA = 0.05
#: By how much, in natural logarithms, a format must be likelier than the ordinary one.
MARGIN_PER_SIGN, MARGIN = 0.5, 12.0
#: How far, per sign, a candidate may fall below the least likely of a format's labelled credentials.
SLACK = 0.3
#: How many times shorter, or longer, than all of them.
STRETCH = 1.25

SPANS_SCHEMA = "array<struct<kind: string, start: int, end: int, score: double>>"


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


# ---- automata


@dataclass
class _State:
    """How many texts came, ended, and went on with each sign, and to which state."""

    came: int = 0
    ended: int = 0
    went: dict[str, int] = field(default_factory=dict)
    to: dict[str, int] = field(default_factory=dict)


def prefix_tree(texts: Iterable[str]) -> list[_State]:
    states = [_State()]
    for text in texts:
        at = 0
        states[0].came += 1
        for sign in text:
            state = states[at]
            state.went[sign] = state.went.get(sign, 0) + 1
            if sign not in state.to:
                state.to[sign] = len(states)
                states.append(_State())
            at = state.to[sign]
            states[at].came += 1
        states[at].ended += 1
    return states


def _differ(x: int, n: int, y: int, m: int, alpha: float) -> bool:
    """Whether two shares are too far apart to be of one distribution, by Hoeffding's inequality."""
    if not n or not m:
        return False
    bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
    return abs(x / n - y / m) >= bound


def _compatible(states: list[_State], one: int, other: int, alpha: float) -> bool:
    """Whether two states, and all states after them by the same signs, agree."""
    open_pairs = [(one, other)]
    while open_pairs:
        a, b = (states[i] for i in open_pairs.pop())
        if _differ(a.ended, a.came, b.ended, b.came, alpha):
            return False
        for sign in a.went.keys() | b.went.keys():
            if _differ(a.went.get(sign, 0), a.came, b.went.get(sign, 0), b.came, alpha):
                return False
        # `other` is in a tree, so this ends
        open_pairs += [(a.to[sign], b.to[sign]) for sign in b.to if sign in a.to]
    return True


def _merge(states: list[_State], into: int, tree: int) -> list[tuple[int, str]]:
    """Add the counts of a state and of the tree behind it to another state and those behind that one. Returns
    the ways (state, sign) that are new there."""
    open_pairs, new = [(into, tree)], []
    while open_pairs:
        at, other = open_pairs.pop()
        a, b = states[at], states[other]
        a.came += b.came
        a.ended += b.ended
        for sign, n in b.went.items():
            a.went[sign] = a.went.get(sign, 0) + n
            if sign in a.to:
                open_pairs.append((a.to[sign], b.to[sign]))
            else:
                a.to[sign] = b.to[sign]
                new.append((at, sign))
    return new


@dataclass
class Automaton:
    """Per state: sign -> (next state, log of its chance), and the log of the chance to end.

    A sign that a state never went on with has the chance of its frequency in the whole sample, smoothed,
    times that of a surprise, and leads back to the first state that knows it.
    """

    moves: list[dict[str, tuple[int, float]]]
    ends: list[float]
    surprise: list[float]
    frequency: dict[str, float]
    unknown: float
    first_with: dict[str, int]

    @classmethod
    def learn(cls, texts: list[str], alpha: float = ALPHA) -> Automaton:
        states = prefix_tree(texts)
        kept = {0: 0}
        waiting = deque((0, sign) for sign in sorted(states[0].to))
        while waiting:
            at, sign = waiting.popleft()
            state = states[at].to[sign]
            if state in kept:
                continue
            # a rare state agrees with many: the one it comes from goes first, then the latest
            for other in [at, *[k for k in reversed(kept) if k != at]]:
                if _compatible(states, other, state, alpha):
                    states[at].to[sign] = other
                    new = _merge(states, other, state)
                    waiting += sorted(way for way in new if way[0] in kept)
                    break
            else:
                kept[state] = len(kept)
                waiting += [(state, s) for s in sorted(states[state].to)]
        moves, ends, surprise = [], [], []
        total: dict[str, int] = defaultdict(int)
        first_with: dict[str, int] = {}
        for k, state in enumerate(states[i] for i in kept):
            weight = state.came + 1.0
            moves.append({s: (kept[state.to[s]], math.log(n / weight)) for s, n in state.went.items()})
            ends.append(math.log((state.ended + 0.5) / weight))
            surprise.append(math.log(0.5 / weight))
            for s, n in state.went.items():
                total[s] += n
                first_with.setdefault(s, kept[state.to[s]])
        n_signs = sum(total.values()) + 128
        frequency = {s: math.log((n + 1) / n_signs) for s, n in total.items()}
        return cls(moves, ends, surprise, frequency, math.log(1 / n_signs), first_with)

    def log_likelihood(self, text: str) -> float:
        at, out = 0, 0.0
        for sign in text:
            move = self.moves[at].get(sign)
            if move:
                at, chance = move
                out += chance
            else:
                out += self.surprise[at] + self.frequency.get(sign, self.unknown)
                at = self.first_with.get(sign, 0)
        return out + self.ends[at]


class Format(NamedTuple):
    """An automaton, and the least likelihood per sign and the lengths that its credentials may have."""

    automaton: Automaton
    floor: float
    shortest: float
    longest: float


@dataclass
class Model:
    formats: dict[str, Format]
    ordinary: Automaton | None

    @classmethod
    def learn(cls, labelled: dict[str, list[str]], usual: list[str]) -> Model:
        formats = {}
        for kind, texts in labelled.items():
            if len(texts) >= LEAST_VALUES:
                a = Automaton.learn(texts)
                lengths = [len(t) for t in texts]
                floor = min(a.log_likelihood(t) / len(t) for t in texts) - SLACK
                formats[kind] = Format(a, floor, min(lengths) / STRETCH, max(lengths) * STRETCH)
        both = [*usual, *[t.upper() for t in usual if t.isalpha()]]
        return cls(formats, Automaton.learn(both) if len(usual) >= LEAST_VALUES else None)

    def judge(self, token: str) -> tuple[str, float] | None:
        """The likeliest format of a token and its margin per sign, if it is one by the margins."""
        n = len(token)
        able = {k: f for k, f in self.formats.items() if f.shortest <= n <= f.longest}
        if not self.ordinary or not able:
            return None
        scores = {kind: f.automaton.log_likelihood(token) for kind, f in able.items()}
        kind = max(scores, key=scores.__getitem__)
        over = scores[kind] - self.ordinary.log_likelihood(token)
        if scores[kind] >= able[kind].floor * n and over >= max(MARGIN, MARGIN_PER_SIGN * n):
            return kind, round(over / n, 3)
        return None


def examples(n: int, seed: int = 11) -> dict[str, list[str]]:
    """So many credentials of each public format, drawn by rule; reruns agree."""
    out = {}
    for kind, parts in PUBLIC_FORMATS.items():
        rng = random.Random(f"{seed}:{kind}")
        draw = lambda p: p if isinstance(p, str) else "".join(rng.choices(p[0], k=rng.randint(p[1], p[2])))  # noqa: E731,B023
        out[kind] = ["".join(map(draw, parts)) for _ in range(n)]
    return out


# ---- texts


def _table(signs: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(signs.encode())] = True
    return out


HEX_BYTES, TOKEN_BYTES = _table("0123456789abcdef"), _table(LETTERS_DIGITS + "+/=_.-")


def _runs(data: np.ndarray, table: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The longest runs of the table's bytes, of `least` bytes or more. `data` has a byte not of it at both ends."""
    inside = table[data]
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


class Found(NamedTuple):
    """Per text: base spans (kind, start, end, value), and candidates (start, end, token)."""

    spans: list[list[tuple[str, int, int, str]]]
    candidates: list[list[tuple[int, int, str]]]


def search(column: pa.Array) -> Found:
    """Base spans and candidates of all texts; offsets in code points. All texts are searched at once, with
    a zero byte, which is of no pattern, before and after each."""
    data, offsets = words.text_bytes(column)
    n = len(offsets) - 1
    joined = np.zeros(len(data) + n + 1, np.uint8)
    joined[words.ragged(offsets[:-1] + np.arange(1, n + 1), np.diff(offsets))] = data
    raw = joined.tobytes()
    base = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(raw) if len(m[2]) >= VALUE_SIGNS]
    base += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(raw) if len(m[0]) >= ACCESS_SIGNS]
    base += [("hex", s, e, raw[s:e]) for s, e in _runs(joined, HEX_BYTES, HEX_SIGNS)]
    base.sort(key=lambda x: (x[1], BASE.index(x[0])))
    taken_from, taken_to = np.array([b[1] for b in base], np.int64), np.array([b[2] for b in base], np.int64)
    taken_to = np.maximum.accumulate(taken_to) if len(base) else taken_to
    tokens = []
    for s, e in _runs(joined, TOKEN_BYTES, TOKEN_SIGNS):
        token = raw[s:e].rstrip(b".-_/+")
        e = s + len(token)
        token = token.lstrip(b".-_/+=")
        s = e - len(token)
        last = int(np.searchsorted(taken_from, e)) - 1  # of the base spans that start before its end
        if len(token) >= TOKEN_SIGNS and (last < 0 or taken_to[last] <= s):
            tokens.append(("", s, e, token))
    out = Found([[] for _ in range(n)], [[] for _ in range(n)])
    every = base + tokens
    if not every:
        return out
    at = np.array([x[1:3] for x in every], np.int64)
    later = np.flatnonzero((joined & 0xC0) == 0x80)  # bytes of a sign after its first
    text_start = offsets[:-1] + np.arange(1, n + 1)
    text = np.searchsorted(text_start, at[:, 0], "right") - 1
    signs = lambda p: p - np.searchsorted(later, p)
    start, end = (signs(at[:, k]) - signs(text_start[text]) for k in (0, 1))
    for (kind, _, _, value), t, s, e in zip(every, text.tolist(), start.tolist(), end.tolist(), strict=True):
        if kind:
            out.spans[t].append((kind, s, e, value.decode()))
        else:
            out.candidates[t].append((s, e, value.decode()))
    return out


FOUND_SCHEMA = (
    "spans array<struct<kind: string, start: int, end: int, value: string>>,"
    " candidates array<struct<start: int, end: int, token: string>>"
)


def extract(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) as doc_id, spans and candidates."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
    token = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, 500):
            found = search(batch.column("text"))
            spans = [[dict(zip(span.names, s, strict=True)) for s in x] for x in found.spans]
            candidates = [[dict(zip(token.names, c, strict=True)) for c in x] for x in found.candidates]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(spans, pa.list_(span)), pa.array(candidates, pa.list_(token))],
                names=["doc_id", "spans", "candidates"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {FOUND_SCHEMA}")


def train(found: DataFrame, per_kind: int = PER_KIND, ordinary: int = ORDINARY) -> Model:
    """Automata of the labelled values in `found` (from `extract`, a written table), of the public formats, and of
    ordinary tokens. At most so many distinct values come to the driver, those of the smallest hashes."""
    labelled = dict(examples(EXAMPLES))
    values = found.select(F.explode("spans").alias("s")).select("s.kind", "s.value").distinct()
    for kind in BASE:
        of_kind = values.filter(F.col("kind") == kind).select("value")
        chosen = of_kind.orderBy(F.xxhash64("value"), "value").limit(per_kind).collect()
        labelled[LIKE[kind]] = [r.value for r in chosen]
    tokens = found.select(F.explode("candidates.token").alias("token")).distinct()
    usual = [r.token for r in tokens.orderBy(F.xxhash64("token"), "token").limit(ordinary).collect()]
    return Model.learn(labelled, usual)


def score(found: DataFrame, model: Model) -> DataFrame:
    """`found` as doc_id and spans (SPANS_SCHEMA), by start and then base kinds before others."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def judged(spans: list, candidates: list) -> list[dict]:
        out = [Span(s["kind"], s["start"], s["end"], 1.0) for s in spans or []]
        for c in candidates or []:
            verdict = model.judge(c["token"])
            if verdict:
                out.append(Span(verdict[0], c["start"], c["end"], verdict[1]))
        place = {k: i for i, k in enumerate(BASE)}
        return [s._asdict() for s in sorted(out, key=lambda s: (s.start, place.get(s.kind, len(place)), s.kind, s.end))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("spans").to_pylist(), batch.column("candidates").to_pylist(), strict=True)
            spans = pa.array([judged(s, c) for s, c in both], pa.list_(kind))
            yield pa.record_batch([batch.column("doc_id"), spans], names=["doc_id", "spans"])

    id_type = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {id_type}, spans {SPANS_SCHEMA}")


def detect(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """`docs` (doc_id, text) as doc_id and spans: the base ones, and those of candidates in a learned format."""
    found = scratch.keep(extract(docs), "found")
    return score(found, train(found))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans as one, by the first."""
    joined: list[list] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if joined and s.start < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], s.end)
        else:
            joined.append([s.start, s.end, f"<{s.kind}>"])
    cuts = [0, *[p for s, e, _ in joined for p in (s, e)], len(text)]
    left = [text[a:b] for a, b in list(pairwise(cuts))[::2]]
    return "".join([left[0], *[kind + rest for (_, _, kind), rest in zip(joined, left[1:], strict=True)]])
