"""Secret scans: fixed patterns, and guess costs of values that stand in a credential context.

The cost of a value is the least log10 of guesses over all its segmentations into common words (letters in
either case, usual digit-for-letter swaps), dates, repeats of a unit of at most UNIT places, keyboard walks (dearer by turns), alphabet or digit runs and
brute-force spans: a shortest path over the places of the value, each kind with all its ends. Walks, runs and repeats are found as longest stretches, and
inside a stretch the best beginning is kept as a running minimum, so the work is linear in the length. Values that stand after a credential word and
cost at least GUESSES (twice that if letters only, after `:` or `=`, where the word list is too short to tell prose) are reported as spans of the kind `guess`, unless a base span overlaps them. The base
spans stay as they are; n_weak counts base assignments whose value costs less (placeholders).

Spans are those of the whole match, in code points, end exclusive. Defined cases: null text counts as empty and has no
spans; a text is read whole, whatever its length; repeated rows get equal results; doc_id may be null; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16}
KINDS = ("assign", "access", "hex", "guess")
#: What may stand before a value that the fixed pattern doesn't cover.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|(?:api|access|private|client|signing)[_ -]?(?:key|secret|token))["']?\s{0,8}(:=|=>|->|[:=]|\bis\b)\s{0,8}["'`]?([^\s"'`<>,;]{6,})""",
    re.IGNORECASE | re.ASCII,
)
#: log10 of guesses from which a value counts as a secret.
GUESSES = 10.0
#: Places of the longest unit of a repeat.
UNIT = 64
# log10 of guesses: of every span; of a walk, for each place and turn; of a run, for each place; of a repeat, beside its unit's.
SPAN, WALK, WALK_PLACE, WALK_TURN, RUN, RUN_PLACE, REPEAT, YEAR, DATE = 0.3, 1.7, 0.1, 0.6, 1.0, 0.05, 0.5, 2.1, 4.6

# Common words of passwords, the likeliest first.
WORDS = """password admin welcome letmein monkey dragon master login hello secret shadow sunshine princess football baseball
superman batman trustno iloveyou access flower summer winter spring autumn love money computer internet server
database root user guest test demo example sample default change changeme token key private public temp temporary
pass word qwerty company office system network service account manager support backup oracle mysql postgres
redis mongo docker cloud azure google amazon github apple orange banana cheese coffee chocolate cookie freedom
whatever killer hunter ranger soccer hockey tiger lion eagle falcon silver golden diamond purple yellow green
black white blue red house mouse table chair window garden river mountain ocean street""".split()
RANK = {w: math.log10(i + 2) for i, w in enumerate(WORDS)}
SWAPS = str.maketrans("013457@$!", "oleastasi")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans("~!@#$%^&*()_+{}|:\"<>?", "`1234567890-=[]\\;',./")
DATES = re.compile(r"(?=((?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\3(?:19|20)\d\d))", re.ASCII)
YEARS = re.compile(r"(?=(?:19|20)\d\d)", re.ASCII)


class Words:
    """Common words and log10 of their ranks, the likeliest first, in lower case."""

    def __init__(self, words: list[str]) -> None:
        self.rank: dict[str, float] = {}
        for i, w in enumerate(words):
            self.rank.setdefault(w, math.log10(i + 2))
        self.sizes: dict[str, list[int]] = defaultdict(list)
        for w in self.rank:
            if len(w) >= 3:
                self.sizes[w[:3]].append(len(w))
        self.sizes = {k: sorted(set(v)) for k, v in self.sizes.items()}

    def cost(self, part: str, plain: str, low: str) -> float | None:
        """What a word costs as it is written: part, as in the list (plain), and in lower case."""
        if (r := self.rank.get(plain)) is None:
            return None
        upper, size = sum(c.isupper() for c in part), len(part)
        return r + (0.3 if upper in (1, size) else 0.3 * min(upper, size - upper) + (0.3 if upper else 0)) + (0.3 if plain != low else 0)


COMMON = Words(WORDS)
# place of each key on the board; letters, digits and the rest by code point
_AT = {k: (x + 0.5 * y, y) for y, row in enumerate(ROWS) for x, k in enumerate(row)}
_KEY = np.array([_AT.get(chr(i), (np.nan, np.nan)) for i in range(128)])
_PLACE = np.array([math.log10(10 if chr(i).isdigit() else 26 if chr(i).isalpha() else 33) for i in range(128)] + [2.0])
_ALNUM = np.array([chr(i).isalnum() for i in range(128)])


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def brute_places(value: str) -> np.ndarray:
    """log10 of guesses of each place by brute force."""
    return _PLACE[np.minimum(_points(value), 128)]


def steps(low: str) -> tuple[np.ndarray, np.ndarray]:
    """From each place to the next one: the direction of the walk on the keyboard, and of the run in the alphabet; 0: none."""
    keys, cp = np.minimum(_points(low.translate(SHIFTED)), 127), np.minimum(_points(low), 127)
    step = np.diff(_KEY[keys], axis=0)
    walks = (np.abs(step) <= 1).all(1) & step.any(1)
    way = np.where(walks, 10 + 4 * np.sign(np.nan_to_num(step[:, 1])) + np.sign(np.nan_to_num(step[:, 0])), 0).astype(np.int64)
    d = np.diff(cp)
    return way, np.where((np.abs(d) == 1) & _ALNUM[cp[:-1]] & _ALNUM[cp[1:]], d, 0)


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) index of the longest stretches of True of at least such a length."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    ok = b - a >= least
    return a[ok], b[ok]


def repeats(cp: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, unit) of the longest stretches that repeat a unit of their own twice or more (three times a single place)."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for p in range(1, min(UNIT, len(cp) // 2) + 1):
        a, b = _stretches(cp[p:] == cp[:-p], max(p, 2))
        b = b + p
        # a unit that is itself a repeat adds nothing to the stretch of the shorter unit
        for q in [q for q in found if p % q == 0]:
            starts, ends = found[q]
            i = np.searchsorted(starts, a, side="right") - 1
            own = (i < 0) | (ends[np.maximum(i, 0)] < b)
            a, b = a[own], b[own]
        if len(a):
            found[p] = a, b
    return [(i, j, p) for p, (a, b) in found.items() for i, j in zip(a.tolist(), b.tolist(), strict=True)]


def guess_cost(value: str, words: Words = COMMON) -> float:
    """Least log10 of guesses over all segmentations of value; 0 for the empty one."""
    n = len(value)
    if not n:
        return 0.0
    low = value.lower()
    if len(low) != n:
        low = value
    plain = low.translate(SWAPS)
    cp = _points(value)
    brute = np.concatenate([[0.0], np.cumsum(brute_places(value))])
    # spans with one end: by end
    to: dict[int, list[tuple[int, float]]] = defaultdict(list)
    sizes = words.sizes
    for i in [i for i in range(n - 2) if plain[i : i + 3] in sizes]:
        for k in sizes[plain[i : i + 3]]:
            if i + k <= n and (c := words.cost(value[i : i + k], plain[i : i + k], low[i : i + k])) is not None:
                to[i + k].append((i, c))
    for m in DATES.finditer(value):
        to[m.end(1)].append((m.start(), DATE))
    for m in YEARS.finditer(value):
        to[m.start() + 4].append((m.start(), YEAR))
    # stretches: (start, end, unit, least length, levels, fixed part): a span costs the fixed part and what the level rises by, from that of starts to that of ends
    way, run = steps(low)
    stretch: list[tuple[int, int, int, int, tuple | None, float]] = []
    a, b = _stretches(way != 0, 2)
    if len(a):
        turn = np.concatenate([[0], (way[1:] != way[:-1]) & (way[1:] != 0) & (way[:-1] != 0), [0, 0]]).cumsum()
        # the turns of a walk from i to e lie at i + 1 .. e - 2
        rise = WALK_PLACE * np.arange(n + 1)
        ends, starts = rise + WALK_TURN * turn[np.maximum(np.arange(n + 1) - 2, 0)], rise + WALK_TURN * turn[np.minimum(np.arange(n + 1), n)]
        stretch += [(i, j + 1, 1, 3, (starts, ends), WALK) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    for d in (1, -1):
        a, b = _stretches(run == d, 2)
        rise = RUN_PLACE * np.arange(n + 1)
        stretch += [(i, j + 1, 1, 3, (rise, rise), RUN) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    stretch += [(i, j, p, max(2 * p, 3), None, REPEAT + float(brute[i + p] - brute[i])) for i, j, p in repeats(cp)]
    stretch.sort(key=lambda x: x[0], reverse=True)
    # only places where a span may begin or end count; between them only brute force goes on
    at = np.zeros(n + 1, bool)
    at[[0, n]] = True
    for e, xs in to.items():
        at[e] = True
        at[[i for i, _ in xs]] = True
    for x in stretch:
        at[x[0] : x[1] + 1] = True
    best: dict[int, float] = {}
    least = math.inf  # the best beginning of a brute-force span so far, less what it has behind it
    live: list[tuple] = []
    up = brute.tolist()
    for e in np.flatnonzero(at).tolist():
        x = least + up[e] if e else 0.0
        for i, c in to.get(e, ()):
            x = min(x, best[i] + SPAN + c)
        if live and min(s[1] for s in live) < e:
            live = [s for s in live if s[1] >= e]
        for start, _, unit, shortest, level, fixed, low_of in live:
            i = e - shortest
            if i >= start:
                k = i % unit
                y = best[i] if level is None else best[i] - level[0][i]
                if y < low_of[k]:
                    low_of[k] = y
            y = low_of[e % unit if level is None else 0] + fixed + SPAN
            if level is not None:
                y += level[1][e]
            if y < x:
                x = y
        while stretch and stretch[-1][0] <= e:
            new = stretch.pop()
            live.append((*new, [math.inf] * new[2]))
        best[e] = x
        least = min(least, x - up[e] + SPAN)
    return float(best[n])


def spans(text: str | None, guesses: float = GUESSES, words: Words = COMMON) -> tuple[list[tuple[int, int, int, float]], int]:
    """(start, kind's number, end, cost; -1 where it isn't worked out) by start and kind, and how many base values cost less than guesses."""
    found, weak = [], 0
    if not text:
        return found, weak
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST["assign"]:
            cost = guess_cost(m[2], words)
            weak += cost < guesses
            found.append((m.start(), 0, m.end(), cost))
    found += [(m.start(), 1, m.end(), -1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end(), -1.0) for m in HEX.finditer(text)]
    base = sorted(found)
    starts, furthest = [x[0] for x in base], [0]
    for x in base:
        furthest.append(max(furthest[-1], x[2]))
    for m in CONTEXT.finditer(text):
        value = m[2].rstrip(".!?)]}")
        end, letters = m.start(2) + len(value), value.isalpha()
        if len(value) < 6 or (letters and m[1] not in (":", "=", ":=")) or furthest[bisect_left(starts, end)] > m.start():
            continue
        if (cost := guess_cost(value, words)) >= guesses * (2 if letters else 1):
            found.append((m.start(), 3, end, cost))
    return sorted(found), weak


def _scan(guesses: float, words: Words):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda xs: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in xs)
        for batch in batches:
            n, sha, all_, weak, hardest = [], [], [], [], []
            for t in batch.column("text"):
                got, w = spans(t.as_py(), guesses, words)
                n.append([sum(x[1] == k for x in got) for k in range(4)])
                sha.append(hashlib.sha256(line([x for x in got if x[1] < 3]).encode()).hexdigest())
                all_.append(line(got))
                weak.append(w)
                hardest.append(max((x[3] for x in got if x[3] >= 0), default=None))
            counts = [pa.array([x[k] for x in n], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts[:3], pa.array(sha, pa.string()), pa.array(all_, pa.string()), counts[3], pa.array(weak, pa.int64()), pa.array(hardest, pa.float64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "n_weak", "log10_guesses"],
            )

    return scan


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", guesses: float = GUESSES, words: list[str] | None = None) -> DataFrame:
    """Counts, spans and the cost of the hardest value of every row of docs. words: a list of common words, the likeliest first, in place of WORDS; it goes to each task."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _scan(guesses, Words(words) if words else COMMON), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, n_weak long, log10_guesses double"
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
