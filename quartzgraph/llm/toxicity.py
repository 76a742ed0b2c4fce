"""Toxicity of texts whose words may be disguised, by a noisy channel.

A word that holds signs or digits among its letters, a letter three times or more in a row, or that is spelled
out with gaps, is decoded, however long it is: each sign stands for some letters or for nothing, repeated letters may
collapse, and Viterbi finds the likeliest letters under a character trigram model and these channel costs. In what is spelled
out with gaps, a gap may end a word, so that several words come apart; it is also read as one word. The restored words are then looked up in a lexicon of words and beginnings that are much more frequent in toxic texts, and a
logistic regression scores the text by how much of it the lexicon finds.

The character model counts the trigrams of all runs of letters of all documents, exactly; the ALPHABET commonest letters are told apart, the others are
one class, which bounds the model. Viterbi keeps every state that can still win: one that is dearer than the best by more than MARGIN can't, as any way on from it
costs at most that much more from the best one. Lexicon and regression are fitted on the driver, on at most TRAIN_TOXIC
and TRAIN_CLEAN labelled rows, those with the least hashes of doc_id that aren't held out; the regression's level is then moved from the share of toxic rows
in that sample to their share in all training rows, so that a score means the same at every size. All texts are scored whole.

Defined cases: null and empty texts get the score of a text without words; without training rows of both
classes every score is 0; repeated rows get equal results; doc_id may be null (it counts as ''); extra
columns are ignored; a doc_id with several labels is toxic if one says so.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, remove, table, written

TRAIN_TOXIC, TRAIN_CLEAN = 1500, 2500
#: Letters that the character model tells apart, a to z among them.
ALPHABET = 96
BEGIN, STOP = ord("^"), ord("$")
# What a sign or digit may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou",
}
ODD = re.compile(r"[^\w]|[\d_]|(.)\1\1")
BLANK = re.compile(r"\s")
LETTER = re.compile(r"[^\W\d_]")
SPELLED = re.compile(r"(?<![\w@$!|*])(?:[\w@$!|*](?:[ \t]|[._\-*])){3,}[\w@$!|*](?![\w@$!|*])")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
FILLING = re.compile(r"([^\w])\1{3,}")


class CharModel:
    """Character trigrams of words, mixed with shorter contexts, from the counts that char_counts gathers: (a, b, c) -> n over the characters of letters and two marks."""

    def __init__(self, letters: list[str], counts: np.ndarray) -> None:
        self.of = {c: i for i, c in enumerate(["^", "$", None, *letters])}
        self.n3 = counts.astype(np.float64)
        self.n2 = self.n3.sum(0)
        self.n1 = self.n2.sum(0)
        self.kept: dict[str, float] = {}

    def cost(self, context: str, c: str) -> float:
        key = context + c
        if (x := self.kept.get(key)) is None:
            a, b, z = (self.of.get(k, 2) for k in key)
            share = lambda n, all_: float(n) / max(1.0, float(all_))
            p = 0.02 / 64 + 0.08 * share(self.n1[z], self.n1.sum()) + 0.2 * share(self.n2[b, z], self.n2[b].sum()) + 0.7 * share(self.n3[a, b, z], self.n3[a, b].sum())
            x = self.kept[key] = -math.log(p)
        return x


#: Largest cost of a character under the model.
DEAREST = -math.log(0.02 / 64)
#: From the best state the way of another one can be gone: once a letter is written where the other repeats its last, and until two letters are written the contexts differ.
MARGIN = 3 * DEAREST + 4.0


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@cache
def _common_ids() -> tuple[np.ndarray, np.ndarray]:
    """Number of each code point among the marks and the letters below 0x180 (-1: another one), and the code points by number."""
    known = np.array([BEGIN, STOP, *(i for i in range(0x180) if chr(i).isalpha() and chr(i).lower() == chr(i))], np.int64)
    of = np.full(0x110000, -1, np.int32)
    of[known] = np.arange(len(known))
    return of, known


def trigrams(text: str) -> np.ndarray:
    """(a, b, c) code points, three rows, of all runs of letters of a text, lower-cased, as ^^word$."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.int32)
    ink = np.zeros(len(cp) + 2, np.int8)
    ink[1:-1] = _letters()[cp]
    edges = np.flatnonzero(np.diff(ink))
    starts, size = edges[::2], edges[1::2] - edges[::2]
    at = np.cumsum(size + 3) - (size + 3)
    seq = np.full(int((size + 3).sum()), BEGIN, np.int32)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    seq[np.repeat(at + 2, size) + inside] = cp[np.repeat(starts, size) + inside]
    seq[at + size + 2] = STOP
    live = np.ones(len(seq), bool)
    live[at] = live[at + 1] = False
    i = np.flatnonzero(live)
    return np.stack([seq[i - 2], seq[i - 1], seq[i]])


def _pieces(batches: Iterator[pa.RecordBatch], chars: int = 1 << 19) -> Iterator[str]:
    """The texts in runs of about so many characters; a longer text is cut at blanks."""
    part, size = [], 0
    for batch in batches:
        for t in batch.column(0):
            t, at = t.as_py() or "", 0
            while len(t) - at > chars:
                m = BLANK.search(t, at + chars)
                end = m.start() if m else len(t)
                yield t[at:end]
                at = end
            part.append(t[at:])
            size += len(part[-1]) + 1
            if size > chars:
                yield "\n".join(part)
                part, size = [], 0
    if part:
        yield "\n".join(part)


def _count_chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of, known = _common_ids()
    d = len(known)
    common, rare = np.zeros(d**3, np.int64), Counter()
    for text in _pieces(batches):
        abc = trigrams(text)
        i = of[abc]
        ok = (i >= 0).all(0)
        i = i[:, ok]
        common += np.bincount((i[0] * d + i[1]) * d + i[2], minlength=d**3)
        if not ok.all():
            a, b, c = abc[:, ~ok].astype(np.int64)
            keys, n = np.unique((a << 42) | (b << 21) | c, return_counts=True)
            rare.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
            if len(rare) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(list(rare), pa.int64()), pa.array(list(rare.values()), pa.int64())], names=["key", "n"])
                rare.clear()
    at = np.flatnonzero(common)
    keys = (known[at // (d * d)] << 42) | (known[at // d % d] << 21) | known[at % d]
    yield pa.RecordBatch.from_arrays([pa.array([*keys.tolist(), *rare], pa.int64()), pa.array([*common[at].tolist(), *rare.values()], pa.int64())], names=["key", "n"])


def char_counts(docs: DataFrame, text: str = "text") -> tuple[list[str], np.ndarray]:
    """The letters that are told apart, and counts of the trigrams of all runs of letters of all texts, without labels: the corpus is
    counted whole, in a table that grows with what it holds; what reaches the driver is its sum by classes, at most (ALPHABET + 3)**3 rows."""
    got = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(_count_chars, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    part = lambda k: F.shiftright("key", 21 * k).bitwiseAND(F.lit(0x1FFFFF))
    got = written(got.select(part(2).alias("a"), part(1).alias("b"), part(0).alias("c"), "n"), "tox-chars")
    latin = list(range(ord("a"), ord("z") + 1))
    others = got.filter(~F.col("c").isin(*latin, STOP)).groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(ALPHABET - len(latin))
    letters = [*latin, *sorted(r["c"] for r in others.collect())]
    number = F.create_map(*[F.lit(x) for i, c in enumerate([BEGIN, STOP, None, *letters]) if c is not None for x in (c, i)])
    of = lambda c: F.coalesce(number[F.col(c)], F.lit(2)).alias(c)
    sums = got.select(of("a"), of("b"), of("c"), "n").groupBy("a", "b", "c").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(letters) + 3,) * 3, np.int64)
    counts[tuple(sums[c].to_numpy(np.int64) for c in "abc")] = sums["n"].to_numpy(np.int64)
    remove(got)
    return [chr(c) for c in letters], counts


def decode(token: str, model: CharModel) -> str:
    """The likeliest letters behind a token, lower-cased; at a blank a word may end, and the words have a blank between them."""
    # a letter three times or more is one or two of it; more than three of a sign say no more than three
    token = FILLING.sub(r"\1\1\1", STRETCHED.sub(r"\1\1", token.lower()))
    # context -> cost and a chain (before, character) of what was read
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for c in token:
        after: dict[str, tuple[float, tuple | None]] = {}

        def put(context: str, cost: float, word: tuple | None, after: dict = after) -> None:
            if context not in after or cost < after[context][0]:
                after[context] = (cost, word)

        stands = STANDS_FOR.get(c, "")
        for context, (cost, word) in states.items():
            if c == " ":
                put(context, cost, word)
                if context != "^^":
                    put("^^", cost + model.cost(context, "$"), (word, " "))
            elif c.isalpha():
                put(context[1] + c, cost + 0.05 + model.cost(context, c), (word, c))
                if context[1] == c:
                    put(context, cost + 1.0, word)
            else:
                for x in stands:
                    put(context[1] + x, cost + 0.7 + 0.4 * (len(stands) - 1) + model.cost(context, x), (word, x))
                    if context[1] == x:
                        put(context, cost + 1.5, word)
                put(context, cost + (8.0 if c.isdigit() else 5.0 if stands else 1.0), word)
        least = min(x for x, _ in after.values()) + MARGIN
        states = {k: v for k, v in after.items() if v[0] <= least}

    def read(word: tuple | None) -> str:
        out = []
        while word:
            word, c = word
            out.append(c)
        return "".join(reversed(out))

    last = [(cost + model.cost(context, "$"), word) for context, (cost, word) in states.items()]
    least = min(cost for cost, _ in last)
    return min(read(word) for cost, word in last if cost == least)


def bare(token: str) -> str:
    """The token without a repeated sign at either end, and then without other signs there that stand for no letter."""
    i, j = 0, len(token)
    sign = lambda c: not (c.isalnum() or c == "_")
    if j > 1 and sign(token[0]) and token[1] == token[0]:
        while i < j and token[i] == token[0]:
            i += 1
    if j - i > 1 and sign(token[-1]) and token[j - 2] == token[-1]:
        while j > i and token[j - 1] == token[-1]:
            j -= 1
    while i < j and sign(token[i]) and token[i] not in STANDS_FOR:
        i += 1
    while j > i and sign(token[j - 1]) and token[j - 1] not in STANDS_FOR:
        j -= 1
    return token[i:j]


def restore(token: str, model: CharModel) -> str:
    """The word behind a token, lower-cased and without punctuation around it."""
    if token.isalpha():
        core = token.lower()
        return decode(core, model) if ODD.search(core) else core
    core = bare(token).lower()
    if ODD.search(core) and LETTER.search(core):
        return decode(core, model)
    return core


def restored(token: str, model: CharModel) -> list[str]:
    """The words behind a key of tokens(): several for what is spelled out, which holds blanks."""
    if " " not in token:
        return [w] if (w := restore(token, model)) else []
    if not LETTER.search(token):
        return []
    # read as one word it is a key of its own
    return words if len(words := decode(token, model).split()) > 1 else []


def _features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(f"{k}{word[:k]}" for k in (4, 5, 6, 7) if len(word) >= k)]


def tokens(text: str) -> Counter:
    """Counts of tokens; what is spelled out with gaps counts as one more token, and again with a blank at each gap, for its words."""
    out = Counter(text.split())
    for m in SPELLED.finditer(text):
        out[re.sub(r"[ \t._\-]", "", m[0])] += 1
        out[" ".join(m[0][::2])] += 1
    return out


class Bags:
    """Texts as bags of numbered words, and words as sets of numbered features, in arrays. Features that no toxic text has aren't kept."""

    def __init__(self, texts: list[str], toxic: list[int], chars: CharModel) -> None:
        number: dict[str, int] = {}
        of: dict[str, list[int]] = {}
        doc, word, n = array("i"), array("i"), array("q")
        for i, text in enumerate(texts):
            mine: dict[int, int] = {}
            for t, k in tokens(text).items():
                if (ids := of.get(t)) is None:
                    ids = of[t] = [number.setdefault(w, len(number)) for w in restored(t, chars)]
                for w in ids:
                    mine[w] = mine.get(w, 0) + k
            doc.extend([i] * len(mine))
            word.extend(mine)
            n.extend(mine.values())
        of.clear()
        self.doc, self.word, self.n, self.texts = np.array(doc, np.int32), np.array(word, np.int32), np.array(n, np.int64), len(texts)
        self.cut = np.searchsorted(self.doc, np.arange(self.texts + 1))
        hot = np.zeros(len(number), bool)
        hot[self.word[np.array(toxic, bool)[self.doc]]] = True
        feature: dict[str, int] = {"": 0}
        for w, h in zip(number, hot.tolist(), strict=True):
            if h:
                for f in _features(w):
                    feature.setdefault(f, len(feature))
        ids, size = array("i"), array("i")
        for w in number:
            fs = [feature[f] for f in _features(w) if f in feature] or [0]
            ids.extend(fs)
            size.append(len(fs))
        self.features, self.ids, self.size = list(feature), np.array(ids, np.int32), np.array(size, np.int64)
        self.at = np.cumsum(self.size) - self.size

    def weights(self, y: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Log ratios of the rates of features in the toxic and clean texts of use, where they are large and seen in several toxic texts; else 0."""
        owner = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        count, total = [], []
        for t in (0, 1):
            mine = use[self.doc] & (y[self.doc] == t)
            of_word = np.bincount(self.word[mine], self.n[mine], len(self.size))
            count.append(np.bincount(self.ids, of_word[owner], len(self.features)))
            total.append(1 + self.n[mine].sum())
        texts = np.zeros(len(self.features), np.int32)
        for i in np.flatnonzero(use & (y == 1)).tolist():
            word = self.word[self.cut[i] : self.cut[i + 1]]
            size = self.size[word]
            place = np.repeat(self.at[word] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            texts[np.unique(self.ids[place])] += 1
        x = np.log((count[1] + 0.5) / total[1]) - np.log((count[0] + 1.5) / total[0])
        return np.where((texts >= 3) & (count[1] > 0) & (x > 1.5), x, 0.0)

    def dense(self, weights: np.ndarray) -> np.ndarray:
        """What the regression sees of each text."""
        best = np.maximum.reduceat(weights[self.ids], self.at) if len(self.at) else np.zeros(0)
        out = np.zeros((self.texts, 7))
        for i, (a, b) in enumerate(zip(self.cut[:-1].tolist(), self.cut[1:].tolist(), strict=True)):
            u, n = best[self.word[a:b]], self.n[a:b]
            out[i] = _dense(list(zip(u[u > 0].tolist(), n[u > 0].tolist(), strict=True)), int(n.sum()))
        return out


def _word(word: str, lex: dict[str, float]) -> float:
    return max([lex[f] for f in _features(word) if f in lex], default=0.0)


def _dense(scored: list[tuple[float, int]], n: int) -> list[float]:
    """What the regression sees: how much of the text is in the lexicon, and the strongest words of it."""
    n = max(n, 1)
    top = sorted((u for u, _ in scored), reverse=True)[:3]
    top += [0.0] * (3 - len(top))
    mean, high = sum(u * c for u, c in scored) / n, sum(c for u, c in scored if u > 3) / n
    return [1.0, math.log(mean + 0.005), math.log(high + 0.002), *top, math.log(n + 10) / 5]


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights by Newton steps, halved until the penalised loss falls; columns but the first are scaled for the penalty."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[0], scale[0] = 0.0, 1.0
    z = (x - mean) / scale
    pen = np.full(x.shape[1], ridge)
    pen[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float(np.logaddexp(0, m).sum() - (y * m).sum() + 0.5 * (pen * w * w).sum())

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pen)
        step = np.linalg.solve(h, z.T @ (y - p) - pen * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w += size * step
        if np.abs(size * step).max() < 1e-6:
            break
    out = w / scale
    out[0] = w[0] - (w[1:] * mean[1:] / scale[1:]).sum()
    return out


def fit(texts: list[str], toxic: list[int], chars: CharModel, odds: float | None = None) -> dict:
    """odds: toxic to clean rows where the texts come from; none: as in the texts. With the character model, the lexicon and the regression on what it finds; for the latter each half of the texts is seen by the other half's lexicon."""
    bags, y = Bags(texts, toxic, chars), np.array(toxic, np.int64)
    half = np.arange(len(texts)) % 2
    x = np.zeros((len(texts), 7))
    for h in (0, 1):
        x[half == h] = bags.dense(bags.weights(y, half != h))[half == h]
    w = _regress(x, y.astype(float))
    if odds is not None:
        w[0] += math.log(odds * (y == 0).sum() / (y == 1).sum())
    lexicon = bags.weights(y, half >= 0)
    return {"chars": chars, "lexicon": {bags.features[i]: float(lexicon[i]) for i in np.flatnonzero(lexicon).tolist()}, "weights": w.tolist()}


class Scorer:
    """Scores texts; keeps what it has worked out for tokens that it has met."""

    #: How many tokens are kept, and how long they may be.
    KEEP, LONG = 400_000, 64

    def __init__(self, model: dict) -> None:
        self.m = model
        self.of: dict[str, tuple[int, list[float]]] = {}

    def _token(self, t: str) -> tuple[int, list[float]]:
        """How many words there are, and what the lexicon finds among them."""
        words = restored(t, self.m["chars"])
        u = max(len(words), " " not in t), [x for w in words if (x := _word(w, self.m["lexicon"]))]
        if len(t) <= self.LONG:
            self.of[t] = u
        return u

    def text(self, text: str | None) -> float:
        if not self.m["chars"]:
            return 0.0
        get, new = self.of.get, self._token
        found, n = [], 0
        for t, c in tokens(text or "").items():
            if (u := get(t)) is None:
                u = new(t)
            n += c * u[0]
            for x in u[1]:
                found.append((x, c))
        if len(self.of) > self.KEEP:
            self.of.clear()
        z = sum(a * b for a, b in zip(_dense(found, n), self.m["weights"], strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _score(sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Scorer(sent.value)
        for batch in batches:
            s = [by.text(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), batch.column("held_out"), pa.array(s, pa.float64())], names=["doc_id", "th", "held_out", "score"])

    return score


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", rows: tuple[int, int] = (TRAIN_TOXIC, TRAIN_CLEAN)) -> dict:
    known = (
        labels.select(F.col(doc_id).cast("long").alias("i"), F.col(toxic).cast("int").alias("y")).filter(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i")))
        .groupBy("i").agg(F.max("y").alias("y"))
    )
    # both samples have a proven size, so they can be broadcast
    pick = lambda y: known.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(rows[y == 0])
    picked = pick(1).union(pick(0))
    d = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    got = d.join(F.broadcast(picked), "i").groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y")).orderBy("i").toPandas()
    if got["y"].nunique() < 2:
        return {"chars": None}
    texts, toxic_of = got["t"].tolist(), got["y"].tolist()
    del got
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return fit(texts, toxic_of, CharModel(*char_counts(docs, text)), n[1] / n[0])


def score_toxicity(docs: DataFrame, model: dict, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, th (xxhash64 of the text), held_out, score and predicted of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_score(sent), "doc_id long, th long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _clean(sent, text: str, threshold: float):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([by.text(t.as_py()) < threshold for t in batch.column(text)], pa.bool_()))

    return clean


def keep_clean(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    return docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(model), text, threshold), docs.schema)


def op9_toxicity_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels"))).drop("th")
