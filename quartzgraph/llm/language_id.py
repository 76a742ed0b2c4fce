"""Language of words in code-switched text, by a linear-chain conditional random field.

Words are runs of letters. Features of a word: itself (the lexicon), its affixes and its trigrams (in UTF-8), hashed
into 2**BITS rows of weights; transitions are learned with them. Training sequences are made by joining runs of words from texts of different languages, so that switches are seen. The gradient is that of the
conditional likelihood (forward-backward expectations). Inference labels each word by forward-backward over the whole text: stretches of STRETCH words are worked on side by
side, after the product of each one's steps has carried what stands before and behind it to its borders, so the posteriors are those of the undivided chain. A text's
language has the largest sum of word posteriors; score is the mean posterior of that language.

The model is fitted on the driver on at most TRAIN_ROWS rows: those with the least hashes of doc_id among
the rows that have text and language and aren't held out. All texts are labelled whole.

Defined cases: null text, or text without a letter, is `und` with score 0; without any training row every text
is; repeated rows get equal results; doc_id may be null (it counts as ''); extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

TRAIN_ROWS, BITS, STRETCH = 2000, 18, 256
#: Words that training sees at least; smaller samples are gone through several times, at most PASSES.
TRAIN_WORDS, PASSES = 100_000, 20
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def features(word: str) -> list[int]:
    """Slots of the word, its affixes and its trigrams; the checksum's start value tells the kinds apart."""
    b, crc, mask = f"<{word}>".encode(), zlib.crc32, (1 << BITS) - 1
    n = len(b)
    out = [crc(b) & mask]
    for k in range(2, min(n, 6)):
        out += (crc(b[:k], 1) & mask, crc(b[n - k :], 2) & mask)
    out += [crc(b[i : i + 3], 3) & mask for i in range(n - 2)]
    return out


def posteriors(emit: np.ndarray, trans: np.ndarray, length: np.ndarray, pairs: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None):
    """Posteriors of rows of words: emit (rows, places, labels), trans (labels, labels), length of each row; and the summed pair posteriors.
    before, after (rows, labels): what the words before and behind a row say about its first and its last word; none: nothing."""
    rows, places, k = emit.shape
    t = np.exp(trans)
    e = np.exp(emit - emit.max(-1, keepdims=True))
    on = (np.arange(places)[None, :] < length[:, None])[..., None]
    e = np.where(on, e, 1.0)
    ahead = np.empty((places, rows, k))
    a = e[:, 0] if before is None else e[:, 0] * before
    a = a / a.sum(-1, keepdims=True)
    ahead[0] = a
    for i in range(1, places):
        b = (a @ t) * e[:, i]
        b /= b.sum(-1, keepdims=True)
        a = np.where(on[:, i], b, a)
        ahead[i] = a
    back = np.ones((rows, k)) / k if after is None else after
    post = np.empty((places, rows, k))
    expected = np.zeros((k, k))
    for i in range(places - 1, -1, -1):
        p = ahead[i] * back
        post[i] = p / p.sum(-1, keepdims=True)
        if i:
            right = e[:, i] * back
            if pairs:
                live = on[:, i, 0]
                x = ahead[i - 1][live][:, :, None] * t[None] * right[live][:, None, :]
                expected += (x / x.sum((1, 2), keepdims=True)).sum(0)
            b = right @ t.T
            b /= b.sum(-1, keepdims=True)
            back = np.where(on[:, i], b, back)
    post = post.transpose(1, 0, 2)
    return (post, expected) if pairs else post


def products(emit: np.ndarray, trans: np.ndarray, length: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The product of the steps of each row, up to a factor: (rows, labels of the word before it, labels of its last word). starts: rows with no word before them."""
    rows, places, k = emit.shape
    t = np.exp(trans)
    e = np.exp(emit - emit.max(-1, keepdims=True))
    m = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for i in range(places):
        on = i < length
        b = m[on] @ t if i else np.where(starts[on, None, None], m[on], m[on] @ t)
        b = b * e[on, i][:, None, :]
        m[on] = b / b.sum((1, 2), keepdims=True)
    return m


def fit(texts: list[str], langs: list[str], seed: int = 8, places: int = 48, batch: int = 48, rate: float = 0.2) -> dict:
    """Weights of the chain from texts of one language each."""
    labels = sorted(set(langs))
    k, rng = len(labels), np.random.default_rng(seed)
    weights, trans = np.zeros((1 << BITS, k)), np.zeros((k, k))
    gw, gt = np.full((1 << BITS, k), 1e-6), np.full((k, k), 1e-6)
    known: dict[str, list[int]] = {}
    runs = []
    for t, lang in zip(texts, langs, strict=True):
        ws = [w.lower() for w in WORD.findall(t)]
        i = 0
        while i < len(ws):
            n = int(rng.integers(3, 30))
            runs.append((ws[i : i + n], labels.index(lang)))
            i += n
    n_words = sum(len(r) for r, _ in runs)
    for _ in range(min(PASSES, max(1, -(-TRAIN_WORDS // max(1, n_words))))):
        rng.shuffle(runs)
        words = [w for r, _ in runs for w in r]
        gold = np.array([y for r, y in runs for _ in r], np.int64)
        for lo in range(0, len(words), batch * places):
            part = words[lo : lo + batch * places]
            m = -(-len(part) // places)
            size = np.full(m, places)
            size[-1] = len(part) - (m - 1) * places
            y = np.zeros((m, places), np.int64)
            y.ravel()[: len(part)] = gold[lo : lo + len(part)]
            feats = [known.get(w) or known.setdefault(w, features(w)) for w in part]
            flat = np.concatenate([np.asarray(f) for f in feats])
            at = np.concatenate([[0], np.cumsum([len(f) for f in feats])[:-1]])
            emit = np.zeros((m * places, k))
            emit[: len(part)] = np.add.reduceat(weights[flat], at)
            post, pair = posteriors(emit.reshape(m, places, k), trans, size, pairs=True)
            diff = (np.eye(k)[y] - post).reshape(-1, k)[: len(part)]
            seen = np.zeros((k, k))
            inner = (np.arange(1, places)[None, :] < size[:, None]).ravel()
            np.add.at(seen, (y[:, :-1].ravel()[inner], y[:, 1:].ravel()[inner]), 1)
            each = np.repeat(diff, np.diff(np.append(at, len(flat))), axis=0)
            keys, inv = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(inv, each[:, c], len(keys)) for c in range(k)], 1) - 1e-4 * weights[keys]
            gw[keys] += g * g
            weights[keys] += rate * g / np.sqrt(gw[keys])
            g = (seen - pair) / m
            gt += g * g
            trans += rate * g / np.sqrt(gt)
    return {"labels": labels, "weights": weights.astype(np.float32), "trans": trans}


class Labeller:
    """Labels texts with a fitted chain; keeps the emissions of words that it has met."""

    KEEP = 400_000

    def __init__(self, model: dict) -> None:
        self.m, self.k = model, len(model["labels"])
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.emit = np.zeros((1024, self.k), np.float32)

    def _learn(self, words: list[str]) -> None:
        """Works out the emissions of new words."""
        n = len(self.at)
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            feats = [features(w.lower()) for w in part]
            sizes = np.array([len(f) for f in feats])
            flat = np.fromiter((x for f in feats for x in f), np.int64, int(sizes.sum()))
            rows = np.add.reduceat(self.m["weights"][flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            while n + len(part) > len(self.emit):
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
            self.emit[n : n + len(part)] = rows
            self.at.update(zip(part, range(n, n + len(part)), strict=True))
            n += len(part)

    def word_posteriors(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of all words one after another, and where each text begins."""
        first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        self._learn(list({w for ws in words for w in ws if w not in self.at}))
        at = self.at
        ids = np.fromiter((at[w] for ws in words for w in ws), np.int64, int(first[-1]))
        emit = self.emit[ids]
        out = np.zeros((len(ids), self.k), np.float32)
        sizes = np.diff(first)
        count = -(-sizes // STRETCH)  # stretches of each text
        f = np.cumsum(count) - count
        nth = np.arange(int(count.sum())) - np.repeat(f, count)
        begin = np.repeat(first[:-1], count) + nth * STRETCH
        length = np.minimum(np.repeat(first[1:], count) - begin, STRETCH)
        t = np.exp(self.m["trans"])

        def words_at(r: np.ndarray) -> np.ndarray:
            return begin[r][:, None] + np.arange(length[r].max())[None, :]

        def emissions(r: np.ndarray) -> np.ndarray:
            return emit[np.minimum(words_at(r), len(ids) - 1)].astype(np.float64)

        def runs(r: np.ndarray) -> Iterator[np.ndarray]:
            r = r[np.argsort(length[r], kind="stable")]
            for lo in range(0, len(r), 512):
                yield r[lo : lo + 512]

        before, after = np.ones((len(begin), self.k)), np.ones((len(begin), self.k)) / self.k
        long_ = np.flatnonzero(count > 1)
        if len(long_):
            step = np.empty((len(begin), self.k, self.k))
            for r in runs(np.flatnonzero(np.repeat(count > 1, count))):
                step[r] = products(emissions(r), self.m["trans"], length[r], nth[r] == 0)
            most = int(count.max())
            ahead = np.empty_like(before)
            ahead[f[long_]] = step[f[long_]].sum(1)
            ahead[f[long_]] /= ahead[f[long_]].sum(-1, keepdims=True)
            for j in range(1, most):
                r = f[long_[count[long_] > j]] + j
                before[r] = ahead[r - 1] @ t
                a = np.einsum("rk,rkl->rl", ahead[r - 1], step[r])
                ahead[r] = a / a.sum(-1, keepdims=True)
            for j in range(most - 1, 0, -1):
                r = f[long_[count[long_] > j]] + j
                b = np.einsum("rkl,rl->rk", step[r], after[r])
                after[r - 1] = b / b.sum(-1, keepdims=True)
        for r in runs(np.arange(len(begin))):
            at = words_at(r)
            mine = np.arange(at.shape[1])[None, :] < length[r][:, None]
            out[at[mine]] = posteriors(emissions(r), self.m["trans"], length[r], before=before[r], after=after[r])[mine]
        if len(self.at) > self.KEEP:
            self.clear()
        return out, first

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [WORD.findall(t) if t else [] for t in texts]
        words = [w if any(c.isalpha() for x in w for c in x) else [] for w in words]
        if not self.k:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        post, first = self.word_posteriors(words)
        sums = np.concatenate([np.zeros((1, self.k)), np.cumsum(post, 0, dtype=np.float64)])
        sums = sums[first[1:]] - sums[first[:-1]]
        best = sums.argmax(1)
        n = np.diff(first)
        score = np.clip(sums[np.arange(len(n)), best] / np.maximum(n, 1), 0, 1)
        return [self.m["labels"][b] if c else UNKNOWN for b, c in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, score, 0.0).tolist()


def _label(sent, chars: int = 1 << 20):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Labeller(sent.value)
        for batch in batches:
            langs, scores, part, size = [], [], [], 0
            for t in batch.column("text"):
                part.append(t.as_py())
                size += len(part[-1] or "")
                if size > chars:
                    a, b = by.texts(part)
                    langs, scores, part, size = langs + a, scores + b, [], 0
            if part:
                a, b = by.texts(part)
                langs, scores = langs + a, scores + b
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return label


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> dict:
    d = docs.select(F.col(doc_id).cast("string").alias("i"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).filter(~held_out(F.col("i")) & F.col("t").isNotNull() & F.col("l").isNotNull())
    d = d.withColumns({"i": F.coalesce("i", F.lit("")), "th": F.xxhash64("t")})
    # keys are chosen first, so that tasks send no texts but those of the sample; it has a proven size and can be broadcast
    keys = d.select("i", "th").orderBy(F.xxhash64("i"), "i", "th").limit(rows).distinct()
    got = d.join(F.broadcast(keys), ["i", "th"]).dropDuplicates(["i", "th"]).select("i", "th", "t", "l").toPandas().sort_values(["i", "th", "l"])
    return fit(got["t"].tolist(), got["l"].tolist())


def identify(docs: DataFrame, model: dict, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_label(sent), "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
