"""Shared pieces: tables, folds, and hashing of words in Arrow text buffers."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import remove, scratch_dir, written  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Salt buckets of crc32(doc_id) that are never learned from.
HOLD_OUT_MOD = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id):
    """True where crc32 of doc_id as text leaves 0 modulo 5; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % HOLD_OUT_MOD == 0


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


# --- words of Arrow text buffers, vectorised -------------------------------------------------

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_PINV = _U(pow(int(_P), -1, 1 << 64))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Texts are worked on in runs of about so many bytes, so that memory doesn't follow the batch.
RUN_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, base in enumerate((_P, _PINV)):
            a = np.full(max(n, RUN_BYTES + (RUN_BYTES >> 2)), base, np.uint64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow[0][:n], _pow[1][:n]


def text_runs(texts: pa.Array):
    """(first row, row after the last, bytes, byte offsets of the rows) of runs of whole texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + RUN_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words_of(data: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of the rows: their 64-bit hashes, byte starts and ends, and per row the index of its first word (one more at the end)."""
    n = len(data)
    black = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = black[:-1]
    starts = np.flatnonzero(black & (~before | edge[:-1]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = black[1:]
    ends = np.flatnonzero(black & (~after | edge[1:])) + 1
    p, inv = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * p[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
    return h, starts, ends, np.searchsorted(starts, off)


_W = [_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3)]


def shingle_sets(texts: pa.Array, k: int = 4):
    """For each row the sorted distinct hashes of its lower-cased k-word shingles (fewer words: the whole sequence as one; none: empty)."""
    for _i, _j, data, off in text_runs(texts):
        h, _s, _e, first = words_of(data, off, True)
        if len(h) >= k:
            m = len(h) - k + 1
            s = h[:m] * _W[0]
            for t in range(1, k):
                s = mix(s) + h[t : t + m] * _W[t % 4] + _U(t)
            s = mix(s)
        else:
            s = np.zeros(0, np.uint64)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                x = np.zeros(1, np.uint64)
                for t in range(a, b):
                    x = mix(x + h[t : t + 1] * _W[(t - a) % 4] + _U(7 + t - a))
                yield x
            else:
                yield np.zeros(0, np.uint64)


#: Bytes of a batch between JVM and Python, about: both hold several at once in each task, and a count of rows doesn't bound them where texts are long.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session; needed where they don't have it installed. Bounds the batches by BATCH_BYTES, where the application's settings name no bound."""
    import os
    import zipfile

    sc = spark.sparkContext
    if not sc.getConf().contains(bound := "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set(bound, str(BATCH_BYTES))
    if getattr(sc, "_quartz_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(tempfile.mkdtemp(prefix="quartz-code-"), "quartzgraph_code.zip")
    with zipfile.ZipFile(at, "w") as z:
        for d, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.join("quartzgraph", os.path.relpath(p, root)))
    sc.addPyFile(at)
    sc._quartz_shipped = True
