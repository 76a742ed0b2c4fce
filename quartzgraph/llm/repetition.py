"""Repetition inside a text, by suffix arrays over its words.

A suffix array (prefix doubling, many texts at once, each ending in a mark of its own) gives the longest common
prefix of neighbouring suffixes. The maximal repeated substrings are its intervals; the union of the spans of
those of at least MIN_REPEAT words is the union over all places i of [i, i + m), where m is the larger
common prefix of i with its two neighbours. A text fails if these spans cover more than MAX_COVERED percent
of the characters in its words, or if the longest repeat has more than MAX_REPEAT words.

Defined cases: null and wordless texts have zeros and fail by the base rule (under 50 words); repeated rows are
judged alike; doc_id may be null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_runs, words_of

MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 10, 30, 100
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def longest_repeats(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place the length of the longest run of ids from there on that also begins elsewhere in the same text. first: where texts begin, and the end."""
    n = len(ids)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][text]
    # rank by (text, word): a prefix never reaches past its text, as places beyond it count as a rank that no other place has
    order = np.lexsort((ids, text))
    step = np.ones(n, bool)
    step[1:] = (ids[order][1:] != ids[order][:-1]) | (text[order][1:] != text[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(step) - 1
    levels, width = [rank], 1
    open_ = np.flatnonzero(np.bincount(rank)[rank] > 1)
    while len(open_):
        last = levels[-1]
        # what isn't open has a rank of its own and keeps it; an open place gets the rank of its class split by the class that follows
        ahead = open_ + width
        nxt = np.where(ahead < end[open_], last[np.minimum(ahead, n - 1)], -1 - open_)
        o = np.lexsort((nxt, last[open_]))
        a, b = last[open_][o], nxt[o]
        split = np.ones(len(o), bool)
        split[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        # ranks stay in order within the class: its lowest rank plus the place of the sub-class in it
        begin = np.ones(len(o), bool)
        begin[1:] = a[1:] != a[:-1]
        at = np.arange(len(o))
        fresh = a + np.maximum.accumulate(np.where(split, at, 0)) - np.maximum.accumulate(np.where(begin, at, 0))
        rank = last.copy()
        if width == 1 and len(levels) == 1:
            # first ranks are dense: spread them so that a class of size k takes k ranks
            sizes = np.bincount(last)
            lowest = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            rank = lowest[last]
            fresh = fresh - a + lowest[a]
            levels[0] = lowest[last]
        rank[open_[o]] = fresh
        levels.append(rank)
        width *= 2
        count = np.bincount(rank, minlength=n)
        open_ = open_[count[rank[open_]] > 1]
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1], order[1:]
    lcp = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + lcp, b + lcp
        inside = (i < end[a]) & (j < end[b])
        same = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        lcp += np.where(same, 1 << k, 0)
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def covered(length: np.ndarray, least: int, cap: int | None = None) -> np.ndarray:
    """Whether a place lies in a span [i, i + length[i]) with length[i] >= least; spans are cut to cap."""
    n = len(length)
    on = length >= least
    reach = np.where(on, np.arange(n) + (np.minimum(length, cap) if cap else length), 0)
    return np.maximum.accumulate(reach) > np.arange(n) if n else np.zeros(0, bool)


def _judge(min_repeat: int, max_covered: int, max_repeat: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            texts = batch.column("text")
            for i, j, data, off in text_runs(texts):
                h, starts, ends, first = words_of(data, off, False)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                sizes = chars[ends] - chars[starts]
                _, ids = np.unique(h, return_inverse=True)
                reps = longest_repeats(ids, first)
                in3, inm = covered(reps, 3, 3), covered(reps, min_repeat)
                total = lambda x, at=first: (c := np.concatenate([[0], np.cumsum(x)]))[at[1:]] - c[at[:-1]]
                cols[0] += np.diff(first).tolist()
                cols[1] += total(sizes).tolist()
                cols[2] += total(_SYMBOL[data], off).tolist()
                cols[3] += [_same_lines(t) for t in texts.slice(i, j - i).to_pylist()]
                cols[4] += total(in3).tolist()
                cols[5] += total(np.where(inm, sizes, 0)).tolist()
                full = np.concatenate([reps, [0]])
                longest = np.maximum.reduceat(full, np.minimum(first[:-1], len(reps)))
                cols[6] += np.where(np.diff(first) > 0, longest, 0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]], names=_NAMES)

    return judge


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat"]


def _same_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def repetition(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_repeat: int = MIN_REPEAT, max_covered: int = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The counts of every row of docs, base_failed, repeat_failed and kept."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(_judge(min_repeat, max_covered, max_repeat), ", ".join(f"{n} long" for n in _NAMES))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    bad = (100 * F.col("repeat_chars") > max_covered * F.col("word_chars")) | (F.col("longest_repeat") > max_repeat)
    return out.withColumn("base_failed", base).withColumn("repeat_failed", bad).withColumn("kept", ~base & ~bad)


def op6_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents")).drop("longest_repeat")


SQL_OP6 = r"""
with d as (select doc_id, row_number() over () rid, coalesce(text, '') t from documents),
w as (select doc_id, rid, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w from d),
p as (select rid, w, unnest(range(1, len(w) + 1)) i from w),
rep(k) as (values (3), (10), (101)),
g as (select rid, k, i, array_to_string(w[i:i+k-1], ' ') g from p, rep where i + k - 1 <= len(w)),
tw as (select rid, k, i from g qualify count(*) over (partition by rid, k, g) > 1),
cov as (select distinct rid, k, unnest(range(i, i + k)) i from tw),
sums as (select c.rid, count(*) filter (k = 3) r3, sum(len(p.w[p.i])) filter (k = 10) c10, count(*) filter (k = 101) > 0 too_long from cov c join p on p.rid = c.rid and p.i = c.i group by c.rid),
ln as (select rid, count(*) n, count(distinct x) u from (select rid, unnest(string_split(t, chr(10))) x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by rid),
f as (
  select doc_id, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::bigint word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(ln.n - ln.u, 0)::bigint n_dup_lines, coalesce(r3, 0)::bigint n_repeat_words,
    coalesce(c10, 0)::bigint repeat_chars, coalesce(too_long, false) too_long
  from w left join sums using (rid) left join ln using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_chars,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, 100 * repeat_chars > 30 * word_chars or too_long repeat_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (100 * repeat_chars > 30 * word_chars or too_long) kept
from f
"""
