"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

A signature of 16-bit minimum hashes is sorted in TREES orders; each order starts with hashes of its own, so that two sets
with similarity s share a first prefix of LEAST_DEPTH hashes, a region, with s**LEAST_DEPTH. In an order, a row's candidates are its
neighbours of longest common prefix (at least LEAST_DEPTH deep) and the heads of its regions at two depths. Where a region is dense, the
neighbours agree to a greater depth: the depth adapts without a bucket that has to be capped. The orders are cut by range; what
stands at a cut is paired across it, so the cuts lose no neighbour. Candidates are linear in the rows.

Links are confirmed on the full sets: first each text's likeliest partner; then, ROUNDS times, in regions that still hold several
components, each row's nearest rows of another component. What regions still hold several components then are joined
exactly: a row that shares a region, and LIKE hashes, with a row of another component puts the shingles of its set in the order of
their rarity; sets that are similar enough share a shingle within their first ones, at places that leave room for the overlap needed. Such
pairs of different components are confirmed too. Shingles that occur in one component only come first and never pair, so near copies
around one text meet only where their own changes are alike. A pair of similarity s shares a region with probability
1 - (1 - s**3)**TREES: at 0.8, all but 3e-7 of the pairs, and all but 5e-8 have LIKE hashes alike. Equal sets are merged beforehand.

Defined cases: null or wordless text has no shingles and is its own component; repeated rows are
copies; a null doc_id gets the component of its text and kept = false; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, remove, shingle_sets, table, written
from .components import components

TREES, LEAST_DEPTH, DEPTH, REACH = 21, 3, 8, 1
K = TREES * LEAST_DEPTH
_U = np.uint64
_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 1 << 63, K, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 62, K, dtype=np.uint64) * _U(2) + _U(1)
#: Tree t reads its own three hashes first, then those of the trees after it.
ORDERS = (np.arange(TREES)[:, None] * LEAST_DEPTH + np.arange(DEPTH)[None, :]) % K
#: Members of a hub that one streak of rows compares.
STREAK = 128
#: Rounds of nearest rows of other components.
ROUNDS = 2
#: Equal hashes of two signatures below which no pair is looked for: at similarity 0.8, 5e-8 of the pairs have fewer.
LIKE = 32
#: Signatures are compared only in regions of at most so many rows; rows of larger ones all go on to the exact join.
REGION = 2048


def _signed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n x 2) and signatures (n x K) of sets that aren't empty."""
    flat = np.concatenate(parts)
    at = np.zeros(len(parts), np.int64)
    np.cumsum([len(p) for p in parts[:-1]], out=at[1:])
    low = np.empty((len(parts), K), np.uint16)
    for k in range(K):
        low[:, k] = (np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], at) >> _U(8)).astype(np.uint16)
    return np.stack([np.add.reduceat(mix(flat ^ _U(11)), at), np.add.reduceat(mix(flat ^ _U(29)), at)], 1), low


def _sign(batches: Iterator[pa.RecordBatch], texts: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = batch.column("text")
        n, fp, sig = [], [], []

        def flush(parts: list[np.ndarray], fp: list = fp, sig: list = sig) -> None:
            full = [p for p in parts if len(p)]
            f, s = _signed(full) if full else (None, None)
            k = 0
            for p in parts:
                fp.append(f[k].tobytes() if len(p) else None)
                sig.append(s[k].astype(">u2").tobytes() if len(p) else None)
                k += len(p) > 0

        parts: list[np.ndarray] = []
        for s in shingle_sets(col):
            n.append(len(s))
            parts.append(s)
            if len(parts) == texts:
                flush(parts)
                parts = []
        flush(parts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())],
            names=["doc_id", "th", "n_shingles", "fp", "sig"],
        )


def signed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, th, n_shingles, fp, sig) of every row; th: hash of the text."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text")).mapInArrow(
        _sign, "doc_id long, th long, n_shingles long, fp binary, sig binary"
    )


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each signature once per tree: (tree, key, fp)."""
    for batch in batches:
        n = batch.num_rows
        for i in range(0, n, 2048):
            b = batch.slice(i, 2048)
            m = b.num_rows
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(m, K, 2)
            keys = sig[:, ORDERS].reshape(m * TREES, DEPTH * 2)
            fps = np.repeat(np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(m, 16), TREES, axis=0)
            fixed = lambda a: pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(np.ascontiguousarray(a).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), m)), fixed(keys), fixed(fps)], names=["tree", "key", "fp"])


def _fixed(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _prefixes(batch: pa.RecordBatch) -> np.ndarray:
    """Tree and hashes of sorted rows, one row each."""
    key = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u2").reshape(batch.num_rows, DEPTH)
    return np.concatenate([batch.column("tree").to_numpy()[:, None].astype(np.int64), key.astype(np.int64)], 1)


MET = "a binary, b binary, tree int, key binary"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tree and key -> candidate pairs (a, b): the REACH rows before, and the heads of the regions LEAST_DEPTH and twice as
    deep. Rows without b are those that stand at the ends: the first and last REACH rows and the heads of the last regions."""
    tail = None
    heads = [None, None]
    first: list[tuple[bytes, int, bytes]] = []
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        full = _prefixes(batch)
        fp = np.array(batch.column("fp").to_pylist(), dtype=object)
        if len(first) < REACH:
            some = batch.slice(0, REACH - len(first))
            first += zip(some.column("fp").to_pylist(), some.column("tree").to_pylist(), some.column("key").to_pylist(), strict=True)
        if tail is not None:
            full, fp = np.concatenate([tail[0], full]), np.concatenate([tail[1], fp])
        new = len(fp) - m
        left, right = [], []
        for d in range(1, REACH + 1):
            if len(fp) > d:
                same = (full[d:, : LEAST_DEPTH + 1] == full[:-d, : LEAST_DEPTH + 1]).all(1)
                same[: max(0, new - d)] = False
                i = np.flatnonzero(same)
                left.append(fp[i])
                right.append(fp[i + d])
        for h, depth in enumerate((LEAST_DEPTH, 2 * LEAST_DEPTH)):
            begins = np.ones(len(fp), bool)
            begins[1:] = (full[1:, : depth + 1] != full[:-1, : depth + 1]).any(1)
            head = np.maximum.accumulate(np.where(begins, np.arange(len(fp)), 0))
            goes_on = heads[h] is not None and (heads[h][0][: depth + 1] == full[0, : depth + 1]).all()
            heads_fp = np.where(head == 0, np.array([heads[h][1]], dtype=object), fp[head]) if goes_on else fp[head]
            i = np.flatnonzero((np.arange(len(fp)) - head > REACH) | ((head == 0) & goes_on))
            i = i[i >= new]
            left.append(heads_fp[i])
            right.append(fp[i])
            if not (goes_on and head[-1] == 0):
                heads[h] = (full[head[-1]].copy(), fp[head[-1]])
        tail = full[-REACH:], fp[-REACH:]
        a, b = np.concatenate(left), np.concatenate(right)
        ok = a != b
        a, b = a[ok].tolist(), b[ok].tolist()
        if a:
            low, high = zip(*((x, y) if x < y else (y, x) for x, y in zip(a, b, strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([_fixed(low), _fixed(high), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())], names=["a", "b", "tree", "key"])
    if tail is not None:
        ends = {*first, *((f, int(k[0]), k[1:].astype(">u2").tobytes()) for k, f in [*zip(*tail, strict=True), *heads])}
        f, t, k = zip(*ends, strict=True)
        yield pa.RecordBatch.from_arrays([_fixed(f), pa.nulls(len(f), pa.binary()), pa.array(t, pa.int32()), _fixed(k)], names=["a", "b", "tree", "key"])


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def orders(reps: DataFrame) -> DataFrame:
    return reps.select("fp", "sig").mapInArrow(_orders, "tree int, key binary, fp binary")


def candidates(reps: DataFrame) -> DataFrame:
    """Pairs (a, b, c) of fingerprints; c: in how many places of the forest they met."""
    dealt = orders(reps).repartitionByRange(_partitions(reps), "tree", "key", "fp").sortWithinPartitions("tree", "key", "fp")
    met = written(dealt.mapInArrow(_near, MET), "near-met")
    # a few rows of each partition, put in order, meet across the cuts
    cut = met.filter(F.col("b").isNull()).select("tree", "key", F.col("a").alias("fp")).distinct().repartition(1).sortWithinPartitions("tree", "key", "fp")
    both = met.filter(F.col("b").isNotNull()).select("a", "b").union(cut.mapInArrow(_near, MET).filter(F.col("b").isNotNull()).select("a", "b"))
    pairs = written(both.groupBy("a", "b").agg(F.count("*").alias("c")), "near-pairs")
    remove(met)
    return pairs


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [z.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(texts, pa.binary())], names=["fp", "z"])


def _confirm(least: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        group, hub, hub_fp = None, None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = pa.array([z.decompress(t).decode() for t in part.column("z").to_pylist()], pa.large_string())
                a, b = [], []
                for g, s, first, fp, own in zip(part.column("hub").to_pylist(), part.column("streak").to_pylist(), part.column("member").to_pylist(), part.column("fp").to_pylist(), shingle_sets(texts), strict=True):
                    if first == 0:
                        group, hub, hub_fp = (g, s), own, fp
                    elif group == (g, s):
                        both = len(np.intersect1d(hub, own, assume_unique=True))
                        if 100 * both >= least * (len(hub) + len(own) - both):
                            a.append(hub_fp)
                            b.append(fp)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return confirm


def confirmed(pairs: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= least * union.

    Pairs are gathered by their hub, the end with more pairs, in streaks of about STREAK members, and each
    streak gets the hub's text once: texts move in proportion to the pairs, and a hub isn't one task.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("d"))
    led = (
        pairs.select("a", "b").join(ends.select(F.col("fp").alias("a"), F.col("d").alias("da")), "a")
        .join(ends.select(F.col("fp").alias("b"), F.col("d").alias("db")), "b")
    )
    a_leads = F.col("da") >= F.col("db")
    led = led.select(F.when(a_leads, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(a_leads, F.col("b")).otherwise(F.col("a")).alias("fp"), F.greatest("da", "db").alias("d"))
    led = led.select("hub", "fp", F.pmod(F.xxhash64("fp"), F.greatest(F.lit(1), F.floor(F.col("d") / STREAK))).alias("streak"))
    wanted = led.select("hub", "streak", "fp", F.lit(1).alias("member")).union(
        led.select("hub", "streak").distinct().select("hub", "streak", F.col("hub").alias("fp"), F.lit(0).alias("member"))
    )
    rows = wanted.join(texts, "fp").select("hub", "streak", "member", "fp", "z")
    return rows.repartition(_partitions(pairs), "hub", "streak").sortWithinPartitions("hub", "streak", "member", "fp").mapInArrow(_confirm(least), "a binary, b binary")


def _several(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (tree, key, fp) of regions that hold several components, with region, root and n, the rows of the region."""
    rows = rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("tree", "key", "fp", F.coalesce("root", "fp").alias("root"), F.substring("key", 1, 2 * LEAST_DEPTH).alias("region"))
    sizes = rows.groupBy("tree", "region").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("tree", "region", "n")
    return rows.join(sizes, ["tree", "region"])


def _nearest_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tree and key -> pairs (a, b) of each row and the nearest rows of another component before and after it in its region."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        region = _prefixes(batch)[:, : LEAST_DEPTH + 1]
        fp, root = (np.array(batch.column(c).to_pylist(), dtype=object) for c in ("fp", "root"))
        if before is not None:
            region, fp, root = np.concatenate([before[0], region]), np.concatenate([before[1], fp]), np.concatenate([before[2], root])
        n = len(fp)
        inside = np.zeros(n, bool)
        inside[1:] = (region[1:] == region[:-1]).all(1)
        starts = ~inside
        starts[1:] |= root[1:] != root[:-1]
        at = np.flatnonzero(starts)
        run = np.cumsum(starts) - 1
        low, high = at[run], np.append(at[1:], n)[run]
        i = np.flatnonzero(inside[low])
        j = np.flatnonzero(high < n)
        j = j[inside[high[j]]]
        pairs = {(min(p), max(p)) for p in [*zip(fp[i], fp[low[i] - 1], strict=True), *zip(fp[j], fp[high[j]], strict=True)]}
        if pairs:
            a, b = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_arrays([_fixed(a), _fixed(b)], names=["a", "b"])
        # the last row of each of the last two runs
        keep = np.unique([max(0, at[-1] - 1), n - 1])
        before = region[keep], fp[keep], root[keep]


def nearer(several: DataFrame) -> DataFrame:
    """Pairs (a, b) of nearest rows of different components; several: as _several() gives."""
    rows = several.select("tree", "key", "fp", "root")
    dealt = rows.repartitionByRange(_partitions(several), "tree", "key", "fp").sortWithinPartitions("tree", "key", "fp")
    return dealt.mapInArrow(_nearest_others, "a binary, b binary").distinct()


def _alike(least: int):
    """Rows (tree, region, root, fp, n_shingles, sig) sorted by region -> fp of those that have a row of another component, LIKE equal hashes and a fitting size beside them."""

    def alike(root: list[bytes], size: np.ndarray, sig: np.ndarray) -> np.ndarray:
        of = np.unique(np.array(root, dtype=object), return_inverse=True)[1]
        out = np.zeros(len(of), bool)
        step = max(1, (1 << 22) // (K * len(of)))
        for i in range(0, len(of), step):
            e = slice(i, i + step)
            fits = (of[e, None] != of) & (100 * np.minimum(size[e, None], size) >= least * np.maximum(size[e, None], size))
            out[e] = (fits & ((sig[e, None] == sig).sum(2) >= LIKE)).any(1)
        return out

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, root, fp, size, sig = None, [], [], [], []

        def found() -> list[bytes]:
            hit = alike(root, np.array(size, np.int64), np.frombuffer(b"".join(sig), ">u2").reshape(-1, K))
            return [f for f, h in zip(fp, hit.tolist(), strict=True) if h]

        for batch in batches:
            out = []
            for t, g, r, f, n, s in zip(*(batch.column(c).to_pylist() for c in ("tree", "region", "root", "fp", "n_shingles", "sig")), strict=True):
                if (t, g) != now:
                    out += found() if fp else []
                    now, root, fp, size, sig = (t, g), [], [], [], []
                root.append(r)
                fp.append(f)
                size.append(n)
                sig.append(s)
            if out:
                yield pa.RecordBatch.from_arrays([_fixed(out)], names=["fp"])
        if fp and (out := found()):
            yield pa.RecordBatch.from_arrays([_fixed(out)], names=["fp"])

    return regions


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            texts = pa.array([z.decompress(t).decode() for t in part.column("z").to_pylist()], pa.large_string())
            sets = list(shingle_sets(texts))
            size = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.column(c).to_numpy(), size)) for c in ("rid", "rh")] + [pa.array(np.concatenate(sets).view(np.int64))], names=["rid", "rh", "g"]
            )


def exact_rest(several: DataFrame, reps: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of different components among the rows of several that may be similar enough: a prefix-filtered join of shingles."""
    fit = several.filter(F.col("n") <= REGION).select("tree", "region", "root", "fp").join(reps.select("fp", "n_shingles", "sig"), "fp")
    fit = fit.repartition(_partitions(several), "tree", "region").sortWithinPartitions("tree", "region", "fp").select("tree", "region", "root", "fp", "n_shingles", "sig")
    some = fit.mapInArrow(_alike(least), "fp binary").union(several.filter(F.col("n") > REGION).select("fp")).distinct()
    root_of = several.groupBy("fp").agg(F.min("root").alias("root"))
    rows = root_of.join(some, "fp").join(reps.select("fp", "n_shingles"), "fp").withColumns({"rid": F.monotonically_increasing_id(), "rh": F.xxhash64("root")})
    rows = written(rows, "near-rest")
    shingles = written(rows.select("fp", "rid", "rh").join(texts, "fp").select("rid", "rh", "z").mapInArrow(_shingle_rows, "rid long, rh long, g long"), "near-shingles")
    # what only one component has can't pair, and comes first in the order; then by rarity
    live = shingles.groupBy("g").agg(F.count("*").alias("df"), F.min("rh").alias("lo"), F.max("rh").alias("hi")).filter("lo <> hi").select("g", "df")
    own = Window.partitionBy("rid")
    ranked = shingles.select("rid", "g").join(live, "g").select("rid", "g", F.row_number().over(own.orderBy("df", "g")).alias("i"), F.count("*").over(own).alias("live"))
    left = F.col("live") - F.col("i") + 1  # shingles from this one on
    most = F.floor(left * (100 + least) / F.lit(least)) - F.col("n_shingles")  # the largest set that can still be similar enough
    ranked = ranked.join(rows.select("rid", "rh", "n_shingles"), "rid").select("rid", "g", "rh", F.col("n_shingles").alias("n"), most.alias("most"))
    prefix = written(ranked.filter(100 * F.col("most") >= least * F.col("n")), "near-prefix")
    # rows of one shingle in classes of equal bounds: only those go on that some other class, or another component in theirs, fits
    kind = prefix.groupBy("g", "n", "most").agg(F.min("rh").alias("lo"), F.max("rh").alias("hi"))
    other = kind.select(F.col("g").alias("h"), *[F.col(c).alias(f"o_{c}") for c in ("n", "most", "lo", "hi")])
    fits = (F.col("g") == F.col("h")) & (F.col("o_n") <= F.col("most")) & (F.col("n") <= F.col("o_most")) & (F.least("lo", "o_lo") != F.greatest("hi", "o_hi"))
    kept = prefix.join(kind.join(other, fits, "left_semi").select("g", "n", "most"), ["g", "n", "most"], "left_semi")
    x = kept.select("g", "rid", "rh", "n", "most")
    y = kept.select(F.col("g").alias("h"), *[F.col(c).alias(f"o_{c}") for c in ("rid", "rh", "n", "most")])
    pairs = x.join(y, (F.col("g") == F.col("h")) & (F.col("rid") < F.col("o_rid")) & (F.col("rh") != F.col("o_rh")) & (F.col("o_n") <= F.col("most")) & (F.col("n") <= F.col("o_most"))).select("rid", F.col("o_rid").alias("to")).distinct()
    pairs = pairs.join(rows.select("rid", F.col("fp").alias("a")), "rid").join(rows.select(F.col("rid").alias("to"), F.col("fp").alias("b")), "to")
    out = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "near-rest-pairs")
    for done in (rows, shingles, prefix):
        remove(done)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, th) of every row of docs; th: xxhash64 of the text."""
    rows = written(signed(docs, text, doc_id), "near-signed")
    reps = rows.filter(F.col("fp").isNotNull()).groupBy("fp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep"), F.min("doc_id").alias("low"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n_shingles")
    )
    reps = written(reps.select("fp", "low", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"), "sig", "n_shingles"), "near-reps")
    pairs = candidates(reps)
    best = (
        pairs.select(F.col("a").alias("v"), F.col("b").alias("w"), "c").union(pairs.select(F.col("b").alias("v"), F.col("a").alias("w"), "c"))
        .groupBy("v").agg(F.max(F.struct("c", "w")).alias("best")).select("v", F.col("best.w").alias("w"))
    )
    best = written(best, "near-best")
    # every row that shares a region with another has a candidate
    ends = best.select(F.col("v").alias("fp"))
    texts = written(
        docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))
        .join(reps.join(ends, "fp").select("fp", "rep_id", "rep_th"), (F.col("rep_id").eqNullSafe(F.col("id"))) & (F.col("rep_th") == F.col("th")))
        .dropDuplicates(["fp"]).select("fp", "text").mapInArrow(_pack, "fp binary, z binary"),
        "near-texts",
    )
    tried = [written(best.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct(), "near-first")]
    links = [written(confirmed(tried[0], texts, least), "near-links")]
    placed = written(orders(reps.join(ends, "fp", "left_semi")), "near-orders")
    roots = components(links[0])
    for k in range(ROUNDS + 1):
        several = written(_several(placed, roots), "near-several")
        more = nearer(several) if k < ROUNDS else exact_rest(several, reps, texts, least)
        more = more.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti")
        tried.append(written(more, "near-tried"))
        links.append(written(confirmed(tried[-1], texts, least), "near-links"))
        remove(several)
        if links[-1].limit(1).count():
            before, roots = roots, components(reduce(DataFrame.union, links))
            remove(before)
    low = reps.select("fp", "low").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least_of = low.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = written(low.join(least_of, "root").select("fp", "component_id"), "near-classes")
    for done in (pairs, best, texts, placed, reps, *tried, *links):
        remove(done)
    out = rows.join(classes, "fp", "left").withColumn("component_id", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "th")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 80) -> DataFrame:
    """One row, with all its columns, of each group: that with the least doc_id. Of a group in which no row has a doc_id, one row for each text stays."""
    found = near_duplicates(docs, text, doc_id, least)
    stay = found.filter(F.col("kept") | F.col("component_id").isNull())
    key = lambda i, th: [F.coalesce(i.cast("long"), F.lit(0)).alias("__q_id"), i.isNull().alias("__q_none"), th.alias("__q_th")]
    keys = ["__q_id", "__q_none", "__q_th"]
    all_rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *key(F.col(doc_id), F.xxhash64(F.col(text))))
    return all_rows.join(stay.select(*key(F.col("doc_id"), F.col("th"))), keys, "left_semi").dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


SQL_OP5 = r"""
with recursive ws as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w
  from documents),
sh as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) end s from ws),
cls as (select list_sort(s) s, min(doc_id) rep from sh where len(s) > 0 group by 1),
ex as (select rep, len(s) n, unnest(s) g from cls),
pr as (select a.rep x, b.rep y, any_value(a.n) nx, any_value(b.n) ny, count(*) c from ex a join ex b on a.g = b.g and a.rep < b.rep group by 1, 2),
lk as (select x, y from pr where 100 * c >= 80 * (nx + ny - c)),
e as (select x, y from lk union all select y, x from lk),
cc(id, root) using key (id) as (
  select rep, rep from cls
  union
  select e.y, min(cc.root) from cc join e on e.x = cc.id join recurring.cc r on r.id = e.y where cc.root < r.root group by e.y)
select sh.doc_id, len(sh.s)::bigint n_shingles, coalesce(cc.root, sh.doc_id) component_id, sh.doc_id = coalesce(cc.root, sh.doc_id) kept
from sh left join cls on cls.s = list_sort(sh.s) left join cc on cc.id = cls.rep
"""
