"""URL filters: prefix rules, and for the rest a Bloom filter cascade over the hosts.

The key universe is the distinct hosts of the whole table. Level 0 of a cascade encodes the listed keys; level 1 those
unlisted keys that level 0 takes for listed; level 2 those listed keys that level 1 wrongly takes; and so on
until a level errs for no key of the universe. Asking the levels in turn until one says no gives exact
membership for every key of the universe: the number of levels that said yes is odd for a listed one.

Keys are distinct and dealt into shards by a hash, so shards are even, and about SHARD_KEYS keys each. The cascade of a
shard is built in one task of bounded size. If all cascades together are at most BROADCAST_BYTES, they are
broadcast and pages are judged as they are read. Beyond that they are files in the shared folder, and pages, in the order of their shard and
dealt evenly by range however many have one host, are judged by the cascades that a task opens one after another: no page is joined with anything.
Only to build the cascades the distinct hosts meet the listed keys.

Defined cases: a null url, or one without "://", has an empty host and path, which no rule fits and no list holds, so it is
allowed; equal urls get equal verdicts; an empty list allows all; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, mix, remove, scratch_dir, table, written

#: (verdict, host, path); a rule fits its host and all subdomains if the url's path starts with its own.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Labels of hosts that are listed: a host is blocked if one of its labels is here.
LISTED_LABELS = ("adult-x", "casino-win", "cheap-pills", "free-bets", "ads-track", "spam-farm")
SHARD_KEYS = 100_000
BROADCAST_BYTES = 32 << 20
#: Error rate of every level after the first.
RATE = 0.5
_U = np.uint64


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, 2**31 - 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


# --- the cascade ------------------------------------------------------------------------------


def _bits(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, size: int) -> np.ndarray:
    a, b = mix(h1 + _U(level * 0x9E3779B9)), mix(h2 ^ _U(level * 0x85EBCA6B)) | _U(1)
    return (a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % _U(size)


def build(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> bytes:
    """The cascade over a universe of keys, given as two hashes each, with listed marked."""
    out = []
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        level = len(out)
        rate = min(RATE, len(inside) * 0.7 / max(1, len(outside))) if level == 0 else RATE
        size = max(8, int(np.ceil(-len(inside) * np.log(rate) / np.log(2) ** 2)))
        hashes = max(1, round(size / len(inside) * np.log(2)))
        bits = np.zeros(size, bool)
        bits[_bits(h1[inside], h2[inside], level, hashes, size).ravel()] = True
        out.append(struct.pack("<II", size, hashes) + np.packbits(bits).tobytes())
        wrong = outside[bits[_bits(h1[outside], h2[outside], level, hashes, size)].all(1)] if len(outside) else outside
        if level > 200:
            raise ValueError("two keys of the universe have equal hashes and aren't both listed")
        inside, outside = wrong, inside
    return struct.pack("<I", len(out)) + b"".join(out)


def ask(blob: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed."""
    (levels,), at = struct.unpack_from("<I", blob), 4
    yes, going = np.zeros(len(h1), np.int64), np.arange(len(h1))
    for level in range(levels):
        size, hashes = struct.unpack_from("<II", blob, at)
        data = np.frombuffer(blob, np.uint8, (size + 7) // 8, at + 8)
        at += 8 + len(data)
        if len(going):
            bits = np.unpackbits(data, count=size).astype(bool)
            going = going[bits[_bits(h1[going], h2[going], level, hashes, size)].all(1)]
            yes[going] += 1
    return yes % 2 == 1


def _hashes(df: DataFrame, key: str, shards: int) -> DataFrame:
    return df.withColumns({"h1": F.xxhash64(F.col(key)), "h2": F.xxhash64(F.lit(1), F.col(key))}).withColumn("shard", F.pmod(F.xxhash64(F.lit(2), F.col(key)), F.lit(shards)))


def cascades(universe: DataFrame, shards: int) -> DataFrame:
    """universe (key, listed), keys distinct -> (shard, cascade)."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        as_u = lambda c: pdf[c].to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "cascade": [build(as_u("h1"), as_u("h2"), pdf["listed"].to_numpy(bool))]})

    return _hashes(universe, "key", shards).select("shard", "h1", "h2", "listed").groupBy("shard").applyInPandas(make, "shard long, cascade binary")


def _store(uri: str):
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = fs.FileSystem.from_uri(uri)
        for b in batches:
            for shard, cascade in zip(b.column("shard").to_pylist(), b.column("cascade").to_pylist(), strict=True):
                own = f"{root}/.{shard}-{uuid.uuid4().hex}"
                with at.open_output_stream(own) as f:
                    f.write(cascade)
                at.move(own, f"{root}/{shard}")
            yield pa.RecordBatch.from_arrays([b.column("shard")], names=["shard"])

    return store


def _judge(cascade: Callable[[int], bytes | None]):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = (np.asarray(b.column(c)).astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
            shard, hit = np.asarray(b.column("shard")), np.zeros(b.num_rows, bool)
            for s in np.unique(shard).tolist():
                if (blob := cascade(s)) is not None:
                    i = np.flatnonzero(shard == s)
                    hit[i] = ask(blob, h1[i], h2[i])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("page_id", "host", "path", "rule", "said")], pa.array(hit)], names=["page_id", "host", "path", "rule", "said", "hit"])

    return judge


def _opened(uri: str) -> Callable[[int], bytes | None]:
    """The cascade of a shard from its file; the last one is kept."""
    kept: dict[int, bytes] = {}

    def cascade(shard: int) -> bytes:
        if shard not in kept:
            at, root = fs.FileSystem.from_uri(uri)
            with at.open_input_stream(f"{root}/{shard}") as f:
                kept.clear()
                kept[shard] = f.read()
        return kept[shard]

    return cascade


def filter_urls(
    pages: DataFrame, listed: DataFrame | Callable[[Column], Column], url: str = "url", page_id: str = "page_id", rules=RULES, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """page_id, host, path, rule, verdict and by (rule or list) of every row of pages. listed: a table of listed hosts (its column key; null is
    none), or a function from the host column to whether it is listed (null counts as not)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = rows.select(F.col("host").alias("key")).distinct()
    if isinstance(listed, DataFrame):
        on_list = listed.select("key").filter(F.col("key").isNotNull()).distinct().withColumn("listed", F.lit(True))
        universe = hosts.join(on_list, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    else:
        universe = hosts.select("key", F.coalesce(listed(F.col("key")), F.lit(False)).alias("listed"))
    universe = written(universe, "url-keys")
    shards = max(1, -(-universe.count() // shard_keys))
    made = written(cascades(universe, shards), "url-cascades")
    remove(universe)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = _hashes(rows.withColumns({"rule": rule, "said": verdict}), "host", shards)
    out = f"page_id {dict(rows.dtypes)['page_id']}, host string, path string, rule string, said string, hit boolean"
    if (made.agg(F.sum(F.length("cascade"))).first()[0] or 0) <= broadcast_bytes:
        sent = spark.sparkContext.broadcast({r["shard"]: bytes(r["cascade"]) for r in made.toLocalIterator()})
        judged = rows.mapInArrow(_judge(lambda s: sent.value.get(s)), out)
        remove(made)
    else:
        uri = f"{scratch_dir(spark)}/url-shards-{uuid.uuid4().hex}"
        at, root = fs.FileSystem.from_uri(uri)
        at.create_dir(root, recursive=True)
        remove(written(made.mapInArrow(_store(uri), "shard long"), "url-stored"))
        remove(made)
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = rows.withColumn("spread", F.xxhash64("page_id", "path")).repartitionByRange(n, "shard", "spread").sortWithinPartitions("shard")
        judged = dealt.mapInArrow(_judge(_opened(uri)), out)
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"), F.when(F.col("rule").isNull(), "list").otherwise("rule").alias("by")
    )


def label_listed(host: Column) -> Column:
    return F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, LISTED_LABELS)))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(host_and_path(F.col("url"))[0].alias("key")).distinct()
    return filter_urls(pages, hosts.filter(label_listed(F.col("key"))))


SQL_OP2 = r"""
with a as (select page_id, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end rest from pages),
b as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from a),
c as (select *, case
  when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
  when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end rule from b)
select page_id, host, path, rule, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
  when list_has_any(string_split(host, '.'), ['adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'ads-track', 'spam-farm']) then 'block' else 'allow' end verdict,
  case when rule is null then 'list' else 'rule' end "by"
from c
"""
