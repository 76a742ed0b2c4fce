"""Training-order materialisation: token shards in a keyed random order.

Documents are tokenised, ended by an end mark and packed one after another into sequences of ROW_TOKENS little-endian 16-bit ids; the last
sequence of each scan partition is padded. The packed sequences are written first, with the number of their partition and their place in it, so
that their global numbers 0..n-1 rest on a table, and not on two scans that happen to split alike. A keyed Feistel network over the smallest even
number of bits that holds n, walked along its cycle until it lands below n, permutes the numbers: a bijection onto the global slots
0..n-1 that any task can work out alone. Slots are dealt by range: a task writes consecutive shards of SHARD_ROWS sequences in slot order, and at
most TASKS tasks do, each as a stream. The stride is fixed, so slot s lies in shard s // SHARD_ROWS at byte (s % SHARD_ROWS) * 2 * ROW_TOKENS, and a
reader goes on from any slot. Each shard is written beside its place and moved there, so a task that is run again
leaves the same file. Beside the shards are `index`, a row for each document, and `manifest.json`, which is written last: without it a folder isn't complete.

Defined cases: null and empty texts are the end mark alone; repeated rows are packed each; doc_id may be null;
an empty table gives no shards; extra columns are ignored; texts of any length are packed whole, over as many sequences as they need.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, remove, scratch_dir, table, written

SHARD_ROWS, ROW_TOKENS, KEY, ROUNDS = 4096, 2048, 20240229, 6
#: Tasks that write shards, at most.
TASKS = 20_000
#: Of compression between tasks; bytes of its dictionary, and of the sequences that this is learned from, at most, and from how many parts.
LEVEL, DICTIONARY, SAMPLE, SAMPLE_PARTS = 6, 112_640, 8 << 20, 64
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE of 50k ids cuts text before merging: a published pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END, PAD = 50256, 50256
_U = np.uint64


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots of the numbers x below n: a permutation of 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = _U((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(key))
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> _U(half), out[todo] & mask
        for k in keys:
            a, b = b, a ^ (mix(b ^ k) & mask)
        out[todo] = (a << _U(half)) | b
        todo = todo[out[todo] >= _U(n)]
    return out.astype(np.int64)


def encoder(ranks: bytes | None):
    """text -> ids. ranks: a tiktoken rank file; None: UTF-8 bytes as ids."""
    if ranks is None:
        return lambda t: np.frombuffer(t.encode(), np.uint8).astype("<u2")
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    return lambda t: np.array(enc.encode_ordinary(t), dtype="<u2")


PACKED = "part int, seq long, place int, n_tokens long, doc_id long, ids binary"


def _pack(sent, row_tokens: int):
    """(doc_id, text) -> a row with n_tokens for each document, where it begins, and one with ids for each sequence."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(sent.value), TaskContext.get().partitionId()
        end = np.array([END], "<u2")
        left, done = np.zeros(0, "<u2"), 0  # tokens that fill no sequence yet, and sequences so far

        def rows(docs: list[tuple], first: int, ids: np.ndarray) -> pa.RecordBatch:
            n, k = len(docs), len(ids) // row_tokens
            seq, place, size, doc_id = ([d[i] for d in docs] for i in range(4))
            cols = [
                pa.array([part] * (n + k), pa.int32()), pa.array([*seq, *range(first, first + k)], pa.int64()), pa.array(place + [None] * k, pa.int32()), pa.array(size + [None] * k, pa.int64()),
                pa.array(doc_id + [None] * k, pa.int64()), pa.array([None] * n + [x.tobytes() for x in ids.reshape(-1, row_tokens)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["part", "seq", "place", "n_tokens", "doc_id", "ids"])

        docs, parts, size = [], [left], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                at = size + len(left)
                docs.append((done + at // row_tokens, at % row_tokens, len(ids), doc_id))
                parts.append(ids)
                size += len(ids)
                if size >= 256 * row_tokens:
                    whole = np.concatenate(parts)
                    full = len(whole) // row_tokens * row_tokens
                    yield rows(docs, done, whole[:full])
                    done, left = done + full // row_tokens, whole[full:]
                    docs, parts, size = [], [left], 0
        whole = np.concatenate(parts)
        if len(whole):
            yield rows(docs, done, np.concatenate([whole, np.full(-len(whole) % row_tokens, PAD, "<u2")]))

    return pack


def _slots(n: int, key: int):
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("slot")
            yield b.set_column(i, "slot", pa.array(feistel(b.column(i).to_numpy(), n, key)))

    return slots


def _dictionary(packed: DataFrame, parts: list[int], row_tokens: int) -> bytes | None:
    """What sequences share, for their compression; learned from the first ones of some parts. Only the size of what goes between tasks depends on it."""
    parts = parts[:: -(-len(parts) // max(1, min(SAMPLE_PARTS, SAMPLE // (2 * row_tokens)))) or 1]
    each = max(1, SAMPLE // (2 * row_tokens * max(1, len(parts))))
    some = packed.filter(F.col("part").isin(parts) & (F.col("seq") < each) & F.col("n_tokens").isNull()).select("ids").collect()
    try:
        return zstandard.train_dictionary(DICTIONARY, [bytes(r["ids"]) for r in some]).as_bytes()
    except zstandard.ZstdError:  # too few sequences, or all alike
        return None


def _with(sent) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(sent.value) if sent.value else None


def _squeezed(sent):
    """(slot, ids), ids compressed for the way to their shard."""

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=_with(sent))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("slot"), pa.array([z.compress(x.as_buffer()) for x in b.column("ids")], pa.binary())], names=["slot", "ids"])

    return squeezed


def _write(uri: str, shard_rows: int, sent):
    """(slot, compressed ids) in the order of slots -> (shard, rows) of the files written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        shard, out, name, rows, z = None, None, "", 0, zstandard.ZstdDecompressor(dict_data=_with(sent))

        def close() -> pa.RecordBatch:
            out.close()
            store.move(name, f"{root}/shard-{shard:09d}.bin")
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([rows], pa.int64())], names=["shard", "rows"])

        for b in batches:
            for slot, ids in zip(b.column("slot").to_pylist(), b.column("ids"), strict=True):
                if slot // shard_rows != shard:
                    if out is not None:
                        yield close()
                    shard, rows = slot // shard_rows, 0
                    name = f"{root}/.shard-{shard:09d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(name)
                out.write(z.decompress(ids.as_buffer()))
                rows += 1
        if out is not None:
            yield close()

    return write


def materialise(
    docs: DataFrame, uri: str | None = None, text: str = "text", doc_id: str = "doc_id", key: int = KEY, shard_rows: int = SHARD_ROWS, row_tokens: int = ROW_TOKENS, tokenizer: str | None = TOKENIZER
) -> DataFrame:
    """Writes shards, index and manifest to uri (default: a new folder in spark.checkpoint.dir), and returns the index: (doc_id, n_tokens, seq,
    place, slot, shard, row) of every row of docs. It begins at token `place` of sequence number `seq`, which has that slot, shard and row."""
    spark = docs.sparkSession
    ranks = None
    if tokenizer is not None:
        with open(tokenizer, "rb") as f:  # on the driver; tasks get its bytes
            ranks = f.read()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    packed = written(rows.mapInArrow(_pack(spark.sparkContext.broadcast(ranks), row_tokens), PACKED), "order-packed")
    uri = uri or f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}"
    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    counts = sorted(packed.filter(F.col("n_tokens").isNull()).groupBy("part").agg(F.count("*").alias("n")).collect())
    n, first = 0, []
    for p, c in counts:  # one number for each scan task
        first.append((p, n))
        n += c
    starts = F.broadcast(spark.createDataFrame(first or [(0, 0)], "part int, first long"))
    number = packed.join(starts, "part").withColumn("seq", F.col("first") + F.col("seq")).withColumn("slot", F.col("seq"))
    shards = -(-n // shard_rows)
    each = max(1, -(-shards // TASKS))
    shared = spark.sparkContext.broadcast(_dictionary(packed, [p for p, _ in counts], row_tokens))
    slotted = number.filter(F.col("n_tokens").isNull()).select("slot", "ids").mapInArrow(_slots(max(n, 1), key), "slot long, ids binary").mapInArrow(_squeezed(shared), "slot long, ids binary")
    dealt = slotted.repartitionById(max(1, -(-shards // each)), F.floor(F.col("slot") / (shard_rows * each)).cast("int")).sortWithinPartitions("slot")
    files = written(dealt.mapInArrow(_write(uri, shard_rows, shared), "shard long, rows long"), "order-files")
    index = number.filter(F.col("n_tokens").isNotNull()).select("doc_id", "n_tokens", "seq", F.col("place").cast("long").alias("place"), "slot")
    index = index.mapInArrow(_slots(max(n, 1), key), "doc_id long, n_tokens long, seq long, place long, slot long")
    index = index.withColumns({"shard": F.floor(F.col("slot") / shard_rows), "row": F.col("slot") % shard_rows})
    index.write.mode("overwrite").option("compression", "zstd").parquet(f"{uri}/index")
    have = files.agg(F.count("*"), F.sum("rows")).first()
    if tuple(have) != (shards, n or None):
        raise RuntimeError(f"{have} files and rows written, {shards} and {n} expected")
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"sequences": n, "row_tokens": row_tokens, "shard_rows": shard_rows, "shards": shards, "key": key, "rounds": ROUNDS, "dtype": "<u2", "end": END, "pad": PAD}).encode())
    for done in (packed, files):
        remove(done)
    return spark.read.schema(index.schema).parquet(f"{uri}/index")


def manifest(uri: str) -> dict:
    store, root = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def read_sequences(uri: str, slot: int = 0) -> Iterator[np.ndarray]:
    """The sequences from a slot on, in training order."""
    m = manifest(uri)
    store, root = fs.FileSystem.from_uri(uri)
    while slot < m["sequences"]:
        with store.open_input_file(f"{root}/shard-{slot // m['shard_rows']:09d}.bin") as f:
            f.seek(slot % m["shard_rows"] * 2 * m["row_tokens"])
            while True:
                got = np.frombuffer(f.read(2 * m["row_tokens"]), "<u2")
                if not len(got):
                    break
                yield got
                slot += 1


def read_document(uri: str, seq: int, place: int, n_tokens: int) -> np.ndarray:
    """Ids of a document, from the slots of the sequences that hold it."""
    m = manifest(uri)
    numbers = np.arange(seq, seq - (-(place + n_tokens) // m["row_tokens"]))
    whole = [next(read_sequences(uri, s)) for s in feistel(numbers, m["sequences"], m["key"]).tolist()]
    return np.concatenate(whole)[place : place + n_tokens]


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(table(spark, sf_dir, "documents"))
