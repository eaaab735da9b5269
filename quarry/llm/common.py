"""Shared pieces: tables written to the cluster's shared folder, text blocks and word splitting."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: runs of bytes other than space and 0x09-0x0D, after lower-casing A-Z.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
#: Text bytes that one message from a block to a range stands for; least and most bytes of text in a block (a longer document makes a block of its own).
MESSAGE, LEAST_BLOCK_BYTES, MOST_BLOCK_BYTES = 16 << 10, 1 << 20, 256 << 20
#: While tables are written: bytes that go to a Python worker at once, as rows of blocks and sets are large, and shuffle files go with their query.
STORING = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Copies of a row that a task makes of one.
AT_ONCE = 1 << 16
#: Key ranges of a small corpus; ranges or blocks that a task takes, on average, whatever the session's partitions.
LEAST_RANGES, RANGES_EACH = 24, 16
BLOCK_SCHEMA = "block long, bytes long, doc_ids binary, offsets binary, payload binary"
MIX = np.uint64(0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only local mode, as in tests, has another.

    Everything stands below one folder for the application, which the driver's file system deletes when it ends.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        top = "file:///tmp/checkpoints"
    root = f"{top.rstrip('/')}/quarry-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.mkdirs(path):
        files.deleteOnExit(path)
    return root


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings for a time; then what was there before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, tag: str, *done: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. done: stored tables that only df reads."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with settings(spark, STORING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    discard(*done)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later result reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def source_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, as the optimizer knows them, without those of unknown size (which are not files).

    Estimates of joins are products and of no use here.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(x for x in sizes if x < 1 << 60)


def block_size(docs: DataFrame) -> int:
    """Text bytes of a block, and of a range of keys: the square root of corpus times MESSAGE.

    Blocks send a message to each range. With both of this size a message stands for MESSAGE bytes of text at any size of
    the corpus, so that messages grow as the corpus does, up to MOST_BLOCK_BYTES, what a task can hold (about 20 times that).
    """
    return min(max(isqrt(source_bytes(docs) * MESSAGE), LEAST_BLOCK_BYTES), MOST_BLOCK_BYTES)


def repeated(rows: DataFrame, times: str, number: str | None = None) -> DataFrame:
    """Every row as often as its column `times` says, without that column; `number` counts the copies of a row from 0.

    A row of many copies is first cut into rows of AT_ONCE copies, which are dealt out.
    """
    names, t = [F.col(f"`{c}`") for c in rows.columns if c != times], F.col(times).cast("long")
    few = rows.where(t.between(1, AT_ONCE)).select(*names, F.explode(F.sequence(F.lit(0).cast("long"), t - 1)).alias("#"))
    cut = rows.where(t > AT_ONCE).select(*names, t.alias(times), F.explode(F.sequence(F.lit(0).cast("long"), t - 1, F.lit(AT_ONCE).cast("long"))).alias("#"))
    many = cut.repartition("#").select(*names, F.explode(F.sequence(F.col("#"), F.least(F.col("#") + AT_ONCE, F.col(times)) - 1)).alias("#"))
    both = few.unionByName(many)
    return both.withColumnRenamed("#", number) if number else both.drop("#")


def range_count(blocks: DataFrame, range_bytes: int) -> int:
    """Key ranges for a corpus: one for each range_bytes of text, and LEAST_RANGES for a small one."""
    return max(LEAST_RANGES, -(-int(blocks.agg(F.sum("bytes")).first()[0] or 0) // range_bytes))


def dealt(df: DataFrame, key: str | list[str], ranges: int) -> DataFrame:
    """df by key in as many partitions as the corpus needs, so that tasks stay as large as they are at any size."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-ranges // RANGES_EACH)), *([key] if isinstance(key, str) else key))


def give_back() -> None:
    """Return memory that a Python worker has freed to the system: workers stay, and executors count it."""
    pa.default_memory_pool().release_unused()
    system = ctypes.CDLL(None)
    if hasattr(system, "mallopt"):
        system.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays of 1 MB or more go back as soon as they are freed
    if hasattr(system, "malloc_trim"):
        system.malloc_trim(0)


def portions(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of a text column, one row at least."""
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(lens) - lens) // most
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch if b - a == batch.num_rows else batch.take(pa.array(np.arange(a, b)))  # a copy: casts of slices go wrong


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each 64-bit key; it does not fall as keys rise."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def slices(owner: np.ndarray, n: int) -> np.ndarray:
    """Ends of the stretches of 0..n-1 in the ascending array owner, from 0."""
    return np.searchsorted(owner, np.arange(n + 1))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        h = h * MIX
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
    return h


def byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)


def rolling(h: np.ndarray, k: int, mul: np.uint64) -> np.ndarray:
    """Polynomial hash of every k consecutive values of h, by doubling."""
    out, out_len, cur, size = None, 0, h, 1
    with np.errstate(over="ignore"):
        while True:
            if k & 1:
                if out is None:
                    out, out_len = cur, size
                else:
                    n = min(len(out), len(cur) - out_len)
                    if n <= 0:
                        return h[:0]
                    out = out[:n] * mul + cur[out_len : out_len + n]
                    out_len += size
            k >>= 1
            if not k:
                return out
            n = len(cur) - size
            if n <= 0:
                return h[:0]
            cur = cur[:n] * mul + cur[size : size + n]
            size *= 2
            mul = mul * mul


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    cur, size = h, 1
    while size * 2 <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    d = w - size
    return np.minimum(cur[: len(cur) - d], cur[d:]) if d else cur


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word id of every word in order, number of words of each text, the distinct words). Null texts have no words."""
    texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary
    blank = np.flatnonzero(pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)) if len(words) else []
    counts = np.diff(offsets)
    if len(blank):
        keep = ids != blank[0]
        before = np.concatenate(([0], np.cumsum(keep)))
        counts = before[offsets[1:]] - before[offsets[:-1]]
        ids = ids[keep]
    return ids, counts, words


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each distinct word; equal words have equal hashes everywhere."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_binary())
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    start, lens = off[:-1] - off[0], np.diff(off)
    out = mixed(lens.astype(np.uint64) + np.uint64(0x51ED27))
    order = np.argsort(-lens, kind="stable")
    sorted_lens = -lens[order]
    table, mul = byte_table(11), np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for i in range(int(lens.max(initial=0))):
            live = order[: np.searchsorted(sorted_lens, -i, side="left")]
            if not len(live):
                break
            if len(live) <= 4:  # a few very long words are left
                for j in live:
                    rest = table[data[start[j] + i : start[j] + lens[j]]]
                    h = out[j]
                    for v in rest:
                        h = h * mul + v
                    out[j] = h
                break
            out[live] = out[live] * mul + table[data[start[live] + i]]
    return mixed(out)


def blocks_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Rows of about block_bytes of text: doc_ids int64, offsets int64, compressed texts. No shuffle; null texts are empty.

    Rows with a null doc_id are kept with the smallest long as id, which no other row may use.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        task, seq = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        texts: list[pa.Array] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, texts, size, seq
            text = pa.concat_arrays(texts)
            off = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1] if len(text) else np.zeros(1, np.int64)
            data = text.buffers()[2] or b""
            raw = bytes(memoryview(data)[int(off[0]) : int(off[-1])])
            row = pa.record_batch(
                [
                    pa.array([(task << 32) | seq], pa.int64()),
                    pa.array([len(raw)], pa.int64()),
                    pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                    pa.array([(off - off[0]).tobytes()], pa.binary()),
                    pa.array([codec.compress(raw, asbytes=True) if raw else b""], pa.binary()),
                ],
                ["block", "bytes", "doc_ids", "offsets", "payload"],
            )
            ids, texts, size, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            give_back()
            doc_id = pc.fill_null(batch.column(0), -(2**63)).to_numpy(zero_copy_only=False).astype(np.int64)
            text = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
            lens = pc.binary_length(text).to_numpy(zero_copy_only=False)
            at = 0
            for i in range(len(doc_id)):
                size += int(lens[i])
                if size >= block_bytes:
                    ids.append(doc_id[at : i + 1])
                    texts.append(text.slice(at, i + 1 - at))
                    at = i + 1
                    yield flush()
            if at < len(doc_id):
                ids.append(doc_id[at:])
                texts.append(text.slice(at))
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, BLOCK_SCHEMA)


def opened(doc_ids: bytes, offsets: bytes, payload: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """The doc ids, offsets and raw bytes of a block."""
    off = np.frombuffer(offsets, np.int64)
    raw = pa.Codec("zstd", 1).decompress(payload, decompressed_size=int(off[-1]), asbytes=True) if off[-1] else b""
    return np.frombuffer(doc_ids, np.int64), off, raw


def block_texts(off: np.ndarray, raw: bytes) -> pa.Array:
    """A block's texts as an Arrow array over the same memory."""
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.tobytes()), pa.py_buffer(raw))


def packed(values: np.ndarray) -> bytes:
    """A compressed array."""
    raw = np.ascontiguousarray(values)
    return pa.Codec("zstd", 1).compress(raw.tobytes(), asbytes=True) if raw.nbytes else b""


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending unsigned keys: the bytes of their differences, all highest ones first, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return packed(steps.T)


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpacked(data, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """Numbers below 2^32, as those of one block are, by byte, compressed; larger ones stand as the largest."""
    return packed(np.minimum(counts, 2**32 - 1).astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def unpacked_counts(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(unpacked(data, np.uint8, 4 * n).reshape(4, n).T).view(np.uint32).ravel().astype(np.int64)


def packed_totals(counts: np.ndarray) -> bytes:
    """Numbers of the whole corpus, by byte, compressed: bytes that are 0 everywhere take next to nothing."""
    return packed(counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T)


def unpacked_totals(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(unpacked(data, np.uint8, 8 * n).reshape(8, n).T).view(np.int64).ravel()


def unpacked(data: bytes, kind: type, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    return np.frombuffer(pa.Codec("zstd", 1).decompress(data, decompressed_size=n * np.dtype(kind).itemsize, asbytes=True), kind)


def six_bytes(items: np.ndarray) -> bytes:
    """The low 48 bits of each item, in order."""
    return items.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return raw.view("<u8").ravel()
