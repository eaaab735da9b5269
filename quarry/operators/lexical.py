"""BM25 of a few questions over chunks whose keys differ: tokens, postings and scores in Arrow batches and arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.text import CJK, OTHER, STOP
from quarry.settings import Settings

#: Texts and bytes of texts that are cut into words at once; a longer text is alone.
BLOCK_TEXTS, BLOCK_BYTES = 4096, 8 << 20
#: Terms of chunks times their queries, and chunks times queries, that are added up at once; a chunk is not divided.
HITS_AT_ONCE, CELLS_AT_ONCE = 1 << 20, 1 << 21

#: Bytes of UTF-8: blanks for ASCII signs that are in no token, the others as they are.
TOKEN_BYTES = bytes(c if c >= 0x80 or c == 0x5F or chr(c).isalnum() else 0x20 for c in range(256))
RUNS, IS_CJK = re.compile(f"[{CJK}]+|[{OTHER}]+"), re.compile(f"[{CJK}]")
BLOCK = "block long, n long, all long, dl binary, terms binary, codes binary, tfs binary"


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.LargeStringArray]]:
    """Keys and texts of batches of these two columns, BLOCK_TEXTS and BLOCK_BYTES at once; null texts are empty."""
    for b in batches:
        texts = b.column(1).cast(pa.large_string()).fill_null("")
        ends = np.cumsum(np.asarray(pc.binary_length(texts)))
        at = 0
        while at < b.num_rows:
            n = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, "right")) - at
            n = min(max(1, n), BLOCK_TEXTS)
            yield b.column(0).slice(at, n), texts.slice(at, n)
            at += n


def cut_by_runs(text: str) -> list[str]:
    """functions.text.tokens() of a text in lower case."""
    return [t for s in RUNS.findall(text) for t in ([s[i : i + 2] for i in range(len(s) - 1)] if len(s) > 1 and IS_CJK.match(s) else [s])]


def cut(texts: pa.LargeStringArray) -> tuple[np.ndarray, pa.Array]:
    """Row and word of every token, as functions.text.tokens() cuts texts in lower case; empty words are among them.

    Tokens are what stands between ASCII signs, U+0080 to U+00BF and characters beyond U+FFFF, whose bytes become blanks.
    Texts that can hold CJK characters, by first bytes of U+3000 to U+DFFF, are cut by runs instead.
    """
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(bytearray(memoryview(texts.buffers()[2] or b"")[at[0] : at[-1]].tobytes().translate(TOKEN_BYTES)), np.uint8)
    at = at - at[0]
    high = np.flatnonzero(raw >= 0xC2)
    first = raw[high]
    for places, width in ((high[first == 0xC2], 2), (high[first >= 0xF0], 4)):
        for i in range(width):
            raw[places + i] = 0x20
    odd = np.unique(np.searchsorted(at, high[(first >= 0xE3) & (first <= 0xED)], "right") - 1)
    for row in odd:
        raw[at[row] : at[row + 1]] = 0x20
    words = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at), pa.py_buffer(raw)]))
    rows, flat = np.repeat(np.arange(len(texts)), np.asarray(words.value_lengths(), np.int64)), words.flatten()
    if len(odd):
        more = [cut_by_runs(t) for t in texts.take(pa.array(odd)).to_pylist()]
        rows = np.concatenate([rows, np.repeat(odd, list(map(len, more)))])
        flat = pa.concat_arrays([flat, pa.array([t for ts in more for t in ts], pa.large_string())])
    return rows, flat


class Asked(NamedTuple):
    """Terms of all queries: those of a term with code c are numbers[starts[c]:starts[c + 1]] of queries, and have it so many times."""

    terms: list[str]
    queries: list
    starts: np.ndarray
    numbers: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Asked:
        """Of (query, term, times)."""
        terms, queries = sorted({t for _, t, _ in rows}), list(dict.fromkeys(q for q, _, _ in rows))
        code, number = ({x: i for i, x in enumerate(xs)} for xs in (terms, queries))
        pairs = np.array(sorted((code[t], number[q], n) for q, t, n in rows), np.int64).reshape(-1, 3)
        return cls(terms, queries, np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1)), pairs[:, 1], pairs[:, 2])


def block_of(number: int, keys: pa.Array, texts: pa.LargeStringArray, asked: Asked, stop: list[str]) -> pa.RecordBatch:
    """One row of BLOCK and keys: lengths of the chunks that have an asked term, how many they have, and codes and frequencies of these."""
    known = pa.array([*asked.terms, *stop, ""], pa.large_string())  # what comes after the terms is no token
    row, words = cut(texts)
    found = np.asarray(pc.index_in(words, known).fill_null(-1))
    lengths = np.bincount(row[found < len(asked.terms)], minlength=len(texts))
    hit = (found >= 0) & (found < len(asked.terms))
    at, tf = np.unique(row[hit] * max(1, len(asked.terms)) + found[hit], return_counts=True)
    row, codes = np.divmod(at, max(1, len(asked.terms)))
    here, terms = np.unique(row, return_counts=True)
    arrays = [x.astype(np.int32).tobytes() for x in (lengths[here], terms, codes, tf)]
    held = pa.ListArray.from_arrays(pa.array([0, len(here)], pa.int32()), keys.take(pa.array(here)))
    return pa.RecordBatch.from_arrays([*(pa.array([x]) for x in (number, len(texts), int(lengths.sum()), *arrays)), held], names=["block", "n", "all", "dl", "terms", "codes", "tfs", "keys"])


def cut_best(chunks: np.ndarray, numbers: np.ndarray, scores: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Which of these pairs are the best k of their query, ties of scores rounded to nine digits to the chunk of the first place."""
    order = np.lexsort((place[chunks], -np.round(scores, 9), numbers))
    numbers = numbers[order]
    return order[np.arange(len(order)) - np.searchsorted(numbers, numbers) < k]


def scores_of(weights: np.ndarray, codes: np.ndarray, each: np.ndarray, place: np.ndarray, asked: Asked, k: int | None, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk, number of the query and score of all pairs with a positive score, or of the best k of a query.

    weights and codes: of the terms of all chunks, each: how many a chunk has, place: its place among the keys. floor: a
    score of each query that k chunks reach, which rises; pairs below it are left out.
    """
    spread, firsts, n = np.diff(asked.starts)[codes], np.r_[0, np.cumsum(each)], len(asked.queries)
    hits = np.r_[0, np.cumsum(spread)][firsts]  # terms times queries before a chunk
    best, at = [], 0
    while at < len(each):
        end = min(int(np.searchsorted(hits, hits[at] + HITS_AT_ONCE, "right")) - 1, at + CELLS_AT_ONCE // n, len(each))
        end = max(end, at + 1)
        own = slice(firsts[at], firsts[end])
        many = spread[own]
        pair = np.arange(many.sum()) + np.repeat(asked.starts[codes[own]] - (np.cumsum(many) - many), many)
        cells = np.repeat(np.repeat(np.arange(end - at) * n, each[at:end]), many) + asked.numbers[pair]
        scores = np.bincount(cells, np.repeat(weights[own], many) * asked.times[pair], (end - at) * n).reshape(end - at, n)
        wanted = scores > 0
        if k is not None:
            rounded = np.round(scores, 9)
            if end - at >= k:
                np.maximum(floor, np.partition(rounded, end - at - k, axis=0)[end - at - k], out=floor)
            wanted &= rounded >= floor
        chunks, numbers = np.nonzero(wanted)
        best.append((chunks + at, numbers, scores[chunks, numbers]))
        at = end
    chunks, numbers, scores = (np.concatenate(x) for x in zip(*best, strict=True)) if best else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    if k is not None:
        kept = cut_best(chunks, numbers, scores, place, k)
        chunks, numbers, scores = chunks[kept], numbers[kept], scores[kept]
    return chunks, numbers, scores


def bm25_scores(asked: DataFrame, chunks: DataFrame, k: int | None, settings: Settings, query_key: str, key: str, stop: list[str] | None = STOP) -> DataFrame:
    """query_key, key, score of all pairs with a positive score, or at least the best k of a query.

    asked(query_key, term, qtf) goes to all tasks, so its size has to be known, and keys of chunks have to differ. Texts are
    cut into tokens once: what is shuffled is a row for each block of chunks, with codes and frequencies of the asked
    terms. The same rows give the chunks of each term and then, beside these sums as one row, the scores.
    """
    spark, kinds = chunks.sparkSession, (asked.schema[query_key].dataType, chunks.schema[key].dataType)
    shared = spark.sparkContext.broadcast(Asked.of([tuple(r) for r in asked.select(query_key, "term", "qtf").collect()]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for i, (keys, texts) in enumerate(pieces(batches)):
            yield block_of(first | i, keys, texts, shared.value, stop or [])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """code, n: chunks that have the term; of code -1 all chunks, of -2 all their tokens."""
        sums = np.zeros(len(shared.value.terms) + 2, np.int64)
        for b in batches:
            sums[-1] += sum(b.column("n").to_pylist())
            sums[-2] += sum(b.column("all").to_pylist())
            for x in b.column("codes"):
                sums += np.bincount(np.frombuffer(x.as_py(), np.int32), minlength=len(sums))
        met = np.flatnonzero(sums)
        codes = np.where(met < len(shared.value.terms), met, met - len(sums))
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(sums[met])], names=["code", "n"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k1, b = shared.value, settings.bm25_k1, settings.bm25_b
        queries, floor = pa.array(own.queries, to_arrow_type(kinds[0])), np.full(len(own.queries), -np.inf)
        for batch in batches:
            for cell in (dict(zip(batch.schema.names, x, strict=True)) for x in zip(*batch.columns, strict=True)):
                sums = np.zeros(len(own.terms) + 2, np.int64)
                sums[np.asarray(cell["sums"].values.field("code"))] = np.asarray(cell["sums"].values.field("n"))
                dl, each, codes, tf = (np.frombuffer(cell[c].as_py(), np.int32) for c in ("dl", "terms", "codes", "tfs"))
                if not len(dl):
                    continue
                df, n, keys = sums[codes], sums[-1], cell["keys"].values
                norm = k1 * (1 - b + b * np.repeat(dl, each) / (sums[-2] / n))
                weights = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + norm)
                place = np.empty(len(dl), np.int64)
                place[np.asarray(pc.array_sort_indices(keys, null_placement="at_start"))] = np.arange(len(dl))
                found, numbers, scores = scores_of(weights, codes, each, place, own, k, floor)
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(numbers)), keys.take(pa.array(found)), pa.array(scores)], names=[query_key, key, "score"])

    names = [f"`{c}` {kind.simpleString()}" for c, kind in zip((query_key, key), kinds, strict=True)]
    blocks = chunks.select(key, F.lower("text").alias("text")).mapInArrow(pack, f"{BLOCK}, keys array<{kinds[1].simpleString()}>").repartition("block")
    # All columns go to both, so that both read one exchange.
    sums = blocks.mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct("code", "n")).alias("sums"))
    return blocks.crossJoin(F.broadcast(sums)).mapInArrow(score, f"{', '.join(names)}, score double")  # sums is one row
