"""Toxicity scores: a lexicon trie met with Levenshtein automata, and context windows around the hits.

The lexicon is learned from labelled rows: whole words and stems (word beginnings) that stand in many different contexts
of toxic rows and few of clean ones. Counting contexts rather than rows keeps copies of one row from teaching its whole
vocabulary. A text's distinct words are looked up once each: stems and words by walking the trie, misspelled words and
beginnings by walking it with a Levenshtein automaton that knows swaps and masked letters. Windows around the hits tell quoted or reported terms from used ones. A logistic
model over these counts gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import LEAST_RANGES, block_size, dealt, from_six, give_back, mixed, packed, packed_counts, portions, range_of, six_bytes, slices, source_bytes, stored, unpacked, unpacked_counts, word_hashes, word_ids

#: Labelled rows of each class used for the model, at most; entries of the lexicon, at most; words of a window's side.
FIT_TOXIC, FIT_CLEAN, ENTRIES, SIDE = 3000, 6000, 2000, 6
#: What a quotation mark on one side alone says; pairs of words and entries compared at once.
ONE_MARK, PAIRS_AT_ONCE = 0.25, 1 << 20
#: Parts of a word's contexts, at least; ranges for each further one.
LEAST_PARTS = 16
WHOLE, STEM = 1, 2
STEMS = range(3, 9)
#: Bits that tell labelled rows from most others.
BITS = 1 << 23
QUOTES = "\"“”„«»‹›‘’`"
#: Words that introduce what somebody else said, in the languages of the corpus.
REPORTING = frozenset("said says wrote called quoted quote writes sagte schrieb nannte zitat dit écrit appelé citation dijo escribió llamó cita".split())
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[^\W\d_]")
FEATURES = ("hits", "weight", "words", "kinds", "near", "quoted", "density", "length", "two", "three", "strong")


class Trie:
    """Lexicon entries by character; an end holds (weight, whole word?)."""

    def __init__(self, entries: list[tuple[str, bool, float]]):
        self.root: dict = {}
        for text, whole, weight in entries:
            node = self.root
            for ch in text:
                node = node.setdefault(ch, {})
            node["whole" if whole else "stem"] = weight
        # What is left of entries when up to two letters go (one, for stems): words near them leave the same.
        self.left_words = {x for w, whole, _ in entries if whole and len(w) >= 5 for x in without_letters(w, 2 if len(w) >= 8 else 1)}
        self.left_stems = {x for w, whole, _ in entries if not whole and len(w) >= 8 for x in without_letters(w, 1)}
        self.longest = max((len(w) for w, whole, _ in entries if whole), default=0)
        #: So many first characters of a word tell all that can be near an entry.
        self.reach = max(self.longest, max(STEMS)) + 3
        # Letters of the entries that misspellings are looked for of, by (whole word?, length).
        self.letters: dict[tuple[bool, int], list[str]] = {}
        for w, whole, _ in entries:
            if allowed(len(w), whole, False) > 0:
                self.letters.setdefault((whole, len(w)), []).append(w)

    def lookup(self, word: str) -> tuple[float, bool]:
        """(largest weight of an entry that is the word or begins it, whether it is the word itself)."""
        node, best, whole = self.root, 0.0, False
        for ch in word:
            node = node.get(ch)
            if node is None:
                return best, whole
            w = node.get("stem")
            if w is not None and w > best:
                best, whole = w, False
        w = node.get("whole")
        return (w, True) if w is not None and w >= best else (best, whole)

    def with_near_letters(self, words: list[str]) -> np.ndarray:
        """WHOLE and STEM bits for what a word may be a misspelling of by its kinds of letters: an edit brings in or takes out one at most."""
        codes, size = coded(words)
        out = np.where([w.isalpha() for w in words], 0, WHOLE | STEM).astype(np.uint8)
        whole_mask = kinds_of(codes)
        for (whole, length), entries in self.letters.items():
            edits, bit = allowed(length, whole, False) // 2, WHOLE if whole else STEM
            rows = np.flatnonzero((out & bit == 0) & ((np.abs(size - length) <= edits) if whole else (size >= length - edits)))
            have = whole_mask if whole else kinds_of(codes[:, : length + edits])
            want = kinds_of(coded(entries)[0])
            for part in np.array_split(rows, 1 + len(rows) * len(want) // PAIRS_AT_ONCE):
                ok = np.bitwise_count(want & ~have[part, None]) <= edits
                if whole:
                    ok &= np.bitwise_count(have[part, None] & ~want) <= edits
                out[part[ok.any(1)]] |= bit
        return out

    def may_be_misspelled(self, word: str, near: int) -> bool:
        """False if misspelled() is 0; near: the word's bits of with_near_letters. Masked words keep two letters of an entry at least."""
        if not word.isalpha():
            return sum(c.isalpha() for c in word) >= 2
        if near & WHOLE and not self.left_words.isdisjoint(without_letters(word, 2 if len(word) >= 6 else 1)):
            return True
        return bool(near & STEM) and any(not self.left_stems.isdisjoint(without_letters(word[:n], 1)) for n in range(7, min(len(word), max(STEMS) + 1) + 1))

    def misspelled(self, word: str) -> float:
        """Largest weight of an entry that the word, or for stems a beginning of the word, is a misspelling of.

        The trie is walked with an automaton that knows swaps of neighbours. An edit or swap costs 2, a letter masked by
        another sign 1; allowed() has what an entry takes.
        """
        odd, best = not word.isalpha(), 0.0
        start = [2 * i for i in range(len(word) + 1)]
        stack = [(self.root, 0, start, start, "")]
        while stack:
            node, depth, row, older, last = stack.pop()
            w = node.get("whole")
            if w is not None and w > best and row[-1] <= allowed(depth, True, odd):
                best = w
            w = node.get("stem")
            if w is not None and w > best and min(row) <= allowed(depth, False, odd):
                best = w
            for ch, child in node.items():
                if len(ch) != 1:
                    continue
                new = [row[0] + 2]
                for i, c in enumerate(word):
                    x = min(new[i] + 2, row[i + 1] + 2, row[i] + (0 if c == ch else 2 if c.isalpha() else 1))
                    if i and last and c == last and word[i - 1] == ch and c != ch:
                        x = min(x, older[i - 1] + 2)
                    new.append(x)
                if min(new) <= 4:
                    stack.append((child, depth + 1, new, row, ch))
        return best


def allowed(letters: int, whole: bool, odd: bool) -> int:
    """What misspellings of an entry may cost: short entries have many neighbours, fewer for a word with other signs in it."""
    if odd:
        return 4 if letters >= 6 else 2 if letters == 5 or (letters == 4 and whole) else -1
    return (4 if letters >= 8 else 2 if letters >= 5 else -1) if whole else (2 if letters >= 8 else -1)


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word, padded with 0, and its length."""
    width = max((len(w) for w in words), default=0) or 1
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width), np.array([len(w) for w in words], np.int64)


def kinds_of(codes: np.ndarray) -> np.ndarray:
    """The kinds of characters in each row as 64 bits."""
    return np.bitwise_or.reduce(np.where(codes > 0, np.uint64(1) << (codes.astype(np.uint64) & np.uint64(63)), np.uint64(0)), axis=1)


def without_letters(word: str, letters: int) -> set[str]:
    """The word, and what is left of it without up to so many letters."""
    out = new = {word}
    for _ in range(letters):
        new = {w[:i] + w[i + 1 :] for w in new for i in range(len(w))}
        out = out | new
    return out


def bare(word: str) -> str:
    return EDGE.sub("", word)


def features(texts: pa.Array, trie: Trie, memory: dict) -> np.ndarray:
    """One row of FEATURES for each text. memory keeps looked-up words between calls."""
    ids, counts, words = word_ids(texts)
    if len(memory) > 1 << 18:
        memory.clear()
    kind = np.zeros(len(words), np.int8)  # 1 stem, 2 word, 3 near a word
    weight = np.zeros(len(words))
    listed = words.to_pylist()
    fresh = [w for w in listed if w not in memory]
    memory.update((w, (x, 2 if whole else 1) if x else (0.0, 0)) for w in fresh for x, whole in [trie.lookup(bare(w))])
    # Misspellings are looked for among words that are no entries: those whose letters, then parts, are near one's.
    unknown = [(w, b) for w in fresh if not memory[w][1] for b in [bare(w)[: trie.reach]] if len(b) >= 4]
    near = trie.with_near_letters([b for _, b in unknown])
    memory.update((w, (x, 3)) for (w, b), ok in zip(unknown, near, strict=True) if ok and trie.may_be_misspelled(b, ok) and (x := trie.misspelled(b)))
    for i, w in enumerate(listed):
        weight[i], kind[i] = memory[w]
    out = np.zeros((len(counts), len(FEATURES)))
    first = np.concatenate(([0], np.cumsum(counts)))
    at = np.flatnonzero(kind[ids] > 0)
    doc = np.searchsorted(first, at, side="right") - 1
    kinds: dict[int, dict[int, float]] = {}
    for p, d in zip(at.tolist(), doc.tolist(), strict=True):
        w = ids[p]
        lo, hi = max(int(first[d]), p - SIDE), min(int(first[d + 1]), p + SIDE + 1)
        said = quotation([listed[j] for j in ids[lo:p]], listed[w], [listed[j] for j in ids[p + 1 : hi]])
        meant = 1 - said
        out[d, 5] += said
        out[d, 0] += meant
        out[d, 2] += meant * (kind[w] == 2)
        out[d, 4] += meant * (kind[w] == 3)
        if meant > 0:  # a kind of word counts as it is meant most
            mine = kinds.setdefault(d, {})
            mine[int(w)] = max(meant, mine.get(int(w), 0.0))
    for d, s in kinds.items():
        out[d, 1] = sum(weight[w] * m for w, m in s.items())
        out[d, 3] = sum(s.values())
        out[d, 10] = max(weight[w] * m for w, m in s.items())
    out[:, 6] = np.minimum(1.0, out[:, 0] / np.maximum(counts, 1) * 20)
    out[:, 7] = np.log1p(counts)
    out[:, 8], out[:, 9] = out[:, 3] > 1, out[:, 3] > 2
    for c in (0, 1, 2, 3, 4, 5):
        out[:, c] = np.log1p(out[:, c])
    return out


def quotation(before: list[str], word: str, after: list[str]) -> float:
    """How much the window says that the word is quoted or reported, from 0 to 1.

    Quotation marks that open before the word and close after it say so in full, one of the two alone a little; a
    reporting word says so the more the closer it stands before. What is said by both adds up.
    """
    opens = word[:1] in QUOTES or any(w[:1] in QUOTES for w in before if w)
    closes = any(w[-1:] in QUOTES for w in (x.rstrip(".,;:!?") for x in [word, *after]) if w)
    marks = 1.0 if opens and closes else ONE_MARK * (opens or closes)
    reports = max((max(0.0, 1.25 - 0.25 * i) for i, w in enumerate(reversed(before), 1) if bare(w) in REPORTING), default=0.0)
    return min(1.0, marks + min(1.0, reports))


def fitted(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, coefficients with the intercept last) of a ridge logistic model, moved to the class share prior."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.append(np.zeros(x.shape[1]), np.log(prior / (1 - prior)))
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    b = np.zeros(z.shape[1])
    keep = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(keep), z.T @ (y - p) - keep * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    share = y.mean()
    b[-1] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return mean, scale, b


def probability(x: np.ndarray, model: tuple) -> np.ndarray:
    mean, scale, b = model
    return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ b[:-1] + b[-1], -30, 30)))


CONTEXT_ROWS = "r long, n long, words binary, size long, toxic binary, clean binary, contexts binary"


def _contexts(ranges: int, block_bytes: int):
    """CONTEXT_ROWS of the distinct (word, neighbours) of about block_bytes of text: for each range its words in order, how many toxic and clean contexts each has, and these by 48 bits."""
    parts = max(LEAST_PARTS, ranges // LEAST_PARTS)

    def read(text: list[pa.Array], toxic: list[np.ndarray]) -> pd.DataFrame:
        ids, counts, words = word_ids(pa.concat_arrays(text))
        h = word_hashes(words)[ids]
        doc = np.repeat(np.arange(len(counts)), counts)
        edge = np.concatenate(([True], doc[1:] != doc[:-1], [True])) if len(ids) else np.ones(1, bool)
        before = np.where(edge[:-1], np.uint64(1), np.concatenate((h[:1], h[:-1])))
        after = np.where(edge[1:], np.uint64(2), np.concatenate((h[1:], h[:1])))
        with np.errstate(over="ignore"):
            ctx = mixed(before * np.uint64(0x9E3779B97F4A7C15) + after) >> np.uint64(16)
        names = pa.array([bare(w) for w in words.to_pylist()], pa.large_string()).dictionary_encode()
        spelled = names.dictionary
        rank = np.empty(len(spelled), np.int64)
        rank[pc.array_sort_indices(spelled).to_numpy()] = np.arange(len(spelled))
        spelled = spelled.take(pc.array_sort_indices(spelled))
        word = rank[names.indices.to_numpy(zero_copy_only=False)][ids] if len(ids) else ids
        has_letter = np.array([bool(INNER.search(w)) for w in spelled.to_pylist()], bool)
        side = np.concatenate(toxic)[doc]
        keep = has_letter[word] if len(ids) else np.zeros(0, bool)
        word, side, ctx = word[keep], side[keep], ctx[keep]
        # A common word's contexts are dealt over parts, so that no range has to hold them all.
        with np.errstate(over="ignore"):
            q = range_of(mixed(word_hashes(spelled)[word] + ctx % np.uint64(parts) * np.uint64(0x51ED27)), ranges).astype(np.int64)
        order = np.lexsort((ctx, side, word, q))
        q, word, side, ctx = q[order], word[order], side[order], ctx[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (word[1:] != word[:-1]) | (side[1:] != side[:-1]) | (ctx[1:] != ctx[:-1])
        q, word, side, ctx = q[new], word[new], side[new], ctx[new]
        first = np.ones(len(q), bool)
        first[1:] = (q[1:] != q[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(first)
        n_toxic = np.add.reduceat(side, at) if len(at) else side
        n_all = np.diff(np.append(at, len(q)))
        listed = spelled.take(pa.array(word[at])).to_pylist()
        ends, cut = slices(q[at], ranges), slices(q, ranges)
        rows = [
            (k, b - a, packed(np.frombuffer("\n".join(listed[a:b]).encode(), np.uint8)), len("\n".join(listed[a:b]).encode()), packed_counts(n_toxic[a:b]), packed_counts(n_all[a:b] - n_toxic[a:b]), six_bytes(ctx[cut[k] : cut[k + 1]]))
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a
        ]
        return pd.DataFrame(rows, columns=["r", "n", "words", "size", "toxic", "clean", "contexts"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, toxic, held = [], [], 0
        for f in frames:
            text.append(pa.array(f["text"], pa.large_string()))
            toxic.append(f["toxic"].to_numpy(np.int64))
            held += text[-1].nbytes
            if held >= block_bytes:
                give_back()
                yield read(text, toxic)
                text, toxic, held = [], [], 0
        if text:
            yield read(text, toxic)

    return run


def _count_contexts(f: pd.DataFrame) -> pd.DataFrame:
    """word, t, c: the distinct toxic and clean contexts of the words of a range."""
    give_back()
    names = pa.array([w for x, n in zip(f["words"], f["size"], strict=True) for w in unpacked(x, np.uint8, n).tobytes().decode().split("\n")], pa.large_string()).dictionary_encode()
    word = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.stack([np.concatenate([unpacked_counts(x, n) for x, n in zip(f[c], f["n"], strict=True)]) for c in ("clean", "toxic")], 1).ravel()
    # Contexts come word by word, clean ones first.
    key = np.repeat(2 * np.repeat(word, 2) + np.tile([0, 1], len(word)), counts)
    ctx = np.concatenate([from_six(x) for x in f["contexts"]])
    order = np.lexsort((ctx, key))
    key, ctx = key[order], ctx[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])
    n = np.bincount(key[new], minlength=2 * len(names.dictionary)).reshape(-1, 2)
    return pd.DataFrame({"word": names.dictionary.to_pylist(), "t": n[:, 1], "c": n[:, 0]})


def learned_lexicon(sample: DataFrame, ranges: int | None = None) -> list[tuple[str, bool, float]]:
    """(text, whole word?, weight) of words and stems from sample(text, toxic). Weights are lower bounds of log odds.

    An entry's contexts are toxic so much more often than all contexts that chance would let in one entry on average: the
    Chernoff bound of its binomial tail is below 1 / (number of words and stems). No count is asked for by itself.
    """
    block_bytes = block_size(sample)
    ranges = ranges or max(LEAST_RANGES, source_bytes(sample) // block_bytes)
    sent = dealt(sample.select("text", "toxic").mapInPandas(_contexts(ranges, block_bytes), CONTEXT_ROWS), "r", ranges)
    seen = sent.groupBy("r").applyInPandas(_count_contexts, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    seen = stored(seen, "toxic-words")
    total = seen.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not total.t or not total.c:
        return []
    stems = seen.select("t", "c", F.explode(F.array(*[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in STEMS])).alias("text")).where("text is not null").groupBy("text").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count("*").alias("forms"))
    odds = F.log((F.col("t") + 0.5) / F.lit(float(total.t))) - F.log((F.col("c") + 0.5) / F.lit(float(total.c)))
    low = odds - 1.64 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    share, n = total.t / (total.t + total.c), F.col("t") + F.col("c")
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * F.lit(p)))).otherwise(0.0)
    words = seen.select(F.col("word").alias("text"), F.lit(True).alias("whole"), "t", low.alias("weight"), (part("t", share) + part("c", 1 - share)).alias("evidence"))
    # A stem of one word is that word.
    stems = stems.where("forms > 1").select("text", F.lit(False).alias("whole"), "t", low.alias("weight"), (part("t", share) + part("c", 1 - share)).alias("evidence"))
    tests = seen.count() + stems.count()
    top = words.unionByName(stems).where((F.col("weight") >= 1.1) & (F.col("evidence") > math.log(max(tests, 1)))).orderBy(F.desc("weight"), F.desc("t"), "text", "whole").limit(ENTRIES).collect()
    return [(r.text, r.whole, float(r.weight)) for r in top]


def fold(column: str) -> Column:
    """crc32 of the id as text, modulo 3; a null id has the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(3)).cast("int")


def likely(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of docs whose id may be in marked, by BITS bits of id hashes, so that a join need not deal out other texts."""
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(BITS))
    bits = marked.select(F.floor(at / 32768).alias("bucket"), (at % 32768).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    names = docs.columns
    met = docs.withColumn("bucket", F.floor(at / 32768)).withColumn("bit", (at % 32768).cast("int")).join(F.broadcast(bits), "bucket")  # BITS / 8 bytes
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)) % 2 == 1).select(*names)


def learned(docs: DataFrame, labels: DataFrame) -> tuple[list, tuple]:
    """(lexicon, model) from labels(doc_id, toxic) whose fold is not 1 and the texts of docs.

    Words are counted over all these rows; the model takes the FIT_TOXIC toxic and FIT_CLEAN clean rows of least id hash,
    at most. Null labels are left out; a row labelled
    twice counts as toxic if one label says so. Equal texts with equal labels are learned from once.
    """
    marked = labels.where("doc_id is not null and toxic is not null").where(fold("doc_id") != 1).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = stored(marked, "toxic-labels")
    shares = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    first = lambda v, n: marked.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = F.broadcast(first(1, FIT_TOXIC).unionByName(first(0, FIT_CLEAN)).withColumnRenamed("doc_id", "labelled"))  # at most FIT_TOXIC + FIT_CLEAN rows
    sample = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("labelled")).select("text", "toxic").where("text is not null")
    sample = stored(sample.dropDuplicates(["text", "toxic"]), "toxic-sample")
    rows = likely(docs.select("doc_id", "text"), marked).join(marked.withColumnRenamed("doc_id", "labelled"), F.col("doc_id") == F.col("labelled")).select("text", "toxic").where("text is not null")
    lexicon = learned_lexicon(rows)

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, memory = Trie(lexicon), {}
        for f in frames:
            give_back()
            x = features(pa.array(f["text"], pa.large_string()), trie, memory)
            yield pd.DataFrame({"y": f["toxic"].astype(float), "x": list(x)})

    known = sample.mapInPandas(measured, "y double, x array<double>").toPandas()
    prior = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1)
    x = np.vstack(known["x"].to_numpy()) if len(known) else np.zeros((0, len(FEATURES)))
    return lexicon, fitted(x, known["y"].to_numpy(float), prior)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text), learning from labels(doc_id, toxic).

    held_out: the crc32 of the id as text is 1 modulo 3; such rows' labels are not used. Only the text is an input of a
    score. Null and empty texts get the score of a text without words. With no toxic or no clean rows to learn from the
    score is the class share. A null doc_id is never held out. Repeated rows get equal scores. An empty table gives no
    rows.
    """
    lexicon, model = learned(docs, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memory = Trie(lexicon), {}
        for batch in (x for whole in batches for x in portions(whole, 1)):
            give_back()
            p = probability(features(batch.column(1), trie, memory), model)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold("doc_id") == 1).alias("held_out"))
    return stored(rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int"), "toxic-scores")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score stays below the threshold, with all their columns."""
    lexicon, model = learned(docs, labels)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memory = Trie(lexicon), {}
        for batch in (x for whole in batches for x in portions(whole, at)):
            give_back()
            yield batch.filter(pa.array(probability(features(batch.column(at), trie, memory), model) < threshold))

    # By number, as names of columns may hold dots.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return stored(plain.mapInArrow(kept, plain.schema), "toxic-kept").toDF(*docs.columns)
