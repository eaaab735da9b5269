"""Language-model scores from a weighted backoff automaton over the corpus.

The states are the n-gram contexts seen in training, the empty context included. A state has an arc for each word seen
after it, weighted by the smoothed probability, and a failure arc to its longest proper suffix, weighted by the mass it
leaves to unseen words. Reading a text from left to right, the automaton takes the word's arc, or failure arcs until a
state has one; the state after a word is the longest suffix that is a context.

The automaton of the corpus is never in one place. Blocks of documents send the n-grams they hold, sorted by a hash and
cut into ranges; a range adds up the training counts and answers each block with the counts of its n-grams. From these a
block builds the part of the automaton that its own texts can reach, states, arcs and failure arcs, and runs them through
it: many stretches of text at a time, one token of each in a step. A stretch that begins within a text is read from the
tokens before it that a state can hold, so that it begins in the state that the whole text would be in.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import block_size, block_texts, blocks_of, dealt, give_back, mixed, opened, packed_counts, packed_keys, packed_totals, range_count, range_of, slices, stored, unpacked_counts, unpacked_keys, unpacked_totals, word_hashes, word_ids

#: Power-of-two classes of counts kept about the words; tokens in a stretch of text; bits of a longer n-gram's hash left out.
CLASSES, STRETCH, LEFT_OUT = 64, 256, np.uint64(8)
END, START = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
STEP = np.uint64(0x9E3779B97F4A7C15)
EMPTY_ID = -(2**63)


def is_held_out(doc_id: int, folds: int = 10) -> bool:
    """crc32 of the id as text, modulo folds, is 0; a null id has the empty text."""
    return zlib.crc32(b"" if doc_id == EMPTY_ID else str(doc_id).encode()) % folds == 0


def sequences(off: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens with a start before and an end after each text, place in the text, and text of each."""
    ids, counts, words = word_ids(block_texts(off, raw))
    hashes = word_hashes(words)
    first = np.concatenate(([0], np.cumsum(counts + 2)))
    seq = np.empty(int(first[-1]), np.uint64)
    doc = np.repeat(np.arange(len(counts)), counts + 2)
    place = np.arange(len(seq)) - first[doc]
    seq[first[:-1]] = START
    seq[first[1:] - 1] = END
    seq[(place > 0) & (place <= counts[doc])] = hashes[ids]
    return seq, place, doc


def grams(seq: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length: the hash of the n-gram that ends at each token (of use where place >= length - 1)."""
    out = [seq]
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            before = np.concatenate((np.zeros(1, np.uint64), out[-1][:-1]))
            out.append(mixed(before * STEP + seq + np.uint64(n)))
    return out


class Level:
    """The distinct n-grams of one length that predict a token of a block: keys in order, one place of each, and the n-gram that ends at each token (-1: none)."""

    def __init__(self, keys: np.ndarray, place: np.ndarray, n: int):
        at = np.flatnonzero(place >= max(1, n - 1))
        # One in 10^4 of 10^13 n-grams shares 56 bits with another; words keep all 64.
        cut = LEFT_OUT if n > 1 else np.uint64(0)
        short, first, inverse = np.unique(keys[at] >> cut, return_index=True, return_inverse=True)
        self.keys, self.at, self.id = short << cut, at[first], np.full(len(keys), -1, np.int64)
        self.id[at] = inverse
        self.shift = cut


COUNT_ROWS = "r long, block long, level int, n long, keys binary, counts binary"
ANSWER_ROWS = "r long, block long, level int, n long, counts binary, stats array<double>"


def _send(order: int, ranges: int, folds: int):
    def send(frames):
        for f in frames:
            for r in f.itertuples():
                give_back()
                ids, off, raw = opened(r.doc_ids, r.offsets, r.payload)
                seq, place, doc = sequences(off, raw)
                train = np.array([not is_held_out(int(i), folds) for i in ids], bool)[doc]
                for n, keys in enumerate(grams(seq, place, order), 1):
                    level = Level(keys, place, n)
                    counts = np.bincount(level.id[train & (level.id >= 0)], minlength=len(level.keys))
                    cut = slices(range_of(level.keys, ranges), ranges)
                    rows = [(q, r.block, n, b - a, packed_keys(level.keys[a:b] >> level.shift), packed_counts(counts[a:b])) for q, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                    yield pd.DataFrame(rows, columns=["r", "block", "level", "n", "keys", "counts"])

    return send


def _add_up(f: pd.DataFrame) -> pd.DataFrame:
    """Total of each block's n-grams, and what smoothing needs to know: types, tokens, types seen once and twice, tokens by count."""
    give_back()
    out = []
    for level, g in f.sort_values(["level", "block"]).groupby("level"):
        keys = np.concatenate([unpacked_keys(k, n) for k, n in zip(g["keys"], g["n"], strict=True)])
        counts = np.concatenate([unpacked_counts(c, n) for c, n in zip(g["counts"], g["n"], strict=True)])
        distinct, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
        seen = total[total > 0]
        stats = np.zeros(4 + CLASSES)
        stats[:4] = len(seen), seen.sum(), (seen == 1).sum(), (seen == 2).sum()
        np.add.at(stats, 4 + np.frexp(seen)[1].astype(int) - 1, seen.astype(float))
        answer, a = total[inverse], 0
        for q, blk, n in zip(g["r"], g["block"], g["n"], strict=True):
            out.append((q, blk, level, n, packed_totals(answer[a : a + n]), None))
            a += n
        out.append((int(g["r"].iloc[0]), -1, level, 0, b"", stats.tolist()))
    return pd.DataFrame(out, columns=["r", "block", "level", "n", "counts", "stats"])


def escape_mass(mu: float, by_count: np.ndarray) -> float:
    """Mean mass that contexts leave to failure arcs, over the training tokens by class of their context's count."""
    mean = 0.75 * 2.0 ** np.arange(1, CLASSES + 1)
    return float((by_count * mu / (mean + mu)).sum() / max(by_count.sum(), 1.0))


def fitted(stats: dict[int, np.ndarray], order: int) -> dict:
    """Smoothing from the corpus: the mass of unknown words, and the weight of each order's failure arcs.

    Words lose the share of one count that the types seen once and twice suggest (n1 / (n1 + 2 n2)). A context with count
    c leaves mu / (c + mu) to its failure arc; mu makes the mean of that the share of n-grams seen once (Good-Turing).
    """
    words = stats.get(1, np.zeros(4 + CLASSES))
    model = {"types": words[0], "tokens": words[1], "discount": min(0.95, max(0.05, words[2] / max(1.0, words[2] + 2 * words[3]))), "mu": {}}
    for n in range(2, order + 1):
        want = stats[n][2] / max(1.0, stats[n][1]) if n in stats else 1.0
        below = stats[n - 1][4:] if n - 1 in stats else np.zeros(CLASSES)
        low, high = -5.0, 12.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if escape_mass(10.0**mid, below) < want else (low, mid)
        model["mu"][n] = 10.0**high
    return model


def word_mass(count: np.ndarray, model: dict) -> np.ndarray:
    """Probability in the empty context; all unknown words are one type."""
    if not model["types"]:
        return np.ones(len(count))
    d, n = model["discount"], model["tokens"]
    return np.where(count > 0, (count - d) / n, d * model["types"] / n)


class Automaton:
    """The states, arcs and failure arcs that a block's texts can reach.

    State 0 is the empty context, state 1 the start of a text; then come the words, then the longer n-grams that were seen
    in training. An arc belongs to an n-gram that was seen: from the state of all its words but the last, by the last, to
    the state of the n-gram, or of its longest suffix that can be a state. Its weight carries the mass of the suffixes too,
    so that the probabilities of a state sum to 1.
    """

    def __init__(self, levels: list[Level], totals: list[np.ndarray], place: np.ndarray, model: dict, trained: int):
        order, self.words = len(levels), len(levels[0].keys)
        # base[n]: the state of the first n-gram; state_of[n]: the state of each, -1 for those never seen.
        base = [0, 2]
        for t in totals[:-1]:
            base.append(base[-1] + len(t))
        state_of = [np.where(t > 0, base[n] + np.arange(len(t)), -1) for n, t in enumerate(totals[:-1], 1)]
        size = base[order]
        self.fail, self.fail_weight = np.zeros(size, np.int64), np.ones(size)
        self.start = 1 if trained > 0 and order > 1 else 0
        self.order, self.p_unknown = order, float(word_mass(np.zeros(1, np.int64), model)[0])
        escape = lambda n, count: model["mu"][n] / (count + model["mu"][n])
        if order > 1:
            self.fail_weight[1] = escape(2, trained)
        keys, weights, ends, below = [], [], [], word_mass(totals[0], model)
        for n, (level, total) in enumerate(zip(levels, totals, strict=True), 1):
            at, seen = level.at, total > 0
            word = levels[0].id[at]
            if n == 1:
                source, p = np.zeros(len(at), np.int64), below
            else:
                head = levels[n - 2].id[at - 1]  # the words before the last; the start of a text is no n-gram
                source = np.where(head >= 0, state_of[n - 2][head], 1 if n == 2 else -1)
                count = np.where(head >= 0, totals[n - 2][head], trained if n == 2 else 0)
                suffix = levels[n - 2].id[at]
                p = np.where(seen, total / (count + model["mu"][n]) + escape(n, count) * below[suffix], 0.0)
            if n < order:
                end = state_of[n - 1]
                s, suffix_state = state_of[n - 1][seen], (state_of[n - 2][levels[n - 2].id[at]] if n > 1 else np.zeros(len(at), np.int64))
                self.fail[s], self.fail_weight[s] = suffix_state[seen], escape(n + 1, total[seen])
            else:
                end = state_of[n - 2][levels[n - 2].id[at]] if n > 1 else np.zeros(len(at), np.int64)
            keys.append((source * self.words + word)[seen])
            weights.append(p[seen])
            ends.append(end[seen])
            below = p
        keys = np.concatenate(keys)
        by_key = np.argsort(keys)
        self.arcs, self.weight, self.end = keys[by_key], np.log10(np.concatenate(weights)[by_key]), np.concatenate(ends)[by_key]
        with np.errstate(divide="ignore"):
            self.fail_weight = np.log10(self.fail_weight)
        self.log_unknown = np.log10(self.p_unknown)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of the word, state after it) for each pair of a state and a word."""
        log, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        live, s = np.arange(len(state)), state
        for _ in range(self.order):
            want = s * self.words + word[live]
            at = np.minimum(np.searchsorted(self.arcs, want), max(len(self.arcs) - 1, 0))
            taken = self.arcs[at] == want if len(self.arcs) else np.zeros(len(s), bool)
            log[live[taken]] += self.weight[at[taken]]
            after[live[taken]] = self.end[at[taken]]
            live, s = live[~taken], s[~taken]
            lost = s == 0  # the empty context has no arc: a word never seen
            log[live[lost]] += self.log_unknown
            live, s = live[~lost], s[~lost]
            if not len(live):
                break
            log[live] += self.fail_weight[s]
            s = self.fail[s]
        return log, after

    def read(self, word: np.ndarray, place: np.ndarray, stretch: int) -> np.ndarray:
        """log10 probability of each token of the texts (0 at their starts): stretches side by side, each from left to right."""
        out = np.zeros(len(word))
        begin = np.flatnonzero((place > 0) & ((place - 1) % stretch == 0))
        follows = np.append(np.flatnonzero(place == 0)[1:], len(word))
        text = np.cumsum(place == 0) - 1
        stop = np.minimum(begin + stretch, follows[text[begin]])
        ahead = np.minimum(place[begin] - 1, self.order - 1)  # tokens to read before the first that counts
        at = begin - ahead
        state = np.where(place[at] == 1, self.start, 0)
        by_length = np.argsort(at - stop)  # the longest first, so that those still running stand in front
        at, begin, stop, state = at[by_length], begin[by_length], stop[by_length], state[by_length]
        length = stop - at
        for k in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -k))
            now = at[:n] + k
            log, state[:n] = self.step(state[:n], word[now])
            counts = now >= begin[:n]
            out[now[counts]] = log[counts]
        return out


SCORE_ROWS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, folds: int, model: dict, stretch: int):
    cols = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        give_back()
        if not len(left):
            return pd.DataFrame(columns=cols)
        r = left.iloc[0]
        ids, off, raw = opened(r["doc_ids"], r["offsets"], r["payload"])
        seq, place, doc = sequences(off, raw)
        right = right.sort_values(["level", "r"])
        levels, totals = [], []
        for n, keys in enumerate(grams(seq, place, order), 1):
            part = right[right["level"] == n]
            levels.append(Level(keys, place, n))
            totals.append(np.concatenate([np.zeros(0, np.int64), *[unpacked_totals(c, m) for c, m in zip(part["counts"], part["n"], strict=True)]]))
        word = levels[0].id
        trained = int(totals[0][word[np.flatnonzero(seq == END)[0]]])
        logs = Automaton(levels, totals, place, model, trained).read(word, place, stretch)
        ends = place > 0
        count = np.where(ends, totals[0][word], 0)
        n_all, v = model["tokens"], model["types"]
        base = np.log10((count + 0.1) / (n_all + 0.1 * (v + 1)))
        said = doc[ends]
        add = lambda x: np.bincount(said, weights=x[ends], minlength=len(ids))
        return pd.DataFrame(
            {"doc_id": ids, "held_out": [is_held_out(int(i), folds) for i in ids], "n_tokens": np.bincount(said, minlength=len(ids)), "n_known": add(count > 0).astype(np.int64), "train_tokens": int(n_all), "base_score": add(base), "score": add(logs)},
            columns=cols,
        )

    return score


def scores(docs: DataFrame, order: int = 3, folds: int = 10, block_bytes: int | None = None, range_bytes: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs(doc_id, text).

    Learns from the rows whose crc32(doc_id as text) mod folds is not 0 and scores all. Tokens are the words after
    lower-casing A-Z and one end per text; null and empty texts have the end alone. base_score: unigrams with 0.1 added.
    score: log10 probability under the backoff automaton of n-grams up to `order`. A null doc_id is held out. Repeated
    rows count as often as they occur. Without training rows every token has probability 1 under both. Empty tables give
    no rows. Blocks and ranges hold block_size() bytes of text unless told otherwise.
    """
    block_bytes = block_bytes or block_size(docs)
    blocks = stored(blocks_of(docs, block_bytes), "score-blocks")
    ranges = range_count(blocks, range_bytes or block_bytes)
    answers = stored(dealt(blocks.mapInPandas(_send(order, ranges, folds), COUNT_ROWS), "r", ranges).groupBy("r").applyInPandas(_add_up, ANSWER_ROWS), "score-counts")
    sums = answers.where("block < 0").select("level", F.posexplode("stats").alias("i", "x")).groupBy("level", "i").agg(F.sum("x").alias("x")).collect()
    stats = {n: np.zeros(4 + CLASSES) for n in {r.level for r in sums}}
    for r in sums:
        stats[r.level][r.i] = r.x
    out = dealt(blocks, "block", ranges).groupBy("block").cogroup(dealt(answers.where("block >= 0"), "block", ranges).groupBy("block")).applyInPandas(_score(order, folds, fitted(stats, order), stretch), SCORE_ROWS)
    return stored(out.withColumn("doc_id", F.when(F.col("doc_id") != EMPTY_ID, F.col("doc_id"))), "score-rows", blocks, answers)
