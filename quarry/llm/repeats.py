"""Repeated 50-byte strings across documents, by merging shard Burrows-Wheeler transforms.

1. Blocks of documents are written once, compressed. Every window of 50 bytes has an anchor, the least hash of its
   25-byte substrings, so equal windows have equal anchors, wherever they stand. Consecutive windows with one anchor are
   a run. Blocks send the anchors they hold, and learn which occur in more than one text.
2. Blocks send the runs with such anchors, each distinct string once with the least document that has it. The strings of
   a range of anchors are dealt into shards; each shard gets a suffix array and its Burrows-Wheeler transform; the shards
   are merged by refining their interleave one symbol at a time. Suffixes that are still together after 50 bytes form the
   repeated intervals, and the least document of an interval decides for all its windows. A symbol is five bytes, numbered
   among those of the range, with every fifth start of a string as a string of its own, which takes a fifth of the rounds.
3. Blocks apply the least documents to their runs and cut the covered bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import block_size, blocks_of, byte_table, dealt, give_back, mixed, opened, packed, packed_keys, range_count, range_of, rolling, slices, sliding_min, stored, unpacked, unpacked_keys

#: Bytes of a repeated string; bytes of an anchor; bytes of a symbol (windows are whole numbers of them); symbols of a shard.
WINDOW, ANCHOR, SYMBOL, SHARD_SYMBOLS = 50, 25, 5, 1 << 19
#: An anchor in so many texts sends its windows one by one, to ranges of their own, as its runs could fill a task.
HOT = 1024
CHUNK = 1 << 15
TABLE, MUL = byte_table(3), np.uint64(0x9E3779B97F4A7C15)
EMPTY_ID = -(2**63)


def anchors(raw: np.ndarray) -> np.ndarray:
    """The anchor of the window at each start, whether or not it crosses a document's end."""
    n = len(raw) - WINDOW + 1
    out = np.empty(max(n, 0), np.uint64)
    for a in range(0, n, CHUNK):
        part = TABLE[raw[a : a + CHUNK + WINDOW - 1]]
        out[a : a + CHUNK] = sliding_min(mixed(rolling(part, ANCHOR, MUL)), WINDOW - ANCHOR + 1)
    return out


def runs_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, end of the starts, anchor and document index of every run of the block."""
    n = len(raw) - WINDOW + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z
    m = anchors(raw)
    long_docs = np.flatnonzero(np.diff(off) >= WINDOW)
    first, stop = off[long_docs], off[long_docs + 1] - WINDOW + 1
    edge = np.zeros(n + 1, np.int8)
    edge[first] += 1
    edge[stop] -= 1
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(m[1:], m[:-1], out=new[1:])
    new[first] = True
    new &= valid
    closing = np.zeros(n + 1, bool)
    closing[stop] = True
    marks = np.flatnonzero(new | closing[:-1])
    ends = np.append(marks[1:], n)
    is_start = new[marks]
    s, e = marks[is_start], ends[is_start]
    # Least hashes crowd at the low end; mixed again they spread over the ranges.
    return s, e, mixed(m[s]), np.searchsorted(off, s, side="right") - 1


def text_marks(off: np.ndarray, raw: bytes) -> np.ndarray:
    """Two 64-bit hashes of each text."""
    view = memoryview(raw)
    out = np.empty((len(off) - 1, 2), np.uint64)
    for i in range(len(off) - 1):
        d = xxhash.xxh3_128_intdigest(view[int(off[i]) : int(off[i + 1])])
        out[i] = d & 0xFFFFFFFFFFFFFFFF, d >> 64
    return out


def anchor_pairs(raw: np.ndarray, off: np.ndarray, marks: np.ndarray):
    """The block's runs, and its distinct (anchor, text) pairs by anchor with the pair of each run.

    A text is told by 64 bits: an anchor passes for one of a single text only if all its texts agree in them.
    """
    s, e, key, doc = runs_of(raw, off)
    owner = marks[doc, 0] if len(doc) else np.zeros(0, np.uint64)
    order = np.lexsort((owner, key))
    k, o = key[order], owner[order]
    new = np.ones(len(k), bool)
    if len(k):
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    pair = np.empty(len(k), np.int64)
    pair[order] = np.cumsum(new) - 1
    return s, e, key, doc, k[new], o[new], pair


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of unsigned keys, and where a new key begins in it. Keys are sorted with their places while both fit 64 bits, which takes a fifth of the time of argsort."""
    n = len(keys)
    place = np.uint64(n.bit_length())
    if int(keys.max()).bit_length() + int(place) <= 64:
        both = (keys.astype(np.uint64) << place) | np.arange(n, dtype=np.uint64)
        both.sort()
        order, both = (both & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64), both >> place
    else:
        order = np.argsort(keys, kind="stable")
        both = keys[order]
    new = np.ones(n, bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    return order, new


def suffix_array(sym: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix order of strings laid end to end, each closed by 0; equal suffixes stand in the order of their strings.

    sym: unsigned, with 0 only at the ends; ends: positions of those zeros. Prefix doubling from as many symbols on as a
    key with its place holds.
    """
    n = len(sym)
    left = np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(n)  # symbols before the closing 0
    longest, bits = int(left.max()), max(int(sym.max()).bit_length(), 1)
    depth = max((64 - n.bit_length()) // bits, 1)
    pad = np.concatenate((sym, np.zeros(depth, sym.dtype))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(depth):
        key = (key << np.uint64(bits)) | np.where(left >= i, pad[i : n + i], np.uint64(0))
    while True:
        order, new = ordered(key)
        if depth > longest or new.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new, dtype=np.uint64)
        key = rank << np.uint64(n.bit_length())
        far = np.flatnonzero(left >= depth)
        key[far] |= rank[far + depth]
        depth *= 2


def bwt(sym: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The symbol before each suffix, in suffix order; 0 before a string's first."""
    return np.concatenate((np.zeros(1, sym.dtype), sym[:-1]))[order]


def merged_classes(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> list[np.ndarray]:
    """Class of every position of each shard (sym, suffix order): equal for positions whose next `depth` symbols agree.

    The interleave starts as one shard after the other. A round reads the shards' transforms in the order of the present
    interleave and deals the shard numbers by symbol, which orders the suffixes by one symbol more; a boundary between
    neighbours appears in the round in which their common prefix ends. Closing symbols never match.
    """
    trans = [bwt(sym, order) for sym, order in shards]
    n = sum(map(len, trans))
    every = np.concatenate(trans)
    z = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(t) for t in trans])
    closed = np.repeat(np.arange(len(shards), dtype=np.uint8), [int((sym == 0).sum()) for sym, _ in shards])
    block = np.zeros(n, np.int32)
    for _ in range(depth):
        read = np.empty(n, every.dtype)
        read[np.argsort(z, kind="stable")] = every
        perm, new = ordered(read)
        old = block[perm]
        new[1:] |= old[1:] != old[:-1]
        z = z[perm]
        z[: len(closed)] = closed
        new[: len(closed) + 1] = True
        block = np.cumsum(new[:n], dtype=np.int32)
    out = []
    for j, (sym, order) in enumerate(shards):
        cls = np.empty(len(sym), np.int32)
        cls[order] = block[np.flatnonzero(z == j)]
        out.append(cls)
    return out


def least_docs(data: np.ndarray, lens: np.ndarray, docs: np.ndarray, shard_symbols: int = SHARD_SYMBOLS) -> np.ndarray:
    """For each start of each string (lens - 49 of them, end to end): the least of docs over all strings with its window."""
    starts = lens - WINDOW + 1
    at = np.concatenate(([0], np.cumsum(lens)))[:-1]
    # A string for the starts that leave 0, 1, .. over SYMBOL, in turn, so that a shard holds all of a string.
    count = np.stack([(lens - p) // SYMBOL for p in range(SYMBOL)], 1).ravel()
    begin = (at[:, None] + np.arange(SYMBOL)).ravel()
    total = np.concatenate(([0], np.cumsum(count + 1)))
    n = int(total[-1])
    which = np.repeat(np.arange(len(count)), count + 1)
    step = np.arange(n) - total[which]
    live = np.flatnonzero(step < count[which])
    wide = np.zeros(len(data) - SYMBOL + 1, np.uint64)
    for i in range(SYMBOL):
        wide = (wide << np.uint64(8)) | data[i : len(wide) + i]
    order, new = ordered(wide[begin[which[live]] + SYMBOL * step[live]])
    sym = np.zeros(n, np.uint32)  # the number of each symbol among those that occur
    sym[live[order]] = np.cumsum(new, dtype=np.uint32)
    cuts = np.unique(np.concatenate(([0], np.searchsorted(total, np.arange(shard_symbols, n, max(shard_symbols, -(-n // 200)))), [len(count)])))
    shards = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = sym[total[a] : total[b]]
        shards.append((part, suffix_array(part, total[a + 1 : b + 1] - 1 - total[a])))
    cls = np.concatenate(merged_classes(shards, WINDOW // SYMBOL))
    owner = np.repeat(np.arange(len(lens)), starts)
    j = np.arange(int(starts.sum())) - np.repeat(np.concatenate(([0], np.cumsum(starts)))[:-1], starts)
    mine = cls[total[SYMBOL * owner + j % SYMBOL] + j // SYMBOL]
    low = np.full(int(cls.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, mine, docs[owner])
    return low[mine]


def string_names(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of each string that spans the windows starting in [s, e)."""
    ends = np.zeros((2, len(s)), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            for row, at in zip(ends, (s, e - 1), strict=True):
                row *= MUL
                row += TABLE[raw[at + i]]
        name = mixed(ends[0]) * MUL + ends[1] + (e - s).astype(np.uint64)
    for j in np.flatnonzero(e - s > WINDOW):  # the two windows leave out bytes between them
        name[j] ^= np.uint64(xxhash.xxh3_64_intdigest(raw[s[j] : e[j] + WINDOW - 1].tobytes()))
    return mixed(name)


def pulled(raw: np.ndarray, s: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The bytes of the strings [s, s + lens), end to end."""
    if not len(s):
        return raw[:0]
    shift = s - (np.cumsum(lens) - lens)
    return raw[np.repeat(shift, lens) + np.arange(int(lens.sum()))]


def _send_anchors(ranges: int):
    def send(frames):
        for f in frames:
            for r in f.itertuples():
                give_back()
                ids, off, text = opened(r.doc_ids, r.offsets, r.payload)
                raw = np.frombuffer(text, np.uint8)
                marks = text_marks(off, text)
                _, _, _, _, key, owner, _ = anchor_pairs(raw, off, marks)
                order = np.lexsort((marks[:, 1], marks[:, 0]))
                marks, ids = marks[order], ids[order]
                a, b = slices(range_of(key, ranges), ranges), slices(range_of(marks[:, 0], ranges), ranges)
                rows = [(q, r.block, a[q + 1] - a[q], packed_keys(key[a[q] : a[q + 1]]), owner[a[q] : a[q + 1]].tobytes(), b[q + 1] - b[q], marks[b[q] : b[q + 1]].tobytes(), ids[b[q] : b[q + 1]].tobytes()) for q in range(ranges) if a[q + 1] > a[q] or b[q + 1] > b[q]]
                yield pd.DataFrame(rows, columns=["r", "block", "n", "keys", "owners", "nd", "marks", "ids"])

    return send


ANCHOR_ROWS = "r long, block long, n long, keys binary, owners binary, nd long, marks binary, ids binary"
STATUS_ROWS = "r long, block long, n long, status binary, nd long, least binary, leads binary"


def _judge_anchors(hot: int):
    def judge(f: pd.DataFrame) -> pd.DataFrame:
        give_back()
        f = f.sort_values("block")
        key = np.concatenate([unpacked_keys(k, n) for k, n in zip(f["keys"], f["n"], strict=True)])
        owner = np.concatenate([np.frombuffer(o, np.uint64) for o in f["owners"]])
        order = np.lexsort((owner, key))
        k, o = key[order], owner[order]
        new_key, new_pair = np.ones(len(k), bool), np.ones(len(k), bool)
        if len(k):
            new_key[1:] = k[1:] != k[:-1]
            new_pair[1:] = new_key[1:] | (o[1:] != o[:-1])
        gid = np.cumsum(new_key) - 1
        texts = np.bincount(gid[new_pair]) if len(k) else np.zeros(0, np.int64)
        status = np.empty(len(k), np.uint8)
        status[order] = ((texts > 1).astype(np.uint8) + (texts >= hot))[gid] if len(k) else 0
        marks = np.concatenate([np.frombuffer(m, np.uint64).reshape(-1, 2) for m in f["marks"]])
        ids = np.concatenate([np.frombuffer(i, np.int64) for i in f["ids"]])
        least, leads = np.empty(len(ids), np.int64), np.empty(len(ids), np.uint8)
        if len(ids):
            order = np.lexsort((ids, marks[:, 1], marks[:, 0]))
            m = marks[order]
            new = np.concatenate(([True], (m[1:] != m[:-1]).any(1)))
            least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            leads[order] = new | np.concatenate(([True], ids[order][1:] != ids[order][:-1]))  # the first of equal rows
        a, b = np.concatenate(([0], np.cumsum(f["n"]))), np.concatenate(([0], np.cumsum(f["nd"])))
        rows = [(q, blk, n, packed(status[a[i] : a[i + 1]]), nd, least[b[i] : b[i + 1]].tobytes(), leads[b[i] : b[i + 1]].tobytes()) for i, (q, blk, n, nd) in enumerate(zip(f["r"], f["block"], f["n"], f["nd"], strict=True))]
        return pd.DataFrame(rows, columns=["r", "block", "n", "status", "nd", "least", "leads"])

    return judge


RUN_ROWS = "r long, block long, n long, nb long, keys binary, names binary, lens binary, docs binary, often binary, data binary"


def _send_runs(ranges: int):
    def send(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        give_back()
        cols = ["r", "block", "n", "nb", "keys", "names", "lens", "docs", "often", "data"]
        if not len(left):
            return pd.DataFrame(columns=cols)
        r = left.iloc[0]
        ids, off, text = opened(r["doc_ids"], r["offsets"], r["payload"])
        raw = np.frombuffer(text, np.uint8)
        marks = text_marks(off, text)
        s, e, key, doc, _, _, pair = anchor_pairs(raw, off, marks)
        right = right.sort_values("r")
        status = np.concatenate([unpacked(x, np.uint8, n) for x, n in zip(right["status"], right["n"], strict=True)])
        least, leads = np.empty(len(ids), np.int64), np.empty(len(ids), np.uint8)
        by_mark = np.lexsort((marks[:, 1], marks[:, 0]))
        least[by_mark] = np.concatenate([np.frombuffer(x, np.int64) for x in right["least"]])
        leads[by_mark] = np.concatenate([np.frombuffer(x, np.uint8) for x in right["leads"]])
        first = least == ids
        st = status[pair] if len(pair) else np.zeros(0, np.uint8)
        use = (st == 1) & first[doc]
        hot = np.flatnonzero((st == 2) & first[doc])
        width = e[hot] - s[hot]
        hs = np.repeat(s[hot], width) + np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        # A hot anchor's windows are strings by themselves, keyed by their own bytes.
        us, ue = np.concatenate((s[use], hs)), np.concatenate((e[use], hs + 1))
        name = string_names(raw, us, ue)
        k = np.concatenate((key[use], name[len(name) - len(hs) :]))
        d = np.concatenate((ids[doc[use]], np.repeat(ids[doc[hot]], width)))
        order = np.lexsort((d, name, k))
        kk, nn = k[order], name[order]
        new = np.ones(len(kk), bool)
        if len(kk):
            new[1:] = (kk[1:] != kk[:-1]) | (nn[1:] != nn[:-1])
        at = order[new]
        which = np.cumsum(new) - 1
        often = np.minimum(np.bincount(which), 2).astype(np.uint8) if len(kk) else np.zeros(0, np.uint8)
        uk, lens = k[at], (ue[at] - us[at] + WINDOW - 1).astype(np.int32)
        cut = slices(range_of(uk, ranges), ranges)
        rows = []
        for q in range(ranges):
            a, b = int(cut[q]), int(cut[q + 1])
            if a < b:
                data = pulled(raw, us[at[a:b]], lens[a:b])
                rows.append((q, r["block"], b - a, len(data), packed(uk[a:b]), packed(name[at[a:b]]), packed(lens[a:b]), packed(d[at[a:b]]), packed(often[a:b]), packed(data)))
        # For the block itself: where its runs stand (keys), which string each is (names), which texts are first of
        # their kind and which rows first of equal ones (often).
        rows.append((-1, r["block"], len(order), len(ids), packed(us[order].astype(np.int32)), packed(which.astype(np.int32)), b"", b"", (first + 2 * leads).astype(np.uint8).tobytes(), b""))
        return pd.DataFrame(rows, columns=cols)

    return send


PIECE_ROWS = "r long, block long, n long, m long, names binary, starts binary, lens binary, docs binary"


def _judge_runs(f: pd.DataFrame) -> pd.DataFrame:
    give_back()
    f = f.sort_values("block")
    sizes = f["n"].to_numpy()
    load = lambda col, kind: np.concatenate([unpacked(x, kind, n) for x, n in zip(f[col], sizes, strict=True)])
    key, name, lens, docs, often = load("keys", np.uint64), load("names", np.uint64), load("lens", np.int32).astype(np.int64), load("docs", np.int64), load("often", np.uint8)
    data = np.concatenate([unpacked(x, np.uint8, n) for x, n in zip(f["data"], f["nb"], strict=True)])
    order = np.lexsort((docs, name, key))
    k, nm = key[order], name[order]
    new_key, new = np.ones(len(k), bool), np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new[1:] = new_key[1:] | (nm[1:] != nm[:-1])
    string = np.empty(len(k), np.int64)
    string[order] = np.cumsum(new) - 1
    at = order[new]  # the first row of each string, with its least document
    group = (np.cumsum(new_key) - 1)[new]
    alone = np.bincount(group)[group] == 1
    begin = np.cumsum(lens) - lens
    starts = lens[at] - WINDOW + 1
    low = np.repeat(docs[at], starts)
    several = np.flatnonzero(~alone)
    if len(several):
        rows = at[several]
        low[np.repeat(~alone, starts)] = least_docs(pulled(data, begin[rows], lens[rows]), lens[rows], docs[rows])
    # Stretches of starts with one least document.
    owner = np.repeat(np.arange(len(at)), starts)
    change = np.ones(len(low), bool)
    change[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    p = np.flatnonzero(change)
    p_owner, p_low = owner[p], low[p]
    p_len = np.diff(np.append(p, len(low)))
    p_at = p - (np.cumsum(starts) - starts)[p_owner]
    p_first = np.searchsorted(p_owner, np.arange(len(at) + 1))
    out, a = [], 0
    for q, blk, n in zip(f["r"], f["block"], sizes, strict=True):
        st = string[a : a + n]
        cnt = p_first[st + 1] - p_first[st]
        idx = np.repeat(np.arange(n), cnt)
        piece = np.repeat(p_first[st], cnt) + np.arange(int(cnt.sum())) - np.repeat(np.cumsum(cnt) - cnt, cnt)
        keep = (p_low[piece] < docs[a : a + n][idx]) | (often[a : a + n][idx] > 1)
        idx, piece = idx[keep], piece[keep]
        out.append((q, blk, n, len(idx), packed(idx.astype(np.int32)), packed(p_at[piece].astype(np.int32)), packed(p_len[piece].astype(np.int32)), packed(p_low[piece])))
        a += n
    return pd.DataFrame(out, columns=["r", "block", "n", "m", "names", "starts", "lens", "docs"])


KEPT_ROWS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text_md5 string, kept string"


def _cut(with_text: bool):
    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        give_back()
        cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text_md5", "kept"]
        if not len(left):
            return pd.DataFrame(columns=cols)
        r = left.iloc[0]
        ids, off, text = opened(r["doc_ids"], r["offsets"], r["payload"])
        raw = np.frombuffer(text, np.uint8)
        right = right.sort_values("r")
        own = right.iloc[0]
        n = int(own["n"])
        us, which = unpacked(own["names"], np.int32, n).astype(np.int64), unpacked(own["docs"], np.int32, n).astype(np.int64)
        flags = np.frombuffer(own["lens"], np.uint8)
        first, leads = (flags & 1).astype(bool), flags & 2
        parts = right.iloc[1:]
        base = np.concatenate(([0], np.cumsum(parts["n"].to_numpy(np.int64))))
        load = lambda col, kind: np.concatenate([np.zeros(0, kind), *[unpacked(x, kind, m) for x, m in zip(parts[col], parts["m"], strict=True)]])
        name = load("names", np.int32).astype(np.int64) + np.repeat(base[:-1], parts["m"].to_numpy(np.int64))
        at, length, low = load("starts", np.int32).astype(np.int64), load("lens", np.int32).astype(np.int64), load("docs", np.int64)
        bounds = np.searchsorted(name, np.arange(int(base[-1]) + 1))
        cnt = bounds[which + 1] - bounds[which] if n else np.zeros(0, np.int64)
        occ = np.repeat(np.arange(n), cnt)
        piece = np.repeat(bounds[which], cnt) + np.arange(int(cnt.sum())) - np.repeat(np.cumsum(cnt) - cnt, cnt) if n else np.zeros(0, np.int64)
        doc = np.searchsorted(off, us[occ], side="right") - 1
        gone = low[piece] < ids[doc]
        a = us[occ][gone] + at[piece][gone]
        b = a + length[piece][gone] + WINDOW - 1
        edge = np.zeros(len(raw) + 1, np.int32)
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)
        # A text that a smaller document has in full goes as a whole, if it is as long as a window.
        copies = np.flatnonzero(~first & (np.diff(off) >= WINDOW))
        np.add.at(edge, off[copies], 1)
        np.add.at(edge, off[copies + 1], -1)
        cov = np.cumsum(edge[:-1]) > 0
        rise = cov.copy()
        rise[1:] &= ~cov[:-1]
        heads = off[:-1][np.diff(off) > 0]
        rise[heads] = cov[heads]
        removed = np.concatenate(([0], np.cumsum(cov)))
        spans = np.concatenate(([0], np.cumsum(rise)))
        view, out = memoryview(text), []
        for i in range(len(ids)) if not with_text else np.flatnonzero(leads).tolist():
            x, y = int(off[i]), int(off[i + 1])
            gone_n = int(removed[y] - removed[x])
            kept = bytes(view[x:y]) if not gone_n else (b"" if gone_n == y - x else raw[x:y][~cov[x:y]].tobytes())
            out.append((int(ids[i]), y - x, gone_n, int(spans[y] - spans[x]), hashlib.sha256(kept).hexdigest(), hashlib.md5(view[x:y]).hexdigest() if with_text else None, kept.decode("utf-8", "ignore") if with_text else None))
        return pd.DataFrame(out, columns=cols)

    return cut


def repeats(docs: DataFrame, with_text: bool = False, range_bytes: int | None = None, block_bytes: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs(doc_id, text).

    A byte goes if it lies in a 50-byte string that also starts in a row with a smaller doc_id; strings overlap, lie
    within one text and are judged on the input. with_text adds text_md5 (of the input) and kept, the
    bytes that stay without those of characters that were cut through, and gives equal rows once.
    Null texts are empty. Texts under 50 bytes keep everything. Rows with the same doc_id take nothing from each other; a
    null doc_id comes before all others and is null in the result. Empty tables give no rows. Blocks and ranges hold
    block_size() bytes of text unless told otherwise.
    """
    block_bytes = block_bytes or block_size(docs)
    blocks = stored(blocks_of(docs, block_bytes), "repeat-blocks")
    ranges = range_count(blocks, range_bytes or block_bytes)
    status = stored(dealt(blocks.mapInPandas(_send_anchors(ranges), ANCHOR_ROWS), "r", ranges).groupBy("r").applyInPandas(_judge_anchors(hot), STATUS_ROWS), "repeat-status")
    runs = stored(dealt(blocks, "block", ranges).groupBy("block").cogroup(dealt(status, "block", ranges).groupBy("block")).applyInPandas(_send_runs(ranges), RUN_ROWS), "repeat-runs", status)
    pieces = stored(dealt(runs.where("r >= 0"), "r", ranges).groupBy("r").applyInPandas(_judge_runs, PIECE_ROWS), "repeat-pieces")
    own = runs.where("r < 0").select("r", "block", "n", F.col("nb").alias("m"), F.col("keys").alias("names"), F.lit(b"").alias("starts"), F.col("often").alias("lens"), F.col("names").alias("docs"))
    own = stored(own, "repeat-places", runs)
    out = dealt(blocks, "block", ranges).groupBy("block").cogroup(dealt(own.unionByName(pieces), "block", ranges).groupBy("block")).applyInPandas(_cut(with_text), KEPT_ROWS)
    out = out.withColumn("doc_id", F.when(F.col("doc_id") != EMPTY_ID, F.col("doc_id")))
    return stored(out if with_text else out.drop("text_md5", "kept"), "repeat-rows", blocks, own, pieces)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated bytes cut from text (null becomes empty), and n_chars, if there is one, counted again."""
    cut = repeats(docs, with_text=True, **options).select(F.struct("doc_id", "text_md5").alias("k"), "kept")
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"))
    names = docs.columns
    left = docs.select(key.alias("k"), F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row"))
    both = left.alias("l").join(cut.alias("r"), F.col("l.k").eqNullSafe(F.col("r.k")))
    new = {"text": F.col("r.kept"), "n_chars": F.length("r.kept").cast(docs.schema["n_chars"].dataType if "n_chars" in names else "long")}
    return both.select(*[new.get(c, F.col(f"l.row.`{c}`")).alias(c) for c in names])
