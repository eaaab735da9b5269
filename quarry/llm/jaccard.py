"""Set-similarity join of word shingles: T-occurrence search over inverted lists, with DivideSkip.

Texts with equal shingle sets are one class from the start. Blocks send their shingles to ranges and learn in how many
texts each occurs, so that all texts put their shingles in one order, rare ones first. Two sets similar enough share one
of their first few shingles and have few others before it (prefix and position filter). Ranges hold the inverted lists of
these prefixes and chain what can belong together, one edge for each member, never all pairs. The connected families are
small; each is searched by itself, in slices if it is large: a class asks the inverted lists of its family, the short
lists are merged, the long ones are only probed for classes that can still reach the overlap, and those that reach it
are links. For groups alone what is connected already is not looked for again; for link counts every partner is.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD_PATTERN, block_size, block_texts, blocks_of, dealt, discard, from_six, give_back, mixed, opened, packed, packed_counts, packed_keys, range_count, range_of, six_bytes, slices, stored, unpacked, unpacked_counts, unpacked_keys, word_hashes, word_ids
from quarry.llm.components import connected_components, forest
from quarry.llm.topk import slotted

#: Classes in one side of a search; share of DivideSkip; size merged by a heap.
SLICE, SKIP_SHARE, HEAP_SIZE = 512, 0.1, 512
PAIR = ["family", "slot", "sub", "slot2", "sub2"]
STEP = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(16)
EMPTY_ID = -(2**63)


def shingle_sets(off: np.ndarray, raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of all texts, distinct and ascending within each; bounds of the texts). Short texts have one shingle."""
    ids, counts, words = word_ids(block_texts(off, raw))
    hashes = word_hashes(words)[ids] if len(ids) else np.zeros(0, np.uint64)
    first = np.concatenate(([0], np.cumsum(counts)))
    with np.errstate(over="ignore"):
        h = hashes[: max(0, len(hashes) - width + 1)] + np.uint64(width)
        for i in range(1, width):
            h = h * STEP + hashes[i : i + len(h)]
        doc = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
        at = np.arange(len(doc)) - np.repeat(np.concatenate(([0], np.cumsum(np.maximum(counts - width + 1, 0))))[:-1], np.maximum(counts - width + 1, 0)) + first[doc]
        h = mixed(h[at])
        few = np.flatnonzero((counts > 0) & (counts < width))
        short = np.zeros(len(few), np.uint64)
        for k, d in enumerate(few):
            v = np.uint64(int(counts[d]))
            for x in hashes[first[d] : first[d + 1]]:
                v = v * STEP + x
            short[k] = v
    h, doc = np.concatenate((h, mixed(short))), np.concatenate((doc, few))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(counts) + 1))


def class_ids(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, equal for equal sets; 0 for empty ones."""
    with np.errstate(over="ignore"):
        one = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(sets), dtype=np.uint64)))
        two = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(sets ^ STEP), dtype=np.uint64)))
        a, b = one[bounds[1:]] - one[bounds[:-1]], two[bounds[1:]] - two[bounds[:-1]]
        out = mixed(mixed(a) * STEP + b + np.diff(bounds).astype(np.uint64))
    out[np.diff(bounds) == 0] = 0
    return out


def least_overlap(na: np.ndarray, nb: np.ndarray, pct: int) -> np.ndarray:
    """Smallest intersection of sets of these sizes with 100 * intersection >= pct * union."""
    return -(-(pct * (na + nb)) // (100 + pct))


def text_keys(off: np.ndarray, raw: bytes) -> bytes:
    """16 bytes for each text, end to end."""
    view = memoryview(raw)
    return b"".join(hashlib.md5(view[int(a) : int(b)]).digest() for a, b in zip(off[:-1], off[1:], strict=True))


COUNT_ROWS = "r long, block long, n long, keys binary, times binary"
RANK_ROWS = "r long, block long, n long, ranks binary"


def _send_shingles(width: int, ranges: int):
    def send(frames):
        for f in frames:
            for r in f.itertuples():
                give_back()
                _, off, raw = opened(r.doc_ids, r.offsets, r.payload)
                keys, times = np.unique(shingle_sets(off, raw, width)[0], return_counts=True)
                cut = slices(range_of(keys, ranges), ranges)
                rows = [(q, r.block, cut[q + 1] - cut[q], packed_keys(keys[cut[q] : cut[q + 1]]), packed_counts(times[cut[q] : cut[q + 1]])) for q in range(ranges) if cut[q + 1] > cut[q]]
                yield pd.DataFrame(rows, columns=["r", "block", "n", "keys", "times"])

    return send


def _rank_shingles(f: pd.DataFrame) -> pd.DataFrame:
    """For each block's shingles the power of two below the number of texts that have them."""
    give_back()
    f = f.sort_values("block")
    key = np.concatenate([unpacked_keys(k, n) for k, n in zip(f["keys"], f["n"], strict=True)])
    times = np.concatenate([unpacked_counts(x, n) for x, n in zip(f["times"], f["n"], strict=True)])
    _, inverse = np.unique(key, return_inverse=True)
    total = np.bincount(inverse, weights=times)
    rank = (np.frexp(total)[1] - 1).astype(np.uint8)[inverse]
    at = np.concatenate(([0], np.cumsum(f["n"])))
    rows = [(q, b, n, packed(rank[at[i] : at[i + 1]])) for i, (q, b, n) in enumerate(zip(f["r"], f["block"], f["n"], strict=True))]
    return pd.DataFrame(rows, columns=["r", "block", "n", "ranks"])


POSTING_ROWS = "r long, block long, n long, keys binary, nodes binary, sizes binary, places binary, docs binary"


def ordered_prefixes(sets: np.ndarray, bounds: np.ndarray, rank: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, place) of each text's prefix in the order of rank, then hash. Texts that no other can match send none."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((sets, rank, doc))
    sets, doc = sets[order], doc[order]
    place = np.arange(len(sets)) - bounds[doc]
    width = n - (pct * n + 99) // 100 + 1
    width[100 * n < pct * (n + 1)] = 0
    keep = place < width[doc]
    return sets[keep], doc[keep], place[keep]


def _send_prefixes(width: int, ranges: int, pct: int):
    """Prefix postings by range, and a row of range -1 that describes the block's texts."""
    cols = ["r", "block", "n", "keys", "nodes", "sizes", "places", "docs"]

    def send(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        give_back()
        if not len(left):
            return pd.DataFrame(columns=cols)
        r = left.iloc[0]
        ids, off, raw = opened(r["doc_ids"], r["offsets"], r["payload"])
        sets, bounds = shingle_sets(off, raw, width)
        right = right.sort_values("r")
        ranks = np.concatenate([np.zeros(0, np.uint8), *[unpacked(x, np.uint8, n) for x, n in zip(right["ranks"], right["n"], strict=True)]])
        node, size = class_ids(sets, bounds), np.diff(bounds).astype(np.int64)
        rows = [(-1, r["block"], len(ids), ids.tobytes(), node.tobytes(), size.tobytes(), b"", text_keys(off, raw))]
        rank = ranks[np.unique(sets, return_inverse=True)[1]] if len(sets) else ranks
        keys, doc, place = ordered_prefixes(sets, bounds, rank, pct)
        own = np.zeros(len(node), bool)
        own[np.unique(node, return_index=True)[1]] = True
        keep = own[doc]
        # Hashes lead the order within a rank; mixed again they spread over the ranges.
        keys, doc, place = mixed(keys[keep]), doc[keep], place[keep]
        order = np.argsort(keys, kind="stable")
        keys, doc, place = keys[order], doc[order], place[order]
        cut = slices(range_of(keys, ranges), ranges)
        for q in range(ranges):
            a, b = cut[q], cut[q + 1]
            if a < b:
                d = doc[a:b]
                rows.append((q, r["block"], b - a, keys[a:b].tobytes(), node[d].tobytes(), packed(size[d]), packed(place[a:b].astype(np.int64)), packed(d.astype(np.int64))))
        return pd.DataFrame(rows, columns=cols)

    return send


EDGE_ROWS = "a long, ablock long, adoc long, b long, bblock long, bdoc long"


def _chain(pct: int):
    """Edges that connect, within each inverted list, all pairs that sizes and places allow.

    A member x at place p can share at most size - p shingles, so its partners are no larger than most(x). Of a pair the
    smaller has most >= its own size (it is strong). Strong members follow each other by size; between two that can pair,
    neighbours differ little enough to be joined. Any other member hangs on the largest strong one that it can pair with.
    """

    def chain(f: pd.DataFrame) -> pd.DataFrame:
        give_back()
        load = lambda c: np.concatenate([unpacked(x, np.int64, n) for x, n in zip(f[c], f["n"], strict=True)])
        key = np.concatenate([np.frombuffer(k, np.uint64) for k in f["keys"]])
        node = np.concatenate([np.frombuffer(k, np.uint64) for k in f["nodes"]])
        size, place, doc = load("sizes"), load("places"), load("docs")
        block = np.repeat(f["block"].to_numpy(np.int64), f["n"].to_numpy())
        order = np.lexsort((doc, block, node, size, key))
        key, node, size, place, block, doc = key[order], node[order], size[order], place[order], block[order], doc[order]
        one = np.ones(len(key), bool)
        one[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, size, place, block, doc = key[one], node[one], size[one], place[one], block[one], doc[one]
        gid = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1 if len(key) else np.zeros(0, np.int64)
        most = (100 + pct) * (size - place) // pct - size
        strong = np.flatnonzero(most >= size)
        x, y = strong[:-1], strong[1:]
        ok = (gid[x] == gid[y]) & (100 * size[x] >= pct * size[y])
        x, y = x[ok], y[ok]
        weak = np.flatnonzero(most < size)
        span = int(size.max(initial=0)) + 2
        at = np.searchsorted(gid[strong] * span + size[strong], gid[weak] * span + np.maximum(most[weak], 0), side="right") - 1
        near = strong[np.maximum(at, 0)] if len(strong) else weak
        ok = (at >= 0) & (gid[near] == gid[weak]) & (100 * size[near] >= pct * size[weak])
        x, y = np.concatenate((x, near[ok])), np.concatenate((y, weak[ok]))
        a = node.view(np.int64)
        rows = pd.DataFrame({"a": a[x], "ablock": block[x], "adoc": doc[x], "b": a[y], "bblock": block[y], "bdoc": doc[y]})
        return rows.drop_duplicates(["a", "b"])

    return chain


SET_ROWS = "node long, n long, items binary"


def _fetch_sets(width: int):
    def fetch(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        give_back()
        rows = []
        if len(left) and len(right):
            r = left.iloc[0]
            _, off, raw = opened(r["doc_ids"], r["offsets"], r["payload"])
            docs = right["doc"].to_numpy()
            lens = (off[1:] - off[:-1])[docs]
            part = b"".join(raw[int(off[d]) : int(off[d + 1])] for d in docs)
            sets, bounds = shingle_sets(np.concatenate(([0], np.cumsum(lens))), part, width)
            rows = [(int(node), int(b - a), six_bytes(sets[a:b] >> SHIFT)) for node, a, b in zip(right["node"], bounds[:-1], bounds[1:], strict=True)]
        return pd.DataFrame(rows, columns=["node", "n", "items"])

    return fetch


class Lists:
    """Inverted lists of sets: for each item the ascending positions of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.lexsort((owner, flat))
        self.item, self.owner = flat[order], owner[order]

    def of(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the lists of the query's items that are not empty."""
        a, b = np.searchsorted(self.item, query), np.searchsorted(self.item, query, side="right")
        return a[b > a], b[b > a]

    def reaching(self, query: np.ndarray, need: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """Positions whose number of lists among the query's reaches need[position]; of the wanted ones only, if given.

        The longest lists, fewer than the least need, are set aside. The others are merged, by a heap if they are short;
        a position that comes up often enough to reach its need with all long lists is looked up in these by binary search.
        """
        a, b = self.of(query)
        if not len(a):
            return np.zeros(0, np.int64)
        order = np.argsort(b - a, kind="stable")
        a, b = a[order], b[order]
        least, most = int(need.min()), int((b - a)[-1])
        aside = min(len(a), max(0, least - 1), int(least / (SKIP_SHARE * np.log2(most + 1) + 1)))
        cut = len(a) - aside
        length = (b - a)[:cut]
        if int(length.sum()) <= HEAP_SIZE:
            count = Counter(heapq.merge(*[self.owner[x:y].tolist() for x, y in zip(a[:cut], b[:cut], strict=True)]))
            seen, times = np.fromiter(count.keys(), np.int64, len(count)), np.fromiter(count.values(), np.int64, len(count))
        else:
            at = np.repeat(a[:cut] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
            times = np.bincount(self.owner[at], minlength=len(need))
            seen = np.flatnonzero(times)
            times = times[seen]
        keep = times + aside >= need[seen]
        if wanted is not None:
            keep &= wanted[seen]
        seen, times = seen[keep], times[keep]
        for k, (x, y) in enumerate(zip(a[cut:], b[cut:], strict=True)):
            if not len(seen):
                break
            at = x + np.searchsorted(self.owner[x:y], seen)
            times += (at < y) & (self.owner[np.minimum(at, y - 1)] == seen)
            keep = times + (aside - k - 1) >= need[seen]
            seen, times = seen[keep], times[keep]
        return np.sort(seen[times >= need[seen]])


def family_links(left: list[np.ndarray], right: list[np.ndarray], lnode: np.ndarray, rnode: np.ndarray, pct: int) -> list[tuple[int, int]]:
    """A forest of the links between sets of two slices: what is connected already is not looked for again."""
    lists, out = Lists(right), []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for q, me in zip(left, lnode.tolist(), strict=True):
        mine = find(me)
        other = np.array([find(x) != mine for x in rnode.tolist()]) if len(root) > 1 else np.ones(len(rnode), bool)
        other &= rnode != me
        if not other.any():
            continue
        for i in lists.reaching(q, least_overlap(np.full(len(right), len(q)), lists.size, pct), other):
            a, b = find(me), find(int(rnode[i]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((me, int(rnode[i])))
    return out


def counted_links(left: list[np.ndarray], right: list[np.ndarray], lnode: np.ndarray, rnode: np.ndarray, lcopies: np.ndarray, rcopies: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All links between sets of two slices: a forest of them (both ends), and for each set of a side the copies of its partners."""
    lists = Lists(right)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lcount, rcount = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    for k, q in enumerate(left):
        at = lists.reaching(q, least_overlap(np.full(len(right), len(q)), lists.size, pct))
        at = at[rnode[at] != lnode[k]]
        lcount[k] = rcopies[at].sum()
        rcount[at] += lcopies[k]
        a.append(np.full(len(at), lnode[k]))
        b.append(rnode[at])
    return *forest(np.concatenate(a), np.concatenate(b)), lcount, rcount


def _count(pct: int):
    """Rows (a, b, null) of a forest of the links, and (a, null, rows that the class a links with in the other slice)."""

    def count(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node")
        left, right = f[f["lhs"]], f[f["rhs"]]
        cols = ["a", "b", "n"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=cols)
        lnode, rnode = left["node"].to_numpy(), right["node"].to_numpy()
        a, b, lcount, rcount = counted_links([from_six(x) for x in left["items"]], [from_six(x) for x in right["items"]], lnode, rnode, left["copies"].to_numpy(), right["copies"].to_numpy(), pct)
        # A slice that meets itself has asked for all its classes.
        nodes, counts = (lnode, lcount) if f["lhs"].all() and f["rhs"].all() else (np.concatenate((lnode, rnode)), np.concatenate((lcount, rcount)))
        links = pd.DataFrame({"a": a, "b": b, "n": None}, dtype="Int64")
        return pd.concat((links, pd.DataFrame({"a": nodes, "b": None, "n": counts}, dtype="Int64")))[cols]

    return count


def _search(pct: int):
    def search(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node")
        left, right = f[f["lhs"]], f[f["rhs"]]
        out = []
        if len(left) and len(right):
            out = family_links([from_six(x) for x in left["items"]], [from_six(x) for x in right["items"]], left["node"].to_numpy(), right["node"].to_numpy(), pct)
        return pd.DataFrame(out, columns=["a", "b"])

    return search


def grouped(docs: DataFrame, width: int = 3, pct: int = 90, range_bytes: int | None = None, block_bytes: int | None = None, count: bool = False) -> DataFrame:
    """doc_id, text_md5, n_shingles, group, component_id (and n_links if count) for every row of docs(doc_id, text).

    group: the component's own number, 0 without words. n_links: the other rows that the row links with, copies included. A text's set is its distinct shingles of `width` words after lower-casing A-Z; with fewer words the whole sequence is
    the one shingle. Rows link when 100 * intersection >= pct * union; component_id is the smallest doc_id that links
    reach. Texts without words, and null texts, have an empty set and link with nothing: component_id = doc_id. Rows with
    equal sets are linked. A null doc_id is a row like others, comes before all ids, and is given as null. Sets are told
    apart by 64-bit hashes and compared by 48 bits of each shingle's hash. Empty tables give no rows.
    """
    block_bytes = block_bytes or block_size(docs)
    blocks = stored(blocks_of(docs, block_bytes), "jaccard-blocks")
    ranges = range_count(blocks, range_bytes or block_bytes)
    ranks = dealt(blocks.mapInPandas(_send_shingles(width, ranges), COUNT_ROWS), "r", ranges).groupBy("r").applyInPandas(_rank_shingles, RANK_ROWS)
    ranks = stored(ranks, "jaccard-ranks")
    sent = stored(dealt(blocks, "block", ranges).groupBy("block").cogroup(dealt(ranks, "block", ranges).groupBy("block")).applyInPandas(_send_prefixes(width, ranges, pct), POSTING_ROWS), "jaccard-prefixes")
    discard(ranks)
    meta = sent.where("r < 0")
    edges = stored(dealt(sent.where("r >= 0"), "r", ranges).groupBy("r").applyInPandas(_chain(pct), EDGE_ROWS), "jaccard-edges")
    families = connected_components(edges.select("a", "b")).withColumnRenamed("component", "family")
    ends = edges.select(F.col("a").alias("node"), F.struct(F.col("ablock").alias("block"), F.col("adoc").alias("doc")).alias("at")).unionByName(edges.select(F.col("b").alias("node"), F.struct(F.col("bblock").alias("block"), F.col("bdoc").alias("doc")).alias("at")))
    wanted = ends.groupBy("node").agg(F.min("at").alias("at")).select("node", "at.block", "at.doc")
    sets = stored(dealt(blocks, "block", ranges).groupBy("block").cogroup(dealt(wanted, "block", ranges).groupBy("block")).applyInPandas(_fetch_sets(width), SET_ROWS), "jaccard-items")
    # Families of more than SLICE classes are cut by the size of the sets, and slices meet where sizes allow links.
    sized = families.join(sets.select("node", "n"), "node")
    large = sized.groupBy("family").agg(F.count("*").alias("classes")).where(F.col("classes") > SLICE).select("family")
    large = stored(large, "jaccard-large")
    cut = slotted(sized.join(large, "family", "left_semi"), ["family"], "n", SLICE, "node").unionByName(sized.join(large, "family", "left_anti").select("*", F.lit(0).alias("slot"), F.lit(0).alias("sub")))
    cut = stored(cut, "jaccard-slices", large)
    slices_ = cut.groupBy("family", "slot", "sub").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = slices_.select("family", F.col("slot").alias("slot2"), F.col("sub").alias("sub2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    may = (F.struct("slot", "sub") <= F.struct("slot2", "sub2")) & (100 * F.col("high") >= pct * F.col("low2")) & (100 * F.col("high2") >= pct * F.col("low"))
    pairs = stored(slices_.join(other, "family").where(may).select(*PAIR), "jaccard-pairs")
    own = (F.col("slot") == F.col("slot2")) & (F.col("sub") == F.col("sub2"))
    first = cut.join(pairs, ["family", "slot", "sub"]).select("node", *PAIR, F.lit(True).alias("lhs"), own.alias("rhs"))
    second = cut.withColumnsRenamed({"slot": "slot2", "sub": "sub2"}).join(pairs.where(~own), ["family", "slot2", "sub2"]).select("node", *PAIR, F.lit(False).alias("lhs"), F.lit(True).alias("rhs"))
    met = first.unionByName(second)

    def rows_of(frames):
        for f in frames:
            for r in f.itertuples():
                yield pd.DataFrame({"doc_id": np.frombuffer(r.keys, np.int64), "text_md5": [r.docs[i : i + 16].hex() for i in range(0, len(r.docs), 16)], "n_shingles": np.frombuffer(r.sizes, np.int64), "node": np.frombuffer(r.nodes, np.uint64).view(np.int64)})

    rows = stored(meta.select("keys", "nodes", "sizes", "docs").mapInPandas(rows_of, "doc_id long, text_md5 string, n_shingles long, node long"), "jaccard-rows")
    discard(sent)
    copies = rows.where("n_shingles > 0").groupBy("node").agg(F.count("*").alias("copies"))
    asked = met.join(sets.select("node", "items"), "node")
    if count:
        found = stored(dealt(asked.join(copies, "node"), PAIR, ranges).groupBy(*PAIR).applyInPandas(_count(pct), "a long, b long, n long"), "jaccard-links")
        links = found.where("b is not null").select("a", "b")
    else:
        links = dealt(asked, PAIR, ranges).groupBy(*PAIR).applyInPandas(_search(pct), "a long, b long")
    comps = connected_components(links)
    discard(blocks, sets, edges, cut, pairs)
    least = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    member = least.join(comps, "node", "left").select("node", "least", F.coalesce("component", "node").alias("group"))
    member = stored(member, "jaccard-members")
    smallest = member.groupBy("group").agg(F.min("least").alias("component_id"))
    named = stored(member.join(smallest, "group").select("node", "group", "component_id"), "jaccard-named", member)
    done, more = [rows, named], []
    if count:
        others = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
        totals = copies.join(others, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("total"))
        named = named.join(totals, "node")
        done.append(found)
        more = [F.coalesce(F.when(F.col("n_shingles") > 0, F.col("total")), F.lit(0)).alias("n_links")]
    has = F.col("n_shingles") > 0
    out = rows.join(named, "node", "left").select("doc_id", "text_md5", "n_shingles", *more, F.coalesce(F.when(has, F.col("group")), F.lit(0)).alias("group"), F.coalesce(F.when(has, F.col("component_id")), F.col("doc_id")).alias("component_id"))
    return stored(out, "jaccard-result", *done)


def real_id(column: str):
    return F.when(F.col(column) != EMPTY_ID, F.col(column)).alias(column)


def similar_sets(docs: DataFrame, width: int = 3, pct: int = 90, **options) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text); see grouped for the cases."""
    return grouped(docs, width, pct, **options).select(real_id("doc_id"), "n_shingles", real_id("component_id"))


def linked_sets(docs: DataFrame, width: int = 3, pct: int = 90, **options) -> DataFrame:
    """doc_id, n_shingles, n_links, component_id for every row of docs(doc_id, text), every link found; see grouped."""
    return grouped(docs, width, pct, count=True, **options).select(real_id("doc_id"), "n_shingles", "n_links", real_id("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, pct: int = 80, **options) -> DataFrame:
    """docs with one row of each group, of the least doc_id and then the least text_md5; texts without words all stay.

    Of rows equal in doc_id and text, which may differ in other columns, any one stays.
    """
    rows = grouped(docs, width, pct, **options).where("doc_id = component_id and group <> 0")
    keep = rows.groupBy("group").agg(F.min(F.struct("doc_id", "text_md5")).alias("k")).select("k")
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(EMPTY_ID)).alias("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"))
    names = docs.columns
    says = F.coalesce(F.regexp_like("text", F.lit(WORD_PATTERN)), F.lit(False))
    # Equal rows become one before they are dealt out.
    single = docs.where(says).groupBy(key.alias("k")).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in names])).alias("row"))
    return single.join(keep, "k", "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in names]).unionByName(docs.where(~says))
