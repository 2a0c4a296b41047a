"""Maximal repeats of the whole corpus by common-prefix interval trees.

A repeat is a run of at least L = `min_words` words that occurs at two places or
more.  It is maximal if its occurrences can't all be extended by one more word
to the left, nor to the right.  maximal_repeats() lists all occurrences of each;
in a family of copies these grow with its square.  repeat_places() has the same
repeats as a tree, where an occurrence is a row of the longest repeat there only.

The suffix array is built in parts, each of which holds all suffixes that start
with the same L words; no repeat is lost, since its occurrences share these.
Which suffixes can start a maximal repeat at all is found first:

1. *Anchors.*  In every window of L words the 25-word gram (half of L) with the
   lowest hash is an anchor.  Equal passages have equal anchors, so anchors are
   counted over the whole corpus instead of all grams, about one word in 13.
2. *Left context.*  A window's anchor is at most 25 words after the window's
   start.  If all occurrences of an anchor follow the same 26 words, extension to
   the left doesn't diverge at any window that has this anchor, so no maximal
   repeat starts with one.  Other anchors are open.
3. Only windows whose anchor is open are candidates.  Those whose L words occur
   elsewhere, after different words, are suffixes of the array.  A suffix ends
   where an anchor that occurs once rules out a longer repeat.
   Parts with the same lowest text are built by one task, which gets the words of
   each text once, however many of its suffixes are in them; where they are very
   large, as in families of copies, by several.
4. *Interval tree.*  Each part is sorted, common prefixes of neighbours are
   measured (runs of words are compared by hash, so no suffix is copied), and a stack scan visits the intervals of the tree.  An interval of
   length L or more with two different words (or a text's start) on the left is a
   maximal repeat, and its suffixes are all its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore
from .cluster import docs_of, dropped, partitions, stored

U64 = np.uint64
MIN_WORDS = 50
TOP = U64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i:i+width] for each i that has so many."""
    span = 1
    while span * 2 <= width:
        x = op(x[:-span], x[span:])
        span *= 2
    return op(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class _Text:
    """Word hashes of a batch of texts, gram hashes of any length, and anchors."""

    def __init__(self, column, least: int):
        w = textcore.split_words(column)
        self.first, self.words = w.first, w.hashes()
        self.docs = w.docs()
        self.up, self.down = textcore._WORDS.get(len(self.words) + 1)
        self.total = np.zeros(len(self.words) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(self.words * self.up[: len(self.words)], out=self.total[1:])
        self.least, self.k = least, max(1, least // 2)
        self.window = least - self.k + 1

    def gram(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words start to end - 1."""
        with np.errstate(over="ignore"):
            return textcore.mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U64))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Position and hash of every anchor, in order."""
        n = len(self.words)
        self.low = np.zeros(0, U64)
        if n < self.least:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        i = np.arange(n - self.k + 1)
        x = self.gram(i, i + self.k) >> U64(1)
        low = _sliding(x, self.window, np.minimum)
        low = self.low = np.where(self.docs[: len(low)] == self.docs[self.least - 1 :], low, U64(0))
        pad = np.zeros(self.window - 1, U64)
        high = _sliding(np.concatenate([pad, low, pad]), self.window, np.maximum)
        at = np.flatnonzero((high == x) & (x > 0))
        at = at[self.docs[at] == self.docs[at + self.k - 1]]
        return at, x[at]


def _anchor_rows(least: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0

        def flush():
            h, link, doc, pos = (np.concatenate(x) for x in zip(*kept))
            b = (h % U64(buckets)).astype(np.uint16)
            order = np.argsort(b, kind="stable")
            edge = np.searchsorted(b[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(edge))
            h, link, doc, pos = h[order], link[order], doc[order], pos[order]
            cut = lambda x: pa.array([x[edge[i] : edge[i + 1]].tobytes() for i in used], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), cut(h), cut(link), cut(doc), cut(pos)], ["bucket", "h", "link", "doc", "pos"])

        for batch in batches:
            for b in textcore.pieces(batch, "text"):
                t = _Text(b.column("text"), least)
                at, h = t.anchors()
                if not len(at):
                    continue
                doc = t.docs[at]
                link = np.zeros(len(at), np.uint32)
                far = at - t.first[doc] >= t.window
                link[far] = (t.gram(at[far] - t.window, at[far]) >> U64(32)).astype(np.uint32) | np.uint32(1)
                kept.append((h, link, np.asarray(b.column("doc_id"), np.int64)[doc], (at - t.first[doc]).astype(np.uint32)))
                n += len(at)
                if n > 400_000:
                    yield flush()
                    kept, n = [], 0
        if kept:
            yield flush()

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Anchors of one bucket that occur again: by document, their positions, and 1 for those that are open."""
    col = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    h, link, doc, pos = col("h", U64), col("link", np.uint32), col("doc", np.int64), col("pos", np.uint32)
    order = np.argsort(h)
    h, link = h[order], link[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    n = np.diff(np.append(begin, len(h)))
    if not len(h):
        return pa.table({"doc_id": pa.array([], pa.int64()), "pos": pa.array([], pa.binary()), "open": pa.array([], pa.binary()), "any": pa.array([], pa.bool_())})
    lo, hi = np.minimum.reduceat(link, begin), np.maximum.reduceat(link, begin)
    open_ = np.repeat((lo != hi) | (lo == 0), n)
    keep = np.repeat(n > 1, n)
    doc, pos, open_ = doc[order][keep], pos[order][keep], open_[keep].astype(np.uint8)
    order = np.argsort(doc, kind="stable")
    doc, pos, open_ = doc[order], pos[order], open_[order]
    edge = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64), len(doc))
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())
    return pa.table({"doc_id": pa.array(doc[edge[:-1]] if len(doc) else doc, pa.int64()), "pos": cut(pos), "open": cut(open_), "any": pa.array([bool(open_[a:b].any()) for a, b in zip(edge[:-1], edge[1:])], pa.bool_())})


CANDIDATES = (("part", np.uint64), ("left", np.uint32), ("doc", np.int64), ("start", np.uint32), ("stop", np.uint32))


def _candidates(least: int, buckets: int):
    """Windows whose anchor is open, packed by bucket of their hash: hash, word on the left, text, first word, limit of a suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n_kept = [], 0

        def flush():
            cols = [np.concatenate(x) for x in zip(*kept)]
            b = (cols[0] % U64(buckets)).astype(np.uint16)
            order = np.argsort(b, kind="stable")
            edge = np.searchsorted(b[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(edge))
            cols = [c[order].astype(k) for c, (_, k) in zip(cols, CANDIDATES)]
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array([c[edge[i] : edge[i + 1]].tobytes() for i in used], pa.binary()) for c in cols)], ["bucket", *(n for n, _ in CANDIDATES)])

        for batch in batches:
            for b in textcore.pieces(batch, "text"):
                t = _Text(b.column("text"), least)
                at, x = t.anchors()
                doc = t.docs[at]
                ids = np.asarray(b.column("doc_id"), np.int64)
                edge = np.searchsorted(doc, np.arange(len(ids) + 1))
                for i, (pos, open_) in enumerate(zip(b.column("pos").to_pylist(), b.column("open").to_pylist())):
                    own, base, stop = at[edge[i] : edge[i + 1]], t.first[i], t.first[i + 1]
                    p = np.frombuffer(b"".join(pos), np.uint32).astype(np.int64) + base
                    again = np.isin(own, p)
                    j = np.flatnonzero(np.isin(own, p[np.frombuffer(b"".join(open_), np.uint8) > 0]))
                    if not len(j):
                        continue
                    low = np.maximum(own[j] - t.window + 1, base)
                    n = own[j] - low + 1
                    start = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    anchor = np.repeat(x[edge[i] : edge[i + 1]][j], n)
                    ok = start + least <= stop
                    start, anchor = start[ok], anchor[ok]
                    start = np.unique(start[t.low[start] == anchor])
                    once = own[~again]
                    end = np.full(len(start), stop)
                    if len(once):
                        nxt = np.searchsorted(once, start + t.window - 1)
                        end = np.minimum(stop, np.where(nxt < len(once), once[np.minimum(nxt, len(once) - 1)] + least - 1, stop))
                    ok = end - start >= least
                    start, end = start[ok], end[ok]
                    left = np.where(start > base, (t.words[np.maximum(start - 1, 0)] >> U64(32)) | U64(1), U64(0))
                    kept.append((t.gram(start, start + least), left, np.full(len(start), ids[i]), start - base, end - base))
                    n_kept += len(start)
                    if n_kept > 200_000:
                        yield flush()
                        kept, n_kept = [], 0
        if kept:
            yield flush()

    return run


SUFFIXES = "doc_id bigint, lead bigint, shard int, part bigint, left int, start int, stop int"

#: Words behind the suffixes of one part from which the parts of its lead are spread over several tasks.
SHARD_WORDS = 1_000_000


def _diverse(table: pa.Table) -> pa.Table:
    """Candidates of one bucket whose words occur again after other words; lead: the lowest text that has them.

    A part with very many words behind it goes to one of several shards of its
    lead, so that a family of copies isn't built by one task.
    """
    cols = {n: np.frombuffer(b"".join(table.column(n).to_pylist()), k) for n, k in CANDIDATES}
    order = np.lexsort((cols["start"], cols["doc"], cols["part"]))
    cols = {n: c[order] for n, c in cols.items()}
    part, doc, start = cols["part"], cols["doc"], cols["start"]
    if len(part):
        fresh = np.concatenate([[True], (part[1:] != part[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (cols["left"][1:] != cols["left"][:-1])])
        cols = {n: c[fresh] for n, c in cols.items()}
        part, left = cols["part"], cols["left"]
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        n = np.diff(np.append(begin, len(part)))
        lo, hi = np.minimum.reduceat(left, begin), np.maximum.reduceat(left, begin)
        keep = np.repeat((n > 1) & ((lo != hi) | (lo == 0)), n)
        cols["lead"] = np.repeat(np.minimum.reduceat(cols["doc"], begin), n)
        behind = np.add.reduceat((cols["stop"] - cols["start"]).astype(np.int64), begin)
        cols["shard"] = np.repeat(((part[begin] >> U64(16)) % (1 + behind // SHARD_WORDS).astype(U64)).astype(np.int32), n)
        cols = {n: c[keep] for n, c in cols.items()}
    else:
        cols["lead"], cols["shard"] = cols["doc"], cols["start"].astype(np.int32)
    return pa.table({"doc_id": cols["doc"], "lead": cols["lead"], "shard": cols["shard"], "part": cols["part"].view(np.int64), "left": cols["left"].view(np.int32), "start": cols["start"].astype(np.int32), "stop": cols["stop"].astype(np.int32)})


SEGMENTS = "lead bigint, shard int, doc_id bigint, first int, words binary, suffixes binary"
SUFFIX = np.dtype([("part", "<i8"), ("left", "<i4"), ("start", "<i4"), ("stop", "<i4")])


def _segments(least: int):
    """By text, lead and shard: the words that its suffixes cover, once, and the suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in textcore.pieces(batch, "text"):
                t = _Text(b.column("text"), least)
                lists = b.column("suffixes")
                flat = lists.flatten()
                field = lambda name: np.asarray(flat.field(name))  # noqa: E731, B023
                who = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
                x = np.zeros(len(flat), SUFFIX)
                for k in SUFFIX.names:
                    x[k] = field(k)
                lead, shard = field("lead"), field("shard")
                base, n = t.first[:-1][who], np.diff(t.first)[who]
                x["stop"] = np.minimum(x["stop"], n)
                # of rows that share a doc_id, a suffix belongs to those that have its words
                own = np.flatnonzero(x["start"].astype(np.int64) + least <= x["stop"])
                at = base[own] + x["start"][own]
                own = own[t.gram(at, at + least).view(np.int64) == x["part"][own]]
                own = own[np.lexsort((x["start"][own], x["part"][own], shard[own], lead[own], who[own]))]
                x, who, lead, shard = x[own], who[own], lead[own], shard[own]
                fresh = np.ones(len(x), bool)
                fresh[1:] = (who[1:] != who[:-1]) | (lead[1:] != lead[:-1]) | (shard[1:] != shard[:-1])
                edge = np.append(np.flatnonzero(fresh), len(x))
                first, ids = t.first.tolist(), b.column("doc_id").to_pylist()
                out = ([], [], [], [], [], [])
                for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    lo, hi, d = int(x["start"][i:j].min()), int(x["stop"][i:j].max()), int(who[i])
                    for c, v in zip(out, (int(lead[i]), int(shard[i]), ids[d], lo, t.words[first[d] + lo : first[d] + hi].tobytes(), x[i:j].tobytes())):
                        c.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["lead", "shard", "doc_id", "first", "words", "suffixes"])

    return run


class _Runs:
    """Words in one array, and comparison of runs of them by hash."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.total = np.zeros(len(words) + 1, U64)
        up, self.down = textcore._WORDS.get(len(words) + 1)
        with np.errstate(over="ignore"):
            np.cumsum(words * up[: len(words)], out=self.total[1:])

    def hash(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.total[at + n] - self.total[at]) * self.down[at]

    def common(self, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that the runs at a and at b have in common: at least `known`, at most `most`."""
        lo, hi = known.copy(), most.copy()
        while len(go := np.flatnonzero(lo < hi)):
            mid = (lo[go] + hi[go] + 1) >> 1
            same = self.hash(a[go], mid) == self.hash(b[go], mid)
            lo[go[same]] = mid[same]
            hi[go[~same]] = mid[~same] - 1
        return lo


def suffix_array(runs: _Runs, at: np.ndarray, end: np.ndarray, part: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at..end, part by part, and what each has in common with the one before (0 at a part's first).

    All suffixes of a part start with the same `least` words.  They are sorted by
    quicksort with longest common prefixes: each is compared with its group's
    middle one; those with the same prefix in common, on the same side, are the
    next groups.  No suffix is copied.
    """
    order = np.argsort(part, kind="stable")
    n, far = len(order), np.int64(1) << 40
    if not n:
        return order, np.zeros(0, np.int64)
    size = end - at
    fresh = np.ones(n, bool)
    fresh[1:] = part[order[1:]] != part[order[:-1]]
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    first_of_part = fresh.copy()
    known = np.full(n, least, np.int64)
    active = np.arange(n)
    alone = fresh & np.append(fresh[1:], True)
    active = active[~alone]
    while len(active):
        begin = group[active]
        edge = np.flatnonzero(np.concatenate([[True], begin[1:] != begin[:-1]]))
        many = np.diff(np.append(edge, len(active)))
        i, p = order[active], np.repeat(order[active[edge + many // 2]], many)
        a, b = at[i], at[p]
        c = runs.common(a, b, known[active], np.minimum(size[i], size[p]))
        over_i, over_p = c == size[i], c == size[p]
        last = len(runs.words) - 1
        less = over_i | (~over_p & (runs.words[np.minimum(a + c, last)] < runs.words[np.minimum(b + c, last)]))
        side = np.where(over_i & over_p, far, np.where(less, c, 2 * far - c))
        turn = np.lexsort((side, begin))
        side, begin, c = side[turn], begin[turn], c[turn]
        order[active] = i[turn]
        known[active] = c
        fresh = np.ones(len(active), bool)
        fresh[1:] = (begin[1:] != begin[:-1]) | (side[1:] != side[:-1])
        group[active] = active[np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))]
        done = (fresh & np.append(fresh[1:], True)) | (side == far)
        active = active[~done]
    lcp = np.zeros(n, np.int64)
    j = np.flatnonzero(~first_of_part)
    x, y = order[j - 1], order[j]
    lcp[j] = runs.common(at[x], at[y], np.full(len(j), least, np.int64), np.minimum(size[x], size[y]))
    return order, lcp


def maximal_intervals(lcp: np.ndarray, left: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the intervals of sorted suffixes, with what is on their left, that are maximal repeats.

    lcp: what each suffix has in common with the one before.
    left: one number for each word, or 0 for the start of a text, which differs from everything.
    """
    n = len(lcp)
    change = np.zeros(n + 1, np.int64)  # differences of left from the row before, summed: an interval is diverse if any is inside it
    if n > 1:
        change[1:n] = np.cumsum((left[1:] != left[:-1]) | (left[1:] == 0))
    changes, heights = change.tolist(), [*lcp.tolist(), 0]
    out, stack = [], [(0, 0)]
    for i in range(1, n + 1):
        begin, height = i - 1, heights[i]
        while stack and stack[-1][0] > height:
            length, begin = stack.pop()
            if length >= least and changes[i - 1] > changes[begin]:
                out.append((length, begin, i - 1))
        if not stack or stack[-1][0] < height:
            stack.append((height, begin))
    return out


REPEATS = "repeat_id bigint, n_words int, n_occurrences int, doc_ids array<bigint>, starts array<int>"
SUFFIXES_AT_ONCE, OCCURRENCES_AT_ONCE = 200_000, 200_000


def _occurrences(runs: _Runs, at: np.ndarray, doc: np.ndarray, start: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of REPEATS for intervals of sorted suffixes, a bounded number of occurrences in each batch."""
    n = found[:, 2] - found[:, 1] + 1
    total = np.concatenate([[0], np.cumsum(n)])
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + OCCURRENCES_AT_ONCE, side="right")) - 1)
        k = n[lo:hi]
        who = np.repeat(np.arange(hi - lo), k)
        i = np.repeat(found[lo:hi, 1] - (total[lo:hi] - total[lo]), k) + np.arange(len(who))
        i = i[np.lexsort((start[i], doc[i], who))]
        edge = pa.array((total[lo : hi + 1] - total[lo]).astype(np.int32))
        with np.errstate(over="ignore"):
            key = textcore.mix(runs.hash(at[found[lo:hi, 1]], found[lo:hi, 0]) + found[lo:hi, 0].astype(U64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(found[lo:hi, 0].astype(np.int32)), pa.array(k.astype(np.int32)), pa.ListArray.from_arrays(edge, pa.array(doc[i])), pa.ListArray.from_arrays(edge, pa.array(start[i]))],
            ["repeat_id", "n_words", "n_occurrences", "doc_ids", "starts"],
        )
        lo = hi


PLACES = "repeat_id bigint, parent_id bigint, n_words int, n_occurrences int, doc_id bigint, start int"


def _nested(found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest other interval around each of the nested intervals found, and around each of n places the smallest of all; -1 where there is none."""
    parent, owner = np.full(len(found), -1, np.int64), np.full(n, -1, np.int64)
    order = np.lexsort((-found[:, 2], found[:, 1]))
    stack, at = [], 0
    for k, first, last in zip(order.tolist(), found[order, 1].tolist(), found[order, 2].tolist()):
        while stack and stack[-1][1] < first:
            j, end = stack.pop()
            owner[at : end + 1] = j
            at = max(at, end + 1)
        if stack:
            parent[k] = stack[-1][0]
            owner[at:first] = parent[k]
        at = first
        stack.append((k, last))
    while stack:
        j, end = stack.pop()
        owner[at : end + 1] = j
        at = max(at, end + 1)
    return parent, owner


def _places(runs: _Runs, at: np.ndarray, doc: np.ndarray, start: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of PLACES for intervals of sorted suffixes, a bounded number in each batch."""
    parent, owner = _nested(found, len(at))
    with np.errstate(over="ignore"):
        key = textcore.mix(runs.hash(at[found[:, 1]], found[:, 0]) + found[:, 0].astype(U64)).view(np.int64)
    i = np.flatnonzero(owner >= 0)
    bare = np.setdiff1d(np.arange(len(found)), owner[i])
    i, who = np.concatenate([i, found[bare, 1]]), np.concatenate([owner[i], bare])
    for lo in range(0, len(i), OCCURRENCES_AT_ONCE):
        k, w = i[lo : lo + OCCURRENCES_AT_ONCE], who[lo : lo + OCCURRENCES_AT_ONCE]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[w]), pa.array(key[parent[w]], mask=parent[w] < 0), pa.array(found[w, 0].astype(np.int32)), pa.array((found[w, 2] - found[w, 1] + 1).astype(np.int32)), pa.array(doc[k]), pa.array(start[k].astype(np.int32))],
            ["repeat_id", "parent_id", "n_words", "n_occurrences", "doc_id", "start"],
        )


def _tree(least: int, rows_of=_occurrences):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, firsts, words, packed = [], [], [], []
        for b in batches:
            docs += b.column("doc_id").to_pylist()
            firsts += b.column("first").to_pylist()
            words += [np.frombuffer(x.as_buffer(), U64) for x in b.column("words")]
            packed += [np.frombuffer(x.as_buffer(), SUFFIX) for x in b.column("suffixes")]
        base = np.cumsum([0] + [len(w) for w in words])[:-1]
        n = [len(x) for x in packed]
        runs, every = _Runs(np.concatenate(words)), np.concatenate(packed)
        del words, packed
        doc, base = np.repeat(np.array(docs, np.int64), n), np.repeat(base - np.array(firsts), n)
        order = np.lexsort((every["start"], doc, every["part"]))
        every, doc, base = every[order], doc[order], base[order]
        fresh = np.ones(len(every), bool)
        fresh[1:] = (every["part"][1:] != every["part"][:-1]) | (doc[1:] != doc[:-1]) | (every["start"][1:] != every["start"][:-1])
        every, doc, base = every[fresh], doc[fresh], base[fresh]
        edge = np.append(np.flatnonzero(np.concatenate([[True], every["part"][1:] != every["part"][:-1]])), len(every))
        i = 0
        while i < len(edge) - 1:
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + SUFFIXES_AT_ONCE, side="right")) - 1)
            x, d, at = every[edge[i] : edge[j]], doc[edge[i] : edge[j]], base[edge[i] : edge[j]]
            end, at = at + x["stop"], at + x["start"]
            sa, lcp = suffix_array(runs, at, end, x["part"], least)
            found = np.array(maximal_intervals(lcp, x["left"][sa], least), np.int64).reshape(-1, 3)
            yield from rows_of(runs, at[sa], d[sa], x["start"][sa], found)
            i = j

    return run


def maximal_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All maximal repeats of at least min_words words: repeat_id, n_words, n_occurrences, doc_ids, starts.

    doc_ids and starts are parallel lists: an occurrence is the text and the
    number of its word (from 0) where the repeat starts; a text with several
    occurrences is listed with each.  docs: doc_id, text; other columns aren't
    used.  Rows with a null doc_id or text, and texts of fewer than min_words
    words, have no occurrence.  Rows that share a doc_id are searched each; an
    occurrence at the same place of both counts once.  An empty table has no repeats.
    """
    return _segments_of(docs, min_words).applyInArrow(_tree(min_words), REPEATS)


def repeat_places(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The repeats and occurrences of maximal_repeats() as trees: repeat_id, parent_id, n_words, n_occurrences, doc_id, start.

    A repeat's parent is the longest shorter repeat that it starts with, if any;
    each occurrence of a repeat is one of its parent's as well.  A place (text, and
    number of its word) where repeats start is one row, of the longest of them; a
    repeat that is nowhere the longest has one row, with one of its occurrences.
    So the occurrences of a repeat are the distinct places of its own rows and those of
    the repeats below it, n_occurrences in all, and rows grow with the corpus.
    """
    return _segments_of(docs, min_words).applyInArrow(_tree(min_words, _places), PLACES)


def _segments_of(docs: DataFrame, min_words: int):
    """Rows of SEGMENTS by lead and shard: each group has whole parts of the suffix array."""
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    docs = docs_of(docs).filter("doc_id is not null and text is not null")
    nb = min(65_535, partitions(docs.sparkSession))
    anchors = docs.mapInArrow(_anchor_rows(min_words, nb), "bucket int, h binary, link binary, doc binary, pos binary")
    again = stored(anchors.groupBy("bucket").applyInArrow(_repeated, "doc_id bigint, pos binary, open binary, any boolean"))
    by_doc = again.groupBy("doc_id").agg(F.collect_list("pos").alias("pos"), F.collect_list("open").alias("open"), F.max("any").alias("any")).filter("any").drop("any")
    some = stored(docs.join(by_doc.hint("merge"), "doc_id"))
    dropped(again)
    packed = some.mapInArrow(_candidates(min_words, nb), "bucket int, " + ", ".join(f"{n} binary" for n, _ in CANDIDATES))
    suffixes = packed.groupBy("bucket").applyInArrow(_diverse, SUFFIXES)
    by_doc = stored(suffixes.groupBy("doc_id").agg(F.collect_list(F.struct("lead", "shard", "part", "left", "start", "stop")).alias("suffixes")))
    segments = some.select("doc_id", "text").join(by_doc.hint("merge"), "doc_id").mapInArrow(_segments(min_words), SEGMENTS)
    return segments.groupBy("lead", "shard")
