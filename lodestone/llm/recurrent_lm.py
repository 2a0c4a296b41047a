"""Language-model scoring with a gated recurrent unit, in numpy.

Tokens are the words of a document and its end.  The vocabulary is the corpus's
most frequent words; they are put in 64 classes by frequency, frequent words in
small ones, and a word's probability is that of its class times that of the word
in its class, so a step evaluates a few dozen outputs instead of 4,096.  Other
words are one vocabulary entry, and are spelled by a byte model of the corpus
(each byte given the one before).

Word and byte counts come from all documents, and so does training: the rounds
share out the documents, and each trains on its own.  In a round every task trains
from the same weights on its documents of that round by backpropagation truncated
to 32 steps, and the weights are averaged through a reduction tree.  Texts are
turned into tokens once, into a table that all rounds and the scoring read, each
spread anew over tasks of the same size.

Scoring runs over whole documents, hundreds at a time in parallel lanes, in
windows of 32 steps; a lane's state is carried from window to window, and reset
only where a document starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import shape, textcore
from .cluster import docs_of, dropped, partitions, stored

U64 = np.uint64
CLASSES, WORDS, SIZE = 64, 4096, 32
ROUNDS = 3
WINDOW, LANES = 32, 512
TRAIN_LANES, LANES_LEAST, UPDATES = 512, 16, 64
END, OTHER = 0, 1
FLUSH_WORDS = 4_000_000
#: Tokens from which a text is scored together with other long ones only.
LONG = 3_000
#: Bytes of text that are split into words at a time: their arrays fit a core's cache.
PIECE = 512 << 10
F32 = np.float32


# ---- counts over the corpus


def _count_rows(buckets: int):
    """Word counts as packed arrays by bucket, and counts of byte pairs as plain rows (bucket -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        pairs = np.zeros(257 * 257)

        def rows(bucket, a, b):
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["bucket", "h", "n"])

        def flush():
            h, c = _added(np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept]))
            b = (h % U64(buckets)).astype(np.uint16)
            order = np.argsort(b, kind="stable")
            edge = np.searchsorted(b[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(edge))
            h, c = h[order], c[order].astype(np.uint32)
            return rows(used.tolist(), [h[edge[i] : edge[i + 1]].tobytes() for i in used], [c[edge[i] : edge[i + 1]].tobytes() for i in used])

        for batch in batches:
            for b in textcore.pieces(batch, "text", PIECE):
                w, h = shape.ascii_words(b.column("text"))
                if not len(h):
                    continue
                h, at, c = _distinct(h)
                kept.append((h, c))
                n += len(h)
                pair, first = _pairs(w, at)
                pairs += np.bincount(pair, weights=np.repeat(c, np.diff(np.append(first, len(pair)))), minlength=257 * 257)
                if n >= FLUSH_WORDS:
                    yield flush()
                    kept, n = [], 0
        if n:
            yield flush()
        if len(some := np.flatnonzero(pairs)):
            yield rows([-1 - int(x) for x in some // 257], [np.array([x], np.int64).tobytes() for x in some], [np.array([pairs[x]]).astype(np.int64).tobytes() for x in some])

    return run


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, where one of each is, and how many there are.

    Values and places are sorted as one number; values that agree in all but
    their last bits, which is very rare, are sorted in full.
    """
    bits = U64(max(1, len(h) - 1).bit_length())
    x = np.sort((h >> bits << bits) | np.arange(len(h), dtype=U64))
    at = (x & ((U64(1) << bits) - U64(1))).astype(np.int64)
    x >>= bits
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    own = h[at]
    if (own[1:] != own[:-1]).sum() != len(begin) - 1:
        return np.unique(h, return_index=True, return_counts=True)
    return own[begin], at[begin], np.diff(np.append(begin, len(h)))


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of n for each."""
    order = np.argsort(keys)
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(n[order].astype(np.int64), begin)


def _pairs(w: textcore.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte pairs of the words `which`, each with its beginning and end (both 256), and the first pair of each word."""
    if not len(which):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    buf, start = shape.LOWER[w.buf], w.start[which]
    n = w.end[which] - start
    first = np.cumsum(n + 1) - (n + 1)
    total = int((n + 1).sum())
    cur = np.full(total, 256, np.int64)
    at = np.repeat(start - first, n + 1) + np.arange(total)
    last = first + n
    inside = np.ones(total, bool)
    inside[last] = False
    cur[inside] = buf[at[inside]]
    prev = np.concatenate([[256], cur[:-1]])
    return prev * 257 + cur, first


def _most_frequent(limit: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            pair = np.frombuffer(b"".join(table.column("h").to_pylist()), np.int64)
            n = np.frombuffer(b"".join(table.column("n").to_pylist()), np.int64)
            u, inverse = np.unique(pair, return_inverse=True)
            return pa.table({"kind": np.full(len(u), 1, np.int32), "key": u, "n": np.bincount(inverse, weights=n).astype(np.int64)})
        h = np.frombuffer(b"".join(table.column("h").to_pylist()), U64)
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), np.uint32)
        u, c = _added(h, n)
        top = np.lexsort((u, -c))[:limit]
        return pa.table({"kind": np.zeros(len(top), np.int32), "key": u[top].view(np.int64), "n": c[top]})

    return run


def class_edges(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """First word of each class, and the end: END and OTHER are classes of their own, other words share classes by the square root of their counts."""
    total = np.cumsum(np.sqrt(counts.astype(np.float64)))
    if not len(total):
        return np.array([0, 1, 2])
    k = np.minimum((total - np.sqrt(counts) / 2) / total[-1] * (classes - 2), classes - 3).astype(np.int64)
    return np.concatenate([[0, 1], 2 + np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), [2 + len(counts)]])


class Vocabulary:
    """Ids of words by hash, the classes of the ids, and the spelling model."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, spelling: np.ndarray, edges: np.ndarray):
        self.hashes, self.ids, self.spelling, self.edges = hashes, ids, spelling, edges
        # most words have a slot of their own, by their first 16 bits; those that share one are searched
        slot = (hashes >> U64(48)).astype(np.int64)
        self.slot_hash, self.slot_id, self.shared = np.zeros(1 << 16, U64), np.full(1 << 16, OTHER, np.int16), np.bincount(slot, minlength=1 << 16) > 1
        self.slot_hash[slot], self.slot_id[slot] = hashes, ids

    def ids_of(self, h: np.ndarray) -> np.ndarray:
        """The id of each word by its hash; OTHER for those that aren't in the vocabulary."""
        slot = (h >> U64(48)).astype(np.int64)
        out = np.where(self.slot_hash[slot] == h, self.slot_id[slot], np.int16(OTHER))
        if len(self.hashes) and len(more := np.flatnonzero(self.shared[slot])):
            at = np.minimum(np.searchsorted(self.hashes, h[more]), len(self.hashes) - 1)
            out[more] = np.where(self.hashes[at] == h[more], self.ids[at], OTHER)
        return out

    def tokens(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids (each text's words, then END), the first token of each text, and log-probability of each text's spelled words."""
        w, h = shape.ascii_words(column)
        ids = self.ids_of(h)
        counts, spelled = w.counts, np.zeros(len(w.counts))
        if len(rare := np.flatnonzero(ids == OTHER)):
            pair, first = _pairs(w, rare)
            spelled = np.bincount(w.docs()[rare], weights=np.add.reduceat(self.spelling[pair], first), minlength=len(counts))
        begin = w.first[:-1] + np.arange(len(counts))
        out = np.full(len(h) + len(counts), END, np.int16)
        out[np.arange(len(h)) + w.docs()] = ids
        return out, np.append(begin, len(out)), spelled


def vocabulary(docs: DataFrame, size: int = WORDS) -> Vocabulary:
    """The size - 2 most frequent words of all documents, classes in order of frequency, and byte-pair probabilities."""
    nb = min(65_535, partitions(docs.sparkSession))
    counted = stored(docs.mapInArrow(_count_rows(nb), "bucket int, h binary, n binary").groupBy("bucket").applyInArrow(_most_frequent(size - 2), "kind int, key bigint, n bigint"))
    top = counted.filter("kind = 0").orderBy(F.desc("n"), "key").limit(size - 2).toPandas()  # at most 4,094 rows
    pairs = counted.filter("kind = 1").toPandas()  # at most 257 x 257 rows
    dropped(counted)
    h, ids, edges = top.key.to_numpy(np.int64).view(U64), np.arange(len(top)) + 2, class_edges(top.n.to_numpy(np.int64))
    n = np.full((257, 257), 0.1)
    n.reshape(-1)[pairs.key.to_numpy(np.int64)] += pairs.n.to_numpy(np.float64)
    order = np.argsort(h)
    return Vocabulary(h[order], ids[order], np.log(n / n.sum(axis=1, keepdims=True)).reshape(-1).astype(np.float64), edges)


# ---- the network


def initial(edges: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights: e (what each word adds to update gate, reset gate and candidate), u (what the state adds), cw/cb (classes), ow/ob (words).

    "edges" is the first word of each class, and the end of the last.
    """
    r = np.random.default_rng(seed)
    g = lambda *s, by=None: (r.standard_normal(s) / np.sqrt(by or s[0])).astype(F32)
    return {"e": g(WORDS + 1, 3 * SIZE, by=8), "u": g(SIZE, 3 * SIZE), "cw": g(SIZE, CLASSES), "cb": np.zeros(CLASSES, F32), "ow": g(WORDS, SIZE, by=SIZE), "ob": np.zeros(WORDS, F32), "edges": edges}


LEARNT = ("e", "u", "cw", "cb", "ow", "ob")
START = WORDS
#: Factors of what a word and what the state add to update gate, reset gate and candidate.
HALVED = np.array([[[0.5], [0.5], [1]], [[0.5], [0.5], [0.5]]], F32)


def planes(u: np.ndarray) -> np.ndarray:
    """The columns of update gate, reset gate and candidate as three matrices."""
    return np.ascontiguousarray(u.reshape(len(u), 3, -1).transpose(1, 0, 2))


def _gate(x: np.ndarray) -> None:
    """The logistic function in place: (1 + tanh(x / 2)) / 2."""
    half = x.dtype.type(0.5)
    x *= half
    np.tanh(x, out=x)
    x *= half
    x += half


def _bounded(w: np.ndarray, bias: np.ndarray, axis: int) -> bool:
    """Whether no output can be so large that its exponential is out of range: states are between -1 and 1."""
    return float((np.abs(w).sum(axis=axis) + np.abs(bias)).max()) < 60


def _softmax(x: np.ndarray, target: np.ndarray, bounded: bool, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In place: exponentials; what each column of them is to be multiplied by, the sums of these products, and the log-probabilities of the targets.

    Where outputs are bounded a bias is a factor of its column's exponential, and isn't added to each row.
    """
    by = np.exp(bias) if bounded else np.ones(x.shape[1], x.dtype)
    if not bounded:
        x += bias
        x -= x.max(axis=1, keepdims=True)
    picked = np.take(x.reshape(-1), np.arange(0, x.size, x.shape[1]) + target)
    if bounded:
        picked += bias[target]
    np.exp(x, out=x)
    total = x @ by
    return picked - np.log(total), total, by


def _by_class(target: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each target, their order by class, and where each class begins in it."""
    of_word = np.repeat(np.arange(len(edges) - 1, dtype=np.int8), np.diff(edges))
    c = of_word[target]
    return c.astype(np.int64), np.argsort(c, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(c, minlength=len(edges) - 1))])


def log_probabilities(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray, bounded: tuple[bool, bool] | None = None) -> np.ndarray:
    """Log-probability of each target word given a state; bounded: what _bounded says of classes and of words, where that is known."""
    edges = p["edges"]
    k, order, at = _by_class(target, edges)
    n = len(edges) - 1
    large, small = bounded or (_bounded(p["cw"], p["cb"], 0), _bounded(p["ow"], p["ob"], 1))
    out = _softmax(h @ p["cw"][:, :n], k, large, p["cb"][:n])[0]
    alone = at[np.argmax(np.append(np.diff(edges) > 1, True))]  # words of the first classes are alone in them
    order = order[alone:]
    hs, ys, words = np.take(h, order, axis=0), target[order], np.zeros(len(order), F32)
    for k in range(n):
        lo, hi = at[k] - alone, at[k + 1] - alone
        if 0 <= lo < hi:
            own, (a, b) = slice(lo, hi), edges[k : k + 2]
            words[own] = _softmax(hs[own] @ p["ow"][a:b].T, ys[own] - a, small, p["ob"][a:b])[0]
    out[order] += words
    return out


def lanes_of(sizes: np.ndarray, lanes: int) -> list[np.ndarray]:
    """Texts of each lane: the longest first, each to the lane that is shortest so far; lanes by falling length."""
    import heapq

    heap = [(0, i) for i in range(min(lanes, len(sizes)))]
    own: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-sizes, kind="stable").tolist():
        n, i = heapq.heappop(heap)
        own[i].append(d)
        heapq.heappush(heap, (n + int(sizes[d]), i))
    out = [np.array(x, np.int64) for x in own]
    return sorted(out, key=lambda x: -int(sizes[x].sum()))


def score_texts(p: dict[str, np.ndarray], tokens: np.ndarray, first: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Log-probability of each text's tokens.  State is carried along a text and reset at the start of the next.

    Lanes are runs of one array of tokens and are read window by window, so
    memory follows the number of tokens, however long the longest text is.
    """
    sizes = np.diff(first)
    if not len(sizes):
        return np.zeros(0)
    own = lanes_of(sizes, lanes)
    length = np.array([sizes[x].sum() for x in own])
    texts = np.concatenate(own)
    n = sizes[texts]
    begin = np.cumsum(n) - n
    target = tokens[np.repeat(first[texts] - begin, n) + np.arange(len(tokens))]
    source = np.empty_like(target)
    source[1:] = target[:-1]
    source[begin] = START
    doc = np.repeat(texts.astype(np.int32), n)
    lane, steps = np.cumsum(length) - length, int(length[0])
    ready = np.searchsorted(-length, -np.arange(steps), side="left")
    starts = np.sort((begin - np.repeat(lane, [len(x) for x in own])) * len(own) + np.repeat(np.arange(len(own)), [len(x) for x in own]))
    starts_at, starts = np.searchsorted(starts, np.arange(steps + 1) * len(own)), starts % len(own)
    # update gate, reset gate and candidate are planes of their own; what the gates' tanh gets, and what the reset gate multiplies, are halved
    table, u, total = (p["e"].reshape(-1, 3, SIZE) * HALVED[0]).reshape(-1, SIZE), planes(p["u"]) * HALVED[1][:, None], np.zeros(len(sizes))
    h, width, half = np.zeros((len(own), SIZE), F32), len(own), F32(0.5)
    bounded = _bounded(p["cw"], p["cb"], 0), _bounded(p["ow"], p["ob"], 1)
    xs, turned = np.empty(3 * width * SIZE, F32), np.empty(3 * width * SIZE, F32)
    states, places, rows = np.empty((WINDOW * width, SIZE), F32), np.empty(WINDOW * width, np.int64), np.empty(3 * width, np.int64)
    for t0 in range(0, steps, WINDOW):
        n = 0
        for t in range(t0, min(t0 + WINDOW, steps)):
            b = int(ready[t])
            at = np.add(lane[:b], t, out=places[n : n + b])
            s, row = h[:b], rows[: 3 * b].reshape(3, b)
            np.multiply(source[at], 3, out=row[0], dtype=np.int64)
            np.add(row[0], 1, out=row[1])
            np.add(row[0], 2, out=row[2])
            if starts_at[t] < starts_at[t + 1]:
                s[starts[starts_at[t] : starts_at[t + 1]]] = 0
            x = np.take(table, row, axis=0, out=xs[: 3 * b * SIZE].reshape(3, b, SIZE), mode="clip")
            a = np.matmul(s, u, out=turned[: 3 * b * SIZE].reshape(3, b, SIZE))
            g = x[:2]
            g += a[:2]
            np.tanh(g, out=g)
            z, c = g
            c *= a[2]
            c += a[2]
            c += x[2]
            np.tanh(c, out=c)
            s -= c
            s *= half
            z *= s
            s += z
            s += c
            states[n : n + b] = s
            n += b
        at = places[:n]
        total += np.bincount(doc[at], weights=log_probabilities(p, states[:n], target[at].astype(np.int64), bounded), minlength=len(sizes))
    return total


class Room:
    """Arrays that are used again for window after window."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], kind) -> np.ndarray:
        n = int(np.prod(shape))
        if name not in self.kept or self.kept[name].size < n or self.kept[name].dtype != kind:
            self.kept[name] = np.empty(n, kind)
        return self.kept[name][:n].reshape(shape)


def gradient(p: dict[str, np.ndarray], h: np.ndarray, source: np.ndarray, target: np.ndarray, room: Room | None = None) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean loss over a window (steps x lanes), its gradient, and the state after it; backpropagation stops at the window's start.

    The gradient of e is given for the window's words only: rows, in "rows", and their values.
    """
    room = room or Room()
    steps, lanes = source.shape
    d, n, kind = SIZE, steps * lanes, h.dtype
    new = lambda name, *shape: room(name, shape, kind)
    # update gate, reset gate and candidate are planes of their own
    rows = np.multiply(source[:, None], 3, out=room("rows", (steps, 3, lanes), np.dtype(np.int64)), dtype=np.int64)
    rows += np.arange(3)[:, None]
    x = np.take(p["e"].reshape(-1, d), rows, axis=0, out=new("x", steps, 3, lanes, d), mode="clip")
    begins = [np.flatnonzero(row == START) for row in source]
    before, after, c, turned = (new(k, steps, *w, lanes, d) for k, w in (("before", ()), ("after", ()), ("c", ()), ("turned", (3,))))
    z, r, ac, u = turned[:, 0], turned[:, 1], turned[:, 2], planes(p["u"])
    for t in range(steps):
        s = before[t]
        s[:] = h
        s[begins[t]] = 0
        g = np.matmul(s, u, out=turned[t])[:2]
        g += x[t, :2]
        _gate(g)
        v = np.multiply(r[t], ac[t], out=c[t])
        v += x[t, 2]
        np.tanh(v, out=v)
        h = np.subtract(s, v, out=after[t])
        h *= z[t]
        h += v
    h = h.copy()
    hs, y, every, g, edges = after.reshape(n, d), target.reshape(-1).astype(np.int64), np.arange(n), {}, p["edges"]
    k, order, at = _by_class(y, edges)
    many, small = len(edges) - 1, _bounded(p["ow"], p["ob"], 1)
    dc = np.matmul(hs, p["cw"][:, :many], out=new("classes", n, many))
    lp, total, by = _softmax(dc, k, _bounded(p["cw"], p["cb"], 0), p["cb"][:many])
    loss = -float(lp.sum())
    dc *= (1 / (total * n))[:, None].astype(kind)
    dc *= by
    dc[every, k] -= kind.type(1 / n)
    g["cw"], g["cb"] = np.zeros_like(p["cw"]), np.zeros_like(p["cb"])
    g["cw"][:, :many], g["cb"][:many] = hs.T @ dc, np.ones(n, kind) @ dc
    dh_out = np.matmul(dc, p["cw"][:, :many].T, out=new("out", n, d))
    alone = at[np.argmax(np.append(np.diff(edges) > 1, True))]
    order = order[alone:]
    hk, yk, back, ones = np.take(hs, order, axis=0, out=new("sorted", len(order), d), mode="clip"), y[order], new("back", len(order), d), np.ones(n, kind)
    g["ow"], g["ob"] = np.zeros_like(p["ow"]), np.zeros_like(p["ob"])
    for k in range(many):
        lo, hi = at[k] - alone, at[k + 1] - alone
        if 0 <= lo < hi:
            own, (a, b) = slice(lo, hi), edges[k : k + 2]
            dw = hk[own] @ p["ow"][a:b].T
            lp, total, by = _softmax(dw, yk[own] - a, small, p["ob"][a:b])
            loss -= float(lp.sum())
            dw *= (1 / (total * n))[:, None].astype(kind)
            dw *= by
            dw[every[: len(dw)], yk[own] - a] -= kind.type(1 / n)
            np.matmul(dw.T, hk[own], out=g["ow"][a:b])
            g["ob"][a:b] = ones[: len(dw)] @ dw
            np.matmul(dw, p["ow"][a:b], out=back[own])
    dh_out[order] += back
    dh_out = dh_out.reshape(steps, lanes, d)
    # what the state's error is multiplied by on its way to update gate, candidate and reset gate
    by_z = np.subtract(before, c, out=new("by_z", steps, lanes, d))
    by_c = np.subtract(1, z, out=new("by_c", steps, lanes, d))
    by_z *= z
    by_z *= by_c
    c *= c
    np.subtract(1, c, out=c)
    by_c *= c
    by_r = np.subtract(1, r, out=c)
    by_r *= r
    by_r *= ac
    # errors of both gates, of what the state adds to the candidate, and of the candidate
    errors = new("errors", steps, 4, lanes, d)
    dh, ut, turned = np.zeros((lanes, d), kind), np.ascontiguousarray(u.transpose(0, 2, 1)), new("back_turned", 3, lanes, d)
    for t in range(steps - 1, -1, -1):
        dh += dh_out[t]
        e = errors[t]
        np.multiply(dh, by_z[t], out=e[0])
        v = np.multiply(dh, by_c[t], out=e[3])
        np.multiply(v, by_r[t], out=e[1])
        np.multiply(v, r[t], out=e[2])
        dh *= z[t]
        for more in np.matmul(e[:3], ut, out=turned):
            dh += more
        dh[begins[t]] = 0
    g["u"] = np.matmul(before.transpose(0, 2, 1)[:, None], errors[:, :3]).sum(axis=0).transpose(1, 0, 2).reshape(d, 3 * d)
    flat = source.reshape(-1)
    order = np.argsort(flat, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
    g["rows"], g["e"] = flat[order[begin]], _sums(errors, order, begin, x)
    return loss / n, g, h


def _sums(errors: np.ndarray, order: np.ndarray, begin: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Sums of a window's errors (steps x 4 x lanes) over the places order, from each begin on: of gates and candidate, one after the other.

    Long stretches are summed by a product; of the others all first rows are added at once, all second ones, and so on.
    """
    lanes, d = errors.shape[2:]
    row = (order + order // lanes * (3 * lanes))[:, None] + np.array([0, lanes, 3 * lanes])
    x, room = errors.reshape(-1, d), room.reshape(-1, 3, d)
    size = np.diff(np.append(begin, len(order)))
    out = np.empty((len(begin), 3, d), x.dtype)
    short = np.flatnonzero(size < 24)
    short = short[np.argsort(-size[short], kind="stable")]
    left, total = np.searchsorted(-size[short], -np.arange(24), side="left"), np.zeros((len(short), 3, d), x.dtype)
    for i in range(23):
        m = left[i]
        if not m:
            break
        total[:m] += np.take(x, row[begin[short[:m]] + i], axis=0, out=room[:m], mode="clip")
    out[short] = total
    ones = np.ones(int(size.max()), x.dtype)
    for i in np.flatnonzero(size >= 24).tolist():
        n = size[i]
        np.matmul(ones[:n], np.take(x, row[begin[i] : begin[i] + n], axis=0, out=room[:n], mode="clip").reshape(n, 3 * d), out=out[i].reshape(-1))
    return out.reshape(-1, 3 * d)


def lanes_for(n: int) -> int:
    """Lanes that n tokens are trained in: as many as leave UPDATES windows, between LANES_LEAST and TRAIN_LANES."""
    return max(LANES_LEAST, min(TRAIN_LANES, n // (WINDOW * UPDATES)))


def train_texts(p: dict[str, np.ndarray], tokens: np.ndarray, first: np.ndarray, rate: float = 0.01, lanes: int | None = None) -> tuple[dict[str, np.ndarray], float]:
    """One pass over the texts, end to end in parallel lanes, with Adam; the weights after it and the mean loss.

    Lanes are equally long and hold every token; where their number doesn't divide the tokens', some begin with the last tokens of the one before.
    """
    n = len(tokens)
    if not n:
        return p, 0.0
    lanes = max(1, min(lanes or lanes_for(n), n // WINDOW))
    length = -(-n // lanes)
    at = (np.arange(lanes) * (n - length) // max(1, lanes - 1))[None, :] + np.arange(length)[:, None]
    source = np.empty(n, np.int16)
    source[1:] = tokens[:-1]
    source[first[:-1]] = START
    source, target = source[at], tokens[at]
    del at
    p = {k: v.copy() for k, v in p.items()}
    one, two = ({k: np.zeros_like(p[k]) for k in LEARNT} for _ in range(2))
    h, losses, room = np.zeros((lanes, SIZE), F32), [], Room()
    for i, t in enumerate(range(0, length, WINDOW), 1):
        loss, g, h = gradient(p, h, source[t : t + WINDOW], target[t : t + WINDOW], room)
        losses.append(loss)
        rows = g.pop("rows")
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        by = min(1.0, 1.0 / (norm + 1e-6))
        if by < 1:
            for x in g.values():
                x *= F32(by)
        much, eps = F32(rate / (1 - 0.9**i) * np.sqrt(1 - 0.99**i)), F32(1e-6)
        for k, gk in g.items():
            own = rows if k == "e" else slice(None)  # moments of words that aren't in the window stay as they are
            m, v = one[k][own], two[k][own]
            # moments are kept 10 and 100 times as large, which saves two products
            m *= F32(0.9)
            m += gk
            gk *= gk
            v *= F32(0.99)
            v += gk
            if k == "e":
                one[k][own], two[k][own] = m, v
            np.sqrt(v, out=gk)
            gk += eps
            np.divide(m, gk, out=gk)
            gk *= much
            p[k][own] -= gk
    return p, float(np.mean(losses))


# ---- distribution

#: Weights are averaged by block of the model, first over tasks that agree modulo FAN_IN, then over these sums.
BLOCKS, FAN_IN = 16, 256


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in LEARNT])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {"edges": like["edges"]}, 0
    for k in LEARNT:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(F32)
        at += like[k].size
    return out


WEIGHTS = "block int, node bigint, weight double, values binary"


TOKENS = "doc_id bigint, tokens binary, spelled double"


def _token_rows(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in textcore.pieces(batch, "text", PIECE):
                tokens, first, spelled = v.tokens(b.column("text"))
                packed = pa.Array.from_buffers(pa.binary(), len(spelled), [None, pa.py_buffer((2 * first).astype(np.int32)), pa.py_buffer(tokens.astype("<i2"))])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), packed, pa.array(spelled)], ["doc_id", "tokens", "spelled"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch], long: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """Tokens of texts and the first of each, FLUSH_WORDS or a little more at a time, with their rows.

    Texts of more than `long` tokens are gathered apart from the others, so that lanes end at about the same time.
    """
    kept: tuple[list, list] = ([], [])
    n = [0, 0]

    def join(k: int):
        rows = pa.Table.from_batches(kept[k])
        tokens = np.concatenate([np.frombuffer(x, np.int16) for b in kept[k] for x in _values(b.column("tokens"))])
        size = np.asarray(pc.binary_length(rows.column("tokens"))).astype(np.int64) // 2
        kept[k].clear()
        n[k] = 0
        return tokens, np.concatenate([[0], np.cumsum(size)]), rows.drop_columns(["tokens"])

    for batch in batches:
        apart = [batch]
        if long is not None:
            over = pc.greater(pc.binary_length(batch.column("tokens")), 2 * long)
            apart = [batch.filter(pc.invert(over)), batch.filter(over)]
        for k, b in enumerate(apart):
            if b.num_rows:
                kept[k].append(b)
                n[k] += sum(len(x) // 2 for x in _values(b.column("tokens")))
                if n[k] >= FLUSH_WORDS:
                    yield join(k)
    for k in range(2):
        if kept[k]:
            yield join(k)


def _values(column: pa.Array) -> list[memoryview]:
    """The bytes of all values of a binary column, one after the other."""
    _, off, data = column.buffers()
    edge = np.frombuffer(off, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[[column.offset, column.offset + len(column)]].tolist()
    return [memoryview(data)[edge[0] : edge[1]]] if data is not None else []


def _train_rows(p: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = p, 0
        for tokens, first, _ in _gathered(batches):
            own, _ = train_texts(own, tokens, first)
            n += len(tokens)
        if n:
            parts = np.array_split(pack(own).astype(np.float32), BLOCKS)
            node = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(np.full(BLOCKS, node, np.int64)), pa.array(np.full(BLOCKS, float(n))), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "node", "weight", "values"])

    return run


def _averaged(table: pa.Table) -> pa.Table:
    w = np.asarray(table.column("weight"), np.float64)
    total = sum(x * np.frombuffer(b.as_py(), np.float32) for x, b in zip(w, table.column("values"))) / w.sum()
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "node": pa.array([table.column("up")[0].as_py()], pa.int64()), "weight": [float(w.sum())], "values": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def documents_of_round(tokens: DataFrame, k: int, rounds: int) -> DataFrame:
    """The documents that round k of 0 to rounds - 1 trains on, by a hash of doc_id and tokens; every document is in one round."""
    return tokens.filter(F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(rounds)) == k)


#: Tokens from which a task of its own is worth starting, and tasks a core over which larger tables are spread, so that cores end at about the same time.
LEAST_TOKENS, WAVES = 500_000, 4


def tasks_for(n: int, cores: int) -> int:
    """Tasks over which n tokens are spread: one a core, and up to WAVES where each still has FLUSH_WORDS tokens; fewer for small tables."""
    return max(1, min(cores, n // LEAST_TOKENS), cores * min(WAVES, n // (cores * FLUSH_WORDS)))


def spread(tokens: DataFrame, tasks: int | None) -> DataFrame:
    """The rows in so many partitions of about the same size, whatever the files are; as they are for None."""
    return tokens if tasks is None else tokens.repartition(tasks, "doc_id", "tokens")


def trained(tokens: DataFrame, edges: np.ndarray, rounds: int = ROUNDS, seed: int = 11, tasks: int | None = None) -> dict[str, np.ndarray]:
    """Weights after all rounds, which together train on every document; tokens: rows of TOKENS; tasks: as in spread().

    A round without documents, as in small tables, leaves the weights as they
    are; the initial ones are returned for an empty table only.
    """
    p = initial(edges, seed)
    for k in range(rounds):
        rows = spread(documents_of_round(tokens, k, rounds), tasks).mapInArrow(_train_rows(p), WEIGHTS)
        for up in (F.pmod(F.col("node"), F.lit(FAN_IN)), F.lit(0).cast("bigint")):
            rows = rows.withColumn("up", up).groupBy("block", "up").applyInArrow(_averaged, WEIGHTS)
        found = rows.orderBy("block").select("block", "values").collect()  # BLOCKS rows, one model
        if found:
            p = unpack(np.concatenate([np.frombuffer(r["values"], np.float32) for r in found]), p)
    return p


def _score_rows(p: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, first, rows in _gathered(batches, LONG):
            total = score_texts(p, tokens, first) + np.asarray(rows.column("spelled"))
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array(n), pa.array(total), pa.array(total / n)], ["doc_id", "n_tokens", "log_likelihood", "per_token"])

    return run


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens (words and the end), log_likelihood of all its words and its end, and per_token; one row for each row of docs.

    Only words, lower-cased in ASCII, are scored: a text of symbols scores like an empty one.

    docs: doc_id, text; other columns aren't used.  A null text is scored as an
    empty one: its end only.  Null and repeated doc_ids are scored row by row.
    Very long texts are scored to their end.  An empty table gives no rows.
    """
    docs = docs_of(docs)
    v = vocabulary(docs)
    seen = Observation()
    tokens = stored(docs.mapInArrow(_token_rows(v), TOKENS).observe(seen, F.sum(F.length("tokens")).alias("bytes")))
    tasks = tasks_for((seen.get["bytes"] or 0) // 2, docs.sparkSession.sparkContext.defaultParallelism)
    return spread(tokens, tasks).mapInArrow(_score_rows(trained(tokens, v.edges, rounds, tasks=tasks)), "doc_id bigint, n_tokens bigint, log_likelihood double, per_token double")
