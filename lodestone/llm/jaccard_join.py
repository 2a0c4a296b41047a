"""N-gram Jaccard self-join by a token-group matrix.

Every document is a query against every other.  Tokens are word n-grams; the
result is exact.  A link is a pair of documents with Jaccard similarity of at
least the threshold.  classes() has each document's class and its number of
links, jaccard_join() every link, and group_edges() those between different
token sets and to one of those with the same set.  Links grow with the square of
a family of near copies; classes() never lists them.

1. *Whole-corpus bound.*  A document can only have a partner if its overlap with
   the union of all other documents reaches threshold x its size.  These
   overlaps are counted over all documents; most documents end here.
2. *Token sets that occur several times* are reduced to one representative.
3. The bound of step 1 again, among representatives.
4. *Token-group matrix.*  Sets that agree in two neighbouring of several minimum
   hashes and in size class, directly or by a few steps, form a group; so a
   family of near copies is a few groups, however large it is.  The matrix holds
   each group's token union.
5. *Group bound.*  A query's tokens, those in fewest groups first, are looked up
   in the matrix.  |x| - ceil(t|x|) + 1 + e of them must meet a group e + 1 times
   at least if any member of it is similar enough.  Only such groups of a
   compatible size, and the query's own, are opened.  Of two groups only the one
   with the lower key asks the other.
6. Token sets of the members of opened groups are compared exactly.
7. Each representative is replaced by all documents with its set; classes() adds
   up their numbers where the sets are compared instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared_keys, textcore
from .cluster import docs_of, dropped, free, stored

U64 = np.uint64
N_WORDS = 3
THRESHOLD = 0.6
TOKENS = "id bigint, n int, s1 bigint, s2 bigint, keys array<bigint>, sc int, tokens binary"
PAIRS = "sid_a bigint, sid_b bigint, jaccard double"
#: What a comparison without its pairs gives: for a set, the documents that it is linked to; a link of each set but one of those that hang together; links of sets with a document that has others.
SUMS = "kind int, sid_a bigint, sid_b bigint, links bigint"
LINKS, TREE, PAIR = 0, 1, 2
#: Minimum hashes of a set; it has as many keys.
HASHES = 6
_MATRIX_CELLS = 8_000_000
#: A token in so small a share of the pairs that are compared is counted by its occurrences, not by a column of a matrix.
_SPARSE = 0.002
#: Documents with one token set that a task expands at a time.
_COPIES = 1_000
#: Tokens of a group's members, or of these and the queries that open it, from which it is cut into blocks.
GROUP_TOKENS = 4_000_000


def _token_sets(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes by text and their offsets; a text with fewer words than n is one token of all its words."""
    w = textcore.split_words(column)
    h = w.hashes()
    s, d, _ = w.shingles(n, h)
    counts = w.counts
    for m in range(1, n):
        if (counts == m).any():
            s2, d2, _ = w.shingles(m, h)
            own = counts[d2] == m
            s, d = np.concatenate([s, s2[own]]), np.concatenate([d, d2[own]])
    return textcore.sets_of(s, d, len(counts))


def _keys(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, two identifying sums, and packed keys of the token sets."""
    sizes = np.diff(offsets)
    h = tokens >> U64(20)
    total = []
    with np.errstate(over="ignore"):
        for salt in (U64(0x632BE59BD9B4E019), U64(0x9FB21C651E98DF25)):
            t = np.zeros(len(tokens) + 1, U64)
            np.cumsum(textcore.mix(tokens ^ salt), out=t[1:])
            total.append(t[offsets[1:]] - t[offsets[:-1]])
    docs = np.repeat(np.arange(len(sizes), dtype=U64), sizes)
    return sizes, total[0], total[1], (docs << U64(44)) | h


def _texts_packed(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets():
            for batch in batches:
                for b in textcore.pieces(batch, "text"):
                    sizes, s1, s2, k = _keys(*_token_sets(b.column("text"), n))
                    yield np.asarray(b.column("doc_id"), np.int64), sizes, s1, s2, k

        yield from shared_keys.packed(sets(), buckets)

    return run


def _sets_packed(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets():
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    b = batch.slice(at, 2000)
                    off = np.concatenate([[0], np.cumsum(np.asarray(b.column("n"), np.int64))])
                    tokens = np.frombuffer(b"".join(b.column("tokens").to_pylist()), U64)
                    sizes, s1, s2, k = _keys(tokens, off)
                    yield np.asarray(b.column("id"), np.int64), sizes, s1, s2, k

        yield from shared_keys.packed(sets(), buckets)

    return run


def _size_class(n: np.ndarray, t: float) -> np.ndarray:
    """Sizes with a ratio of at least t are in the same or in neighbouring classes."""
    return np.floor(np.log(np.maximum(n, 1)) / -math.log(t) + 1e-9).astype(np.int32)


def _group_keys(tokens: np.ndarray, off: np.ndarray, has: np.ndarray, sc: np.ndarray) -> np.ndarray:
    """By set, HASHES keys: each of two minimum hashes and the size class."""
    low = np.zeros((len(has), HASHES), U64)
    with np.errstate(over="ignore"):
        if has.any():
            for i in range(HASHES):
                low[has, i] = np.minimum.reduceat(textcore.mix(tokens + U64(i) * U64(0x9E3779B97F4A7C15)), off[:-1][has])
        return textcore.mix(textcore.mix(low + sc.astype(U64)[:, None]) + np.roll(low, 1, axis=1) + np.arange(HASHES, dtype=U64))


def _merged(sets: DataFrame) -> DataFrame:
    """sid and g of rows of sid and keys: sets with a key in common get the lowest sid among them, in three steps.

    Any grouping within a size class gives the same links; this one keeps families together.
    """
    k = stored(sets.select("sid", F.explode("keys").alias("key")))
    low = lambda rows: k.join(rows.groupBy("key").agg(F.min("g").alias("g")), "key").groupBy("sid").agg(F.min("g").alias("g"))
    one = stored(low(k.withColumn("g", F.col("sid"))))
    two = one.select("sid", F.col("g").alias("by")).join(one.select(F.col("sid").alias("by"), "g"), "by").select("sid", "g")
    out = stored(low(k.join(two, "sid")))
    dropped(k)
    dropped(one)
    return out


def _grouped(n: int, t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in textcore.pieces(batch, "text"):
                tokens, off = _token_sets(b.column("text"), n)
                sizes, s1, s2, _ = _keys(tokens, off)
                has = sizes > 0
                sc = _size_class(sizes, t)
                keys = _group_keys(tokens, off, has, sc)
                blobs = [tokens[off[i] : off[i + 1]].tobytes() for i in range(len(sizes))]
                out = pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column("doc_id"), np.int64)), pa.array(sizes.astype(np.int32)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, HASHES, np.int32)), pa.array(keys.ravel().view(np.int64))), pa.array(sc), pa.array(blobs, pa.binary())], ["id", "n", "s1", "s2", "keys", "sc", "tokens"])
                yield out.filter(pa.array(has))

    return run


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and concatenated tokens of rows of TOKENS."""
    off = np.concatenate([[0], np.cumsum(np.asarray(table.column("n"), np.int64))])
    return np.asarray(table.column("id"), np.int64), off, np.frombuffer(b"".join(table.column("tokens").to_pylist()), U64)


def _union(table: pa.Table) -> pa.Table:
    _, _, tokens = _sets(table)
    u = np.unique(tokens).view(np.int64)
    return pa.table({"g": np.full(len(u), table.column("g")[0].as_py(), np.int64), "sc": np.full(len(u), table.column("sc")[0].as_py(), np.int32), "tok": u})


def _need(n: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Length of the part of a query that is looked up, and the meetings that a group needs."""
    alpha = np.ceil(t * n - 1e-9).astype(np.int64)
    extra = np.minimum(alpha - 1, n // 5)
    return n - alpha + 1 + extra, extra + 1


def _looked_up(t: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "g": pa.array([], pa.int64()), "sc": pa.array([], pa.int32()), "tok": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        ids, off, tokens = _sets(left)
        g, sc = left.column("g")[0].as_py(), left.column("sc")[0].as_py()
        known = np.asarray(right.column("tok"), np.int64).view(U64)
        order = np.argsort(known)
        known, groups = known[order], np.asarray(right.column("groups"), np.int64)[order]
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        hit = known[at] == tokens
        n_groups = np.where(hit, groups[at], 1)
        sizes = np.diff(off)
        length, needed = _need(sizes, t)
        out = []
        for i in range(len(ids)):
            lo, hi = off[i], off[i + 1]
            rank = np.argsort(n_groups[lo:hi], kind="stable")[: length[i]] + lo
            rank = rank[n_groups[rank] > 1]
            if len(rank) >= needed[i]:
                out.append((i, tokens[rank]))
        if not out:
            return empty
        reps = np.array([len(x) for _, x in out])
        who = np.repeat([i for i, _ in out], reps)
        return pa.table({"id": ids[who], "n": sizes[who].astype(np.int32), "g": np.full(len(who), g, np.int64), "sc": np.full(len(who), sc, np.int32), "tok": np.concatenate([x for _, x in out]).view(np.int64)})

    return run


def _overlaps(qt, qo, mt, mo) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks (first query, overlap counts by query and member) of two collections of sets."""
    nm, n = len(mo) - 1, len(qo) - 1
    vocab, cols_m = np.unique(mt, return_inverse=True)
    rows_m = np.repeat(np.arange(nm), np.diff(mo))
    at = np.minimum(np.searchsorted(vocab, qt), max(len(vocab) - 1, 0))
    ok = vocab[at] == qt
    rows_q, cols_q = np.repeat(np.arange(n), np.diff(qo))[ok], at[ok]
    df_m, df_q = np.bincount(cols_m, minlength=len(vocab)), np.bincount(cols_q, minlength=len(vocab))
    dense = df_m * df_q > _SPARSE * nm * n
    column = np.cumsum(dense) - 1
    order = np.argsort(cols_m, kind="stable")
    rows_m, cols_m = rows_m[order], cols_m[order]
    first = np.cumsum(df_m) - df_m
    own = dense[cols_m]
    dense_rows_m, dense_cols_m, width = rows_m[own], column[cols_m[own]], int(dense.sum())
    step_q = max(1, min(n, _MATRIX_CELLS // max(1, nm)))
    step_v = max(1, min(width, _MATRIX_CELLS // max(1, nm, step_q)))
    edge_v = np.arange(0, width + step_v, step_v)
    edge_m = np.searchsorted(dense_cols_m, edge_v)
    for q0 in range(0, n, step_q):
        nq = min(step_q, n - q0)
        lo, hi = np.searchsorted(rows_q, [q0, q0 + nq])
        rq, cq = rows_q[lo:hi] - q0, cols_q[lo:hi]
        total = np.zeros((nq, nm), np.float32)
        own = dense[cq]
        order = np.argsort(cq[own], kind="stable")
        dense_rows, dense_cols = rq[own][order], column[cq[own]][order]
        edge = np.searchsorted(dense_cols, edge_v)
        for v in range(len(edge_v) - 1):
            a = np.zeros((nq, step_v), np.float32)
            a[dense_rows[edge[v] : edge[v + 1]], dense_cols[edge[v] : edge[v + 1]] - edge_v[v]] = 1
            c = np.zeros((nm, step_v), np.float32)
            c[dense_rows_m[edge_m[v] : edge_m[v + 1]], dense_cols_m[edge_m[v] : edge_m[v + 1]] - edge_v[v]] = 1
            total += a @ c.T
        rq, cq = rq[~own], cq[~own]
        met = np.concatenate([[0], np.cumsum(df_m[cq])])
        i = 0
        while i < len(cq):
            j = max(i + 1, int(np.searchsorted(met, met[i] + _MATRIX_CELLS, side="right")) - 1)
            k = df_m[cq[i:j]]
            member = np.repeat(first[cq[i:j]] - (met[i:j] - met[i]), k) + np.arange(met[j] - met[i])
            np.add.at(total.reshape(-1), np.repeat(rq[i:j] * nm, k) + rows_m[member], np.float32(1))
            i = j
        yield q0, total


def _hits(left: pa.Table, right: pa.Table, t: float) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    """True for a pair within left, places of the query (in left or in right) and of the member of left, similarity.

    left: members of a group, or block a of it; right: members of block b, and queries from other groups that open it.
    """
    if not left.num_rows:
        return
    mi, mo, mt = _sets(left)
    own = left.num_rows > 1 and left.column("a")[0].as_py() == left.column("b")[0].as_py()
    for table in [left] * own + [right] * (right.num_rows > 0):
        qi, qo, qt = _sets(table)
        for q0, shared in _overlaps(qt, qo, mt, mo):
            nq, nm = np.diff(qo)[q0 : q0 + len(shared)], np.diff(mo)
            j = shared / (nq[:, None] + nm[None, :] - shared.astype(np.float64))
            ids = qi[q0 : q0 + len(shared), None]
            a, b = np.nonzero((j >= t - 1e-12) & ((ids < mi[None, :]) if table is left else (ids != mi[None, :])))
            yield table is left, q0 + a, b, j[a, b]


def _verified(t: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        mi, qi = (np.asarray(x.column("id"), np.int64) for x in (left, right))
        for within, a, b, j in _hits(left, right, t):
            x, y = (mi if within else qi)[a], mi[b]
            out.append((np.minimum(x, y), np.maximum(x, y), j))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("sid_a", "sid_b", "jaccard"), cols)))

    return run


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the place of one of its own) after the places a and b are joined."""
    while True:
        x, y = label[a], label[b]
        go = x != y
        if not go.any():
            return label
        a, b, x, y = a[go], b[go], x[go], y[go]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((up := label[label]) != label).any():
            label = up


def _summed(t: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        col = lambda name: np.concatenate([np.asarray(x.column(name), np.int64) for x in (left, right)])
        ids, singles, marked = col("id"), col("singles"), col("marked") > 0
        links, label, pairs = np.zeros(len(ids)), np.arange(len(ids)), [(np.zeros(0, np.int64),) * 2]
        for within, a, b, _ in _hits(left, right, t):
            a = a if within else a + n
            links += np.bincount(a, singles[b], len(ids)) + np.bincount(b, singles[a], len(ids))
            label = _joined(label, a, b)
            pick = marked[a] | marked[b]
            pairs.append((ids[a[pick]], ids[b[pick]]))
        some, tree = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
        x, y = (np.concatenate(p) for p in zip(*pairs))
        cols = (
            (np.full(len(some), LINKS, np.int32), ids[some], ids[some], links[some].astype(np.int64)),
            (np.full(len(tree), TREE, np.int32), ids[label[tree]], ids[tree], np.zeros(len(tree), np.int64)),
            (np.full(len(x), PAIR, np.int32), x, y, np.zeros(len(x), np.int64)),
        )
        return pa.table(dict(zip(("kind", "sid_a", "sid_b", "links"), map(np.concatenate, zip(*cols)))))

    return run


def group_edges(docs: DataFrame, threshold: float = THRESHOLD, n: int = N_WORDS) -> DataFrame:
    """Pairs doc_id_a < doc_id_b that have the connected components of jaccard_join(), but are fewer.

    Documents with the same token set are joined to the one of them with the
    lowest id, which stands for them in all other pairs.  Rows, texts and ids are
    read as jaccard_join() reads them.
    """
    lowest, members, sets = _set_join(docs, threshold, n)
    edges = _pairs(sets, threshold, _verified(threshold), PAIRS)
    copies = members.join(lowest, "sid").filter("id <> rep").select(F.col("rep").alias("doc_id_a"), F.col("id").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    a, b = (lowest.select(F.col("sid").alias(f"sid_{x}"), F.col("rep").alias(x)) for x in "ab")
    return copies.unionByName(_by_id(edges.join(a, "sid_a").join(b, "sid_b")))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N_WORDS) -> DataFrame:
    """All pairs doc_id_a < doc_id_b whose Jaccard similarity is at least the threshold, with it.

    A group of k documents with the same token set gives k(k-1)/2 pairs, and each
    of its documents is paired with each document of a similar set.

    docs: doc_id and text; further columns, whatever their names, are not used.
    A row with a null doc_id, or whose text is null or has no word, is in no pair.
    A text of fewer than n words has one token, all its words.  Rows that share a
    doc_id are separate queries, but a pair of a document with itself is not
    reported.  An empty table gives no pairs.
    """
    _, members, sets = _set_join(docs, threshold, n)
    edges = _pairs(sets, threshold, _verified(threshold), PAIRS)
    sizes = members.groupBy("sid").agg(F.count("*").alias("k"))
    within = sizes.filter("k > 1").select(F.col("sid").alias("sid_a"), F.col("sid").alias("sid_b"), F.lit(1.0).alias("jaccard"))
    pairs = _members_of(_members_of(edges.unionByName(within), members, sizes, "a", "sid_b"), members, sizes, "b", "a")
    return _by_id(pairs.filter("sid_a <> sid_b or a < b"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N_WORDS) -> DataFrame:
    """One row for each doc_id: class_id, the lowest id of its connected component of jaccard_join()'s pairs, and n_links, in how many of these pairs it is.

    Rows, texts and ids are read as jaccard_join() reads them; an id in no pair is
    a class of its own with 0 links.  A null doc_id has no row.
    """
    ids = docs_of(docs).filter("doc_id is not null").select("doc_id").distinct()
    lowest, members, sums, edges = _summed_join(docs, threshold, n)
    groups = components(edges)
    by_sid = sums.filter(F.col("kind") == LINKS).groupBy(F.col("sid_a").alias("sid")).agg(F.sum("links").alias("links"))
    # documents with one set: those of their own set and of similar ones that have one set, and below those that have several
    several = _several(members)
    alone = members.join(several, "id", "left_anti")
    own = alone.groupBy("sid").agg(F.count("*").alias("singles"))
    reached = own.join(by_sid, "sid", "full").select("sid", (F.coalesce("singles", F.lit(0)) + F.coalesce("links", F.lit(0))).alias("links"))
    counted = alone.join(reached, "sid").select(F.col("id").alias("doc_id"), (F.col("links") - 1).alias("n"))
    # a document with several sets may be met by more than one of them: its pairs are listed
    marked = several.join(members, "id").select("id", "sid")
    pairs = sums.filter(F.col("kind") == PAIR).select("sid_a", "sid_b")
    both = marked.select(F.col("sid").alias("sid_a"), F.col("sid").alias("sid_b")).unionByName(pairs).unionByName(pairs.toDF("sid_b", "sid_a")).distinct()
    met = marked.select(F.col("id").alias("a"), F.col("sid").alias("sid_a")).join(both, "sid_a").join(members.select(F.col("id").alias("b"), F.col("sid").alias("sid_b")), "sid_b").filter("a <> b").select("a", "b").distinct()
    back = met.join(several.select(F.col("id").alias("b")), "b", "left_anti")
    listed = met.select(F.col("a").alias("doc_id"), F.lit(1).alias("n")).unionByName(back.select(F.col("b").alias("doc_id"), F.lit(1).alias("n")))
    links = counted.unionByName(listed).groupBy("doc_id").agg(F.sum("n").alias("n_links"))
    return ids.join(groups, "doc_id", "left").join(links, "doc_id", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def _several(members: DataFrame) -> DataFrame:
    """Ids of documents with several sets."""
    return members.groupBy("id").agg(F.count("*").alias("sets")).filter("sets > 1").select("id")


def _summed_join(docs: DataFrame, threshold: float, n: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """lowest and members as _set_join() has them, rows of SUMS, and pairs doc_id_a, doc_id_b that have the connected components of jaccard_join(), at most a few for each document."""
    lowest, members, sets = _set_join(docs, threshold, n)
    sums = stored(_pairs(sets, threshold, _summed(threshold), SUMS))
    dropped(sets)
    copies = members.join(lowest, "sid").filter("id <> rep").select(F.col("rep").alias("doc_id_a"), F.col("id").alias("doc_id_b"))
    a, b = (lowest.select(F.col("sid").alias(f"sid_{x}"), F.col("rep").alias(f"doc_id_{x}")) for x in "ab")
    tree = sums.filter(F.col("kind") == TREE).join(a, "sid_a").join(b, "sid_b").select("doc_id_a", "doc_id_b")
    return lowest, members, sums, copies.unionByName(tree)


def _members_of(pairs: DataFrame, members: DataFrame, sizes: DataFrame, side: str, by: str) -> DataFrame:
    """Each row of pairs with each document of its set sid_<side>, as column <side>.  Where a set has many documents, the rows are spread over tasks by column `by`."""
    sid = f"sid_{side}"
    parts = sizes.select(F.col("sid").alias(sid), F.ceil(F.col("k") / _COPIES).cast("int").alias("parts"))
    own = members.select(F.col("sid").alias(sid), F.col("id").alias(side)).join(parts, sid).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return pairs.join(parts, sid).withColumn("part", F.pmod(F.xxhash64(by), "parts").cast("int")).drop("parts").join(own, [sid, "part"]).drop("part")


def _by_id(pairs: DataFrame) -> DataFrame:
    """Pairs of ids a and b, the lower first; two sets of one id are no pair."""
    return pairs.filter("a <> b").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"), "jaccard").distinct()


def _set_join(docs: DataFrame, threshold: float, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the token sets that can have a partner: sid and rep, the lowest id with that set; sid and id of all its documents; the sets themselves for _pairs(), with the number of their documents that have no other set, and whether there are others."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    docs = docs_of(docs).filter("doc_id is not null")
    nb = shared_keys.buckets_for(docs)
    found = stored(shared_keys.sets_with_shared_keys(docs.mapInArrow(_texts_packed(n, nb), shared_keys.PACKED), threshold))
    # a set's number is its place in this table, so it has to be written before it is used
    lowest = stored(found.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")).withColumn("sid", F.monotonically_increasing_id()))
    members = stored(found.join(lowest, ["s1", "s2", "n"]).select("sid", "id").distinct())
    dropped(found)
    # the ids grow with the corpus, so they are never broadcast: the plan is the same at every size
    reps = docs.join(lowest.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    rows = stored(reps.mapInArrow(_grouped(n, threshold), TOKENS))
    # an id may have several texts: a row is known by its id and its set, and stays where it is the lowest with that set
    key = ["id", "s1", "s2", "n"]
    near = shared_keys.sets_with_shared_keys(rows.mapInArrow(_sets_packed(nb), shared_keys.PACKED), threshold).select(*key).distinct()
    near = stored(near.join(lowest.withColumnRenamed("rep", "id"), key))
    groups = _merged(rows.select(*key, "keys").join(near, key).select("sid", "keys"))
    several = _several(members).withColumn("several", F.lit(1))
    counts = members.join(several, "id", "left").groupBy("sid").agg(F.count(F.when(F.col("several").isNull(), 1)).alias("singles"), F.coalesce(F.max("several"), F.lit(0)).alias("marked"))
    near = near.join(groups, "sid").join(counts, "sid")
    sets = stored(rows.join(near.hint("merge"), key).dropDuplicates(key).select(F.col("sid").alias("id"), "n", "g", "sc", "singles", "marked", "tokens"))
    dropped(rows)
    dropped(groups)
    return lowest.select("sid", "rep"), members, sets


def _large(sizes: DataFrame) -> DataFrame:
    """g and blocks of the groups with more than GROUP_TOKENS tokens, from rows of g and n: one row in GROUP_TOKENS at most."""
    return stored(sizes.groupBy("g").agg(F.ceil(F.sum("n") / GROUP_TOKENS).cast("int").alias("blocks")).filter("blocks > 1"))


def _pairs(sets: DataFrame, t: float, compared, schema: str) -> DataFrame:
    """What `compared` makes of pairs of similar sets, which come once each; ids of sets are unique and stand for one token set each.

    Members of a large group are cut into blocks, and blocks are compared by
    pairs, so that no task has a whole large group.
    """
    block = lambda blocks: F.pmod(F.xxhash64("id"), blocks).cast("int")
    count = F.coalesce(F.col("blocks"), F.lit(1))
    every = F.explode(F.sequence(F.lit(0), count - 1))
    large = _large(sets)
    in_blocks = sets.join(large, "g", "left").withColumn("block", block(count)).drop("blocks")
    # a token of several blocks counts once; counting groups and dropping repeats share one shuffle by token
    matrix = in_blocks.groupBy("g", "block").applyInArrow(_union, "g bigint, sc int, tok bigint").repartition(F.col("tok")).dropDuplicates(["tok", "g", "sc"])
    matrix = stored(matrix.withColumn("groups", F.count("*").over(Window.partitionBy("tok"))).filter("groups > 1"))
    known = matrix.join(large, "g", "left").withColumn("block", every).drop("blocks")
    queries = in_blocks.groupBy("g", "block").cogroup(known.groupBy("g", "block")).applyInArrow(_looked_up(t), "id bigint, n int, g bigint, sc int, tok bigint")
    m = matrix.select(F.col("tok"), F.col("g").alias("g2"), F.col("sc").alias("sc2"))
    alpha = F.ceil(F.col("n") * F.lit(t) - F.lit(1e-9))
    needed = F.least(alpha - 1, F.floor(F.col("n") / 5)) + 1
    opened = queries.join(m, "tok").filter("g < g2 and abs(sc - sc2) <= 1").groupBy("id", "n", "g", "g2").agg(F.count("*").alias("met")).filter(F.col("met") >= needed)
    opened = stored(opened.select("id", "n", "g", "g2"))
    dropped(matrix)
    large = _large(sets.select("g", "n").unionByName(opened.select(F.col("g2").alias("g"), "n")))
    asked = opened.select("id", "g", "g2").join(sets.toDF(*sets.columns), ["id", "g"]).select("id", "n", F.col("g2").alias("g"), "sc", "singles", "marked", "tokens")
    cols = ["g", "a", "b", "id", "n", "sc", "singles", "marked", "tokens"]
    members = sets.join(large, "g", "left").withColumn("a", block(count))
    left = members.withColumn("b", every).select(cols)
    others = sets.toDF(*sets.columns).join(large, "g").withColumn("b", block(count)).withColumn("a", every).filter("a < b").select(cols)
    asking = asked.toDF(*asked.columns).join(large, "g", "left").withColumn("b", block(count)).withColumn("a", every).select(cols)
    return left.groupBy("g", "a", "b").cogroup(others.unionByName(asking).groupBy("g", "a", "b")).applyInArrow(compared, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of pairs (doc_id_a, doc_id_b): doc_id and group_id, the lowest id of its component.

    Labels spread to neighbours and then jump to the label of their label, so
    the rounds grow with the logarithm of a component's diameter.  Each round is
    written to the shared folder.  Documents in no pair are not in the result.
    """
    e = edges.select(F.col("doc_id_a").alias("u"), F.col("doc_id_b").alias("v")).filter("u is not null and v is not null and u <> v")
    e = stored(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = stored(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    while True:
        near = e.join(labels.select(F.col("u").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l"))
        one = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        two = labels.select(F.col("u").alias("label"), F.col("label").alias("jump"))
        new = stored(one.join(two, "label").select("u", "old", F.least("label", "jump").alias("label")))
        changed = new.filter("old <> label").limit(1).count()
        dropped(labels)
        labels = new.select("u", "label")
        if not changed:
            return labels.select(F.col("u").alias("doc_id"), F.col("label").alias("group_id"))


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, n: int = N_WORDS) -> DataFrame:
    """docs without those whose group of near copies holds a document with a lower id.

    Groups are the connected components of jaccard_join()'s pairs.  All columns stay.
    Rows with a null doc_id, and texts without a word, are kept.  Of rows that
    share a doc_id all are kept or none.
    """
    groups = components(_summed_join(docs, threshold, n)[3]).filter("doc_id <> group_id")
    (key,) = free(docs.columns, "id_of_group")
    return docs.join(groups.select(F.col("doc_id").alias(key)).hint("merge"), F.col("doc_id").cast("bigint") == F.col(key), "left_anti")
