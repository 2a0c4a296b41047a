"""Benchmark decontamination by size-partitioned MinHash containment search.

Documents and test items are sets of word k-grams.  Both sides are partitioned
by size (powers of two).  A document's sketch for one class of item sizes has b
bins and keeps the lowest hash in each (one-permutation MinHash); b grows with
the ratio of the document's size to the smallest item of the class, so that a
short item is found in a long document as surely as in a short one: an item of
which a share t is contained meets the sketch in about b*t*q/n bins, which is set
to at least -ln(miss).  Items that meet a sketch are candidates, and candidates
are verified by comparing the k-grams themselves.

There is one plan for every size of the benchmark.  A Bloom filter of the items'
keys, of FILTER_BITS bits at most, goes to every task; where it lets a sketch
through, the document's text goes on once with the keys let through.  These keys
are joined with the items' keys, and each document is verified in one place.  A
filter that is full lets more through, but changes no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore
from .cluster import docs_of, free, need, partitions, stored

U64 = np.uint64
K_WORDS = 5
THRESHOLD = 0.6
MISS = 1e-3
#: 64 bits a key give a false hit in ten million; 64 MB at most.
BITS_A_KEY, PROBES, FILTER_BITS = 64, 7, 1 << 29
_LOW = U64((1 << 44) - 1)


def _item_keys(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """44-bit keys of the items' shingles: key, index of the item, shingle width, size class of the item."""
    w = textcore.split_words(pa.array(texts, pa.large_string()))
    h, counts = w.hashes(), w.counts
    out = []
    for width in sorted({min(k, c) for c in counts.tolist()} - {0}):
        s, d, _ = w.shingles(width, h)
        own = np.minimum(counts[d], k) == width
        s, off = textcore.sets_of(s[own], d[own], len(counts))
        n = np.diff(off)
        who = np.repeat(np.arange(len(n)), n)
        out.append((s >> U64(20), who, np.full(len(s), width), np.floor(np.log2(np.repeat(n, n))).astype(np.int64)))
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _sketches(w: textcore.Words, h: np.ndarray, width: int, classes: list[int], t: float, miss: float, known: KeyFilter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By class of item sizes: the texts and lowest keys of all bins of their sketches, as far as the filter lets them through."""
    s, d, _ = w.shingles(width, h)
    if not len(s):
        return
    key = np.sort((d.astype(U64) << U64(44)) | (s >> U64(20)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    low, doc = key & _LOW, (key >> U64(44)).astype(np.int64)
    n = np.bincount(doc, minlength=len(w.first) - 1)
    most = 2.0 ** (np.floor(np.log2(np.maximum(n, 1))) + 1)
    ok = known.admits(low, width)
    # only texts that have any of the items' keys go on
    some = np.zeros(len(n), bool)
    some[doc[ok]] = True
    some = some[doc]
    low, doc, ok = low[some], doc[some], ok[some]
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    for c in classes:
        bins = np.ceil(-math.log(miss) * most / (t * 2.0**c))
        b = np.floor(low * (bins / 2.0**44)[doc])
        keep = first.copy()
        keep[1:] |= b[1:] != b[:-1]
        keep &= ok
        yield c, doc[keep], low[keep]


def _grams(text: str, width: int) -> set[bytes]:
    w = textcore.split_words(pa.array([text]))
    words = [w.buf[a:b].tobytes() for a, b in zip(w.start.tolist(), w.end.tolist())]
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def _item_grams(text: str, k: int) -> tuple[int, set[bytes]]:
    width = min(k, int(textcore.split_words(pa.array([text])).counts[0]))
    return width, _grams(text, width) if width else set()


OUT = "doc_id bigint, item_id bigint, containment double"


def _starts(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a key and its width; probe i of the filter is at the first plus i times the second."""
    with np.errstate(over="ignore"):
        x = textcore.mix(key.astype(U64) + (U64(width) << U64(48)))
        return x, textcore.mix(x) | U64(1)


class KeyFilter:
    """A Bloom filter over (key, width); bits: a power of two."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def admits(self, key: np.ndarray, width: int) -> np.ndarray:
        """For each key whether it may be an item's."""
        left = np.arange(len(key))
        x, step = _starts(key, width)
        for i in range(PROBES):
            with np.errstate(over="ignore"):
                at = (x + U64(i) * step) & U64(self.bits - 1)
            ok = (self.data[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
            left, x, step = left[ok], x[ok], step[ok]
        out = np.zeros(len(key), bool)
        out[left] = True
        return out


_BLOCK = 1 << 15


def _filter_rows(bits: int):
    """Bits of each batch's keys, as blocks of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, width = np.asarray(b.column("key")), np.asarray(b.column("width"))
            at = []
            for w in np.unique(width).tolist():
                x, step = _starts(key[width == w].view(U64), w)
                with np.errstate(over="ignore"):
                    at += [(x + U64(i) * step) & U64(bits - 1) for i in range(PROBES)]
            at = np.unique(np.concatenate(at)) if at else np.zeros(0, U64)
            block = (at // U64(_BLOCK)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
            data = []
            for x in np.split((at % U64(_BLOCK)).astype(np.int64), edge[1:]) if len(edge) else []:
                one = np.zeros(_BLOCK, np.uint8)
                one[x] = 1
                data.append(np.packbits(one, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(block[edge]), pa.array(data, pa.binary())], ["block", "data"])

    return run


def _either(table: pa.Table) -> pa.Table:
    data = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("data")]
    return pa.table({"block": table.column("block").slice(0, 1), "data": pa.array([np.bitwise_or.reduce(data).tobytes()], pa.binary())})


def _key_filter(keys: DataFrame, n: int) -> KeyFilter:
    """The filter of all n keys; its bits come to the driver, FILTER_BITS / 8 bytes at most."""
    bits = min(FILTER_BITS, max(_BLOCK, 1 << math.ceil(math.log2(BITS_A_KEY * max(1, n)))))
    rows = keys.mapInArrow(_filter_rows(bits), "block bigint, data binary").groupBy("block").applyInArrow(_either, "block bigint, data binary").collect()
    data = np.zeros(bits // 8, np.uint8)
    for r in rows:
        data[r["block"] * _BLOCK // 8 : (r["block"] + 1) * _BLOCK // 8] = np.frombuffer(r["data"], np.uint8)
    return KeyFilter(bits, data)


def _item_rows(k: int):
    def run(batches):
        for b in batches:
            key, who, widths, classes = _item_keys(b.column("item").to_pylist(), k)
            ids = b.column("item_id").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(widths.astype(np.int32)), pa.array(classes.astype(np.int32)), pa.array(ids[who])], ["key", "width", "class", "item_id"])

    return run


HIT = "doc_id bigint, text string, keys array<struct<key:bigint,width:int,class:int>>"


def _hit_rows(kinds: list[tuple[int, int]], known, t: float, miss: float):
    """Documents whose sketches the filter lets through, with the keys that it does; known: the filter, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in textcore.pieces(batch, "text"):
                w = textcore.split_words(b.column("text"))
                h, found = w.hashes(), []
                for width in sorted({x for x, _ in kinds}):
                    for c, doc, low in _sketches(w, h, width, [c for x, c in kinds if x == width], t, miss, known.value):
                        found.append((doc, low.view(np.int64), np.full(len(doc), width, np.int32), np.full(len(doc), c, np.int32)))
                if not found or not sum(len(x[0]) for x in found):
                    continue
                doc, *rest = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(doc, kind="stable")
                doc, rest = doc[order], [x[order] for x in rest]
                edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                rows = b.take(pa.array(doc[edge]))
                keys = pa.ListArray.from_arrays(pa.array(np.append(edge, len(doc)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in rest], ["key", "width", "class"]))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), keys], ["doc_id", "text", "keys"])

    return run


def _verify_rows(k: int, t: float):
    """Each document against its candidates; its k-grams are made once for each width."""

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                rows, seen = [], {}
                i, text, items = b.column("doc_id")[at].as_py(), b.column("text")[at].as_py(), b.column("items")[at].as_py()
                for o, item in ((x["item_id"], x["item"]) for x in items):
                    width, want = _item_grams(item, k)
                    if width not in seen:
                        seen[width] = _grams(text, width)
                    share = len(want & seen[width]) / len(want)
                    if share >= t - 1e-12:
                        rows.append((i, o, share))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "containment"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, k: int = K_WORDS, miss: float = MISS) -> DataFrame:
    """Pairs (doc_id, item_id, containment): at least `threshold` of the item's k-grams are in the document.

    docs: doc_id, text.  benchmark: item_id, text.  Other columns aren't used.
    An item of fewer than k words is one k-gram of all its words; an item, or a
    text, that is null or has no words is in no pair, nor is a row whose id is
    null.  Rows that share an id give a pair each, of which the highest
    containment is returned.  An item is missed with a probability of at most
    `miss`; what is returned is exact.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    need(benchmark, "item_id", "text")
    spark = docs.sparkSession
    docs = docs_of(docs).filter("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("item")).filter("item_id is not null and item is not null").distinct()
    # rows of one id are items of their own
    items = stored(items.withColumn("item_no", F.monotonically_increasing_id()))
    keys = stored(items.select(F.col("item_no").alias("item_id"), "item").repartition(partitions(spark)).mapInArrow(_item_rows(k), "key bigint, width int, class int, item_id bigint"))
    counts = {(r["width"], r["class"]): r["count"] for r in keys.groupBy("width", "class").count().collect()}  # k times the logarithm of an item's size at most
    kinds = sorted(counts)
    known = spark.sparkContext.broadcast(_key_filter(keys, sum(counts.values())))
    hits = stored(docs.mapInArrow(_hit_rows(kinds, known, threshold, miss), HIT).withColumn("row", F.monotonically_increasing_id()))
    asked = hits.select("row", F.explode("keys").alias("x")).select("row", "x.*")
    pairs = asked.join(keys.withColumnRenamed("item_id", "item_no"), ["key", "width", "class"]).select("row", "item_no").distinct()
    pairs = pairs.join(items, "item_no").groupBy("row").agg(F.collect_list(F.struct("item_id", "item")).alias("items"))
    found = hits.select("row", "doc_id", "text").join(pairs, "row").select("doc_id", "text", "items").mapInArrow(_verify_rows(k, threshold), OUT)
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, k: int = K_WORDS) -> DataFrame:
    """docs without those that contain an item of the benchmark; all columns stay, rows with a null doc_id too."""
    (bad,) = free(docs.columns, "contaminated")
    found = contaminated(docs, benchmark, threshold, k).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(found, F.col("doc_id").cast("bigint") == F.col(bad), "left_anti")


__all__ = ["contaminated", "without_benchmark"]
