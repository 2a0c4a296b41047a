"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Each passage is encoded: word
evidence for low quality and for toxicity (log-odds learned from labelled
documents), shares of character classes, repetition and word lengths.  A layer
turns the encoding into a representation h; gated attention, tanh(Vh) * sigm(Uh)
with a weight vector for each label, weighs a document's passages; a label's
score is read from the weighted sum of h.  Only document labels are needed.

The model is fitted on a bounded sample of labelled rows (max_labelled, chosen by
a hash of doc_id); three disjoint parts of it give the word evidence, the network
and the two cut-offs.  Every document is scored, over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shape, textcore
from .cluster import docs_of, need

PASSAGE = 64
MAX_LABELLED = 8000
#: Bound of the sample's texts in bytes; they are on the driver at once.
MAX_BYTES = 64 << 20
FALSE_REJECTION = 0.005
HIDDEN, ATTENTION = 16, 12
HEADS = ("quality", "toxic")


@dataclass
class Lexicon:
    """Log-odds of words, one column for each head; words are sorted hashes."""

    words: np.ndarray
    odds: np.ndarray

    def look_up(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros((len(h), len(HEADS)), np.float32)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where((self.words[at] == h)[:, None], self.odds[at], np.float32(0))


def learn_lexicon(column: pa.Array, labels: np.ndarray, least: int = 3) -> Lexicon:
    """Words whose presence changes the odds of a label, by shrunken log-odds over documents."""
    found, at = [], 0
    for b in textcore.pieces(pa.table({"text": column}), "text"):
        w, h = shape.ascii_words(b.column("text"))
        words, off = textcore.sets_of(h, w.docs(), b.num_rows)
        found.append((words, np.repeat(np.arange(at, at + b.num_rows, dtype=np.int32), np.diff(off))))
        at += b.num_rows
    words, docs = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
    vocab, inverse, df = np.unique(words, return_inverse=True, return_counts=True)
    odds = np.zeros((len(vocab), len(HEADS)), np.float32)
    for k in range(len(HEADS)):
        y = labels[:, k] > 0
        with_ = np.bincount(inverse, weights=y[docs], minlength=len(vocab))
        p, n = with_ + 0.5, df - with_ + 0.5
        base = np.log((y.sum() + 0.5) / ((~y).sum() + 0.5))
        odds[:, k] = (np.log(p / n) - base) * df / (df + 4.0)
    keep = (df >= least) & (np.abs(odds).max(axis=1, initial=0) > 0.7)
    return Lexicon(vocab[keep], odds[keep])


def encode(column, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages of the texts, and the first passage of each text.

    A text has at least one passage, which is empty where it has no words.
    """
    w, h = shape.ascii_words(column)
    counts = w.counts
    per = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(counts)), per)
    start = w.first[doc] + (np.arange(first[-1]) - first[doc]) * PASSAGE
    edge = np.append(start, len(h))
    last = np.minimum(start + PASSAGE, w.first[doc + 1])
    begins = w.offsets[doc].copy()
    inner = np.arange(first[-1]) > first[doc]
    begins[inner] = w.start[start[inner]]
    n_bytes = np.diff(np.append(begins, len(w.buf)))
    c = shape.class_counts(w.buf, np.append(begins, len(w.buf)))
    n = np.maximum(last - start, 1).astype(np.float64)
    odds = lexicon.look_up(h)
    cols = []
    for k in range(len(HEADS)):
        o = odds[:, k]
        cols += [shape.sums(np.maximum(o, 0), edge) / np.sqrt(n), shape.sums(np.minimum(o, 0), edge) / np.sqrt(n)]
        top = np.zeros(len(n))
        some = last > start
        if some.any():
            top[some] = np.maximum.reduceat(o, start[some])
        cols.append(np.maximum(top, 0))
    dense = np.maximum(n_bytes - c["space"], 1)
    cols += [c["upper"] / np.maximum(c["letter"], 1), c["digit"] / dense, c["symbol"] / dense, c["stop"] / dense]
    cols += [shape.sums(shape.repeats(h, w.docs()), edge) / n, shape.sums(w.end - w.start, edge) / n / 10, np.log1p(n) / 4]
    key = (np.repeat(np.arange(len(n), dtype=np.uint64), last - start) << np.uint64(40)) | (h >> np.uint64(24))
    key = np.sort(key)
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    cols.append(np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(n)) / n)
    return np.stack(cols, axis=1).astype(np.float32), first


def encode_all(column: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """encode(), piece by piece, so that memory doesn't grow with the text."""
    parts = [encode(b.column("text"), lexicon) for b in textcore.pieces(pa.table({"text": column}), "text")]
    size = np.concatenate([np.diff(f) for _, f in parts])
    return np.concatenate([x for x, _ in parts]), np.concatenate([[0], np.cumsum(size)])


def _softmax(e: np.ndarray, first: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(e, first[:-1], axis=0)
    x = np.exp(e - np.repeat(top, np.diff(first), axis=0))
    return x / np.repeat(np.add.reduceat(x, first[:-1], axis=0), np.diff(first), axis=0)


@dataclass
class Model:
    """The encoder's scaling, the network's weights and the cut-offs."""

    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    cut: np.ndarray

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["w"] + p["b"])
        v, u = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        # scaled with the logarithm of the number of passages, so that one of many can still stand out
        n = np.diff(first)
        s = np.repeat(1 + np.log(n), n)[:, None]
        a = _softmax(((v * u) @ p["a"]) * s, first)
        z = np.stack([np.add.reduceat(a[:, k : k + 1] * h, first[:-1], axis=0) for k in range(len(HEADS))], axis=1)
        logit = (z * p["o"]).sum(axis=2) + p["c"]
        return {"x": x, "h": h, "v": v, "u": u, "s": s, "a": a, "z": z, "prob": 1 / (1 + np.exp(-np.clip(logit, -40, 40)))}

    def score(self, column) -> np.ndarray:
        """Probability of each head for each text."""
        x, first = encode(column, self.lexicon)
        return self.forward(x, first)["prob"]


def _gradient(m: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    f, p = m.forward(x, first), m.p
    n = np.diff(first)
    d = (f["prob"] - y) * weight / len(y)
    g = {"c": d.sum(axis=0), "o": (d[:, :, None] * f["z"]).sum(axis=0)}
    dz = np.repeat(d[:, :, None] * p["o"], n, axis=0)
    dh = (dz * f["a"][:, :, None]).sum(axis=1)
    da = (dz * f["h"][:, None, :]).sum(axis=2)
    mean = np.repeat(np.add.reduceat(da * f["a"], first[:-1], axis=0), n, axis=0)
    de = f["a"] * (da - mean) * f["s"]
    g["a"] = (f["v"] * f["u"]).T @ de
    dvu = de @ p["a"].T
    dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
    g["v"], g["u"] = f["h"].T @ dv, f["h"].T @ du
    dh += dv @ p["v"].T + du @ p["u"].T
    dx = dh * (1 - f["h"] ** 2)
    g["w"], g["b"] = f["x"].T @ dx, dx.sum(axis=0)
    return g


def train(column: pa.Array, labels: np.ndarray, part: np.ndarray, steps: int = 400, seed: int = 7, false_rejection: float = FALSE_REJECTION) -> Model:
    """labels: 0/1 by head, quality stored as 1 = low; part: 0 word evidence, 1 network, 2 cut-offs."""
    take = lambda k: (column.filter(pa.array(part == k)), labels[part == k])
    lexicon = learn_lexicon(*take(0))
    x, first = encode_all(take(1)[0], lexicon)
    y = take(1)[1].astype(np.float32)
    rng = np.random.default_rng(seed)
    r = lambda *s: (rng.standard_normal(s) * (1 / np.sqrt(s[0]))).astype(np.float32)
    p = {"w": r(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": r(HIDDEN, ATTENTION), "u": r(HIDDEN, ATTENTION), "a": r(ATTENTION, len(HEADS)), "o": r(len(HEADS), HIDDEN), "c": np.zeros(len(HEADS), np.float32)}
    m = Model(lexicon, x.mean(axis=0), x.std(axis=0) + 1e-3, p, np.full(len(HEADS), 0.5))
    weight = np.where(y > 0, np.minimum(10, 0.5 / np.maximum(y.mean(axis=0), 1e-6)), 1).astype(np.float32)
    one, two = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        g = _gradient(m, x, first, y, weight)
        for k in p:
            grad = g[k] + 1e-4 * p[k]
            one[k] = 0.9 * one[k] + 0.1 * grad
            two[k] = 0.999 * two[k] + 0.001 * grad**2
            p[k] = (p[k] - 0.02 * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    held, y = take(2)
    if len(y):
        prob = m.forward(*encode_all(held, lexicon))["prob"]
        clean = prob[(y == 0).all(axis=1)]
        if len(clean):
            m.cut = np.maximum(0.5, np.quantile(clean, 1 - false_rejection / len(HEADS), axis=0))
            m.cut = np.minimum(m.cut, 0.95)
    return m


def fitted(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 7, max_bytes: int = MAX_BYTES) -> Model | None:
    """The model, from at most max_labelled labelled documents with at most max_bytes of text (the lowest by a hash of doc_id); None without labels."""
    need(labels, "doc_id", "quality", "toxic")
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna()
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = rows.withColumn("at", F.xxhash64("doc_id", F.lit(seed))).orderBy("at", "doc_id").limit(max_labelled)
    sample = docs_of(docs).join(F.broadcast(rows), "doc_id").filter("text is not null").select("at", "doc_id", "text", "quality", "toxic")
    # where the sample's texts reach max_bytes, it ends: sizes of at most max_labelled rows are summed in order
    sizes = sample.select("at", F.octet_length("text").cast("bigint").alias("n")).orderBy("at").limit(max_labelled)
    total = sizes.withColumn("total", F.sum("n").over(Window.orderBy("at")))
    last = total.filter(F.col("total") <= max_bytes).agg(F.max("at").alias("at")).first()["at"]
    if last is None:
        return None
    sample = sample.filter(F.col("at") <= last)
    t = sample.toArrow().sort_by([("at", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    if t.num_rows < 3:
        return None
    y = np.stack([1 - np.asarray(t.column("quality"), np.int64), np.asarray(t.column("toxic"), np.int64)], axis=1)
    # copies of one text fall into one part
    h = np.array([hash_of(x) for x in t.column("text").to_pylist()], np.uint64) % np.uint64(20)
    part = np.where(h < 11, 0, np.where(h < 16, 1, 2))
    if any((part == k).sum() == 0 for k in (0, 1)):
        part[:] = np.arange(len(part)) % 2
    return train(textcore.strings(t.column("text")), y, part, seed=seed)


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in textcore.pieces(batch, "text"):
                p = model.score(b.column("text"))
                keep = (p <= model.cut).all(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 - p[:, 0].astype(np.float64)), pa.array(p[:, 1].astype(np.float64)), pa.array(keep)], ["doc_id", "quality_score", "toxic_score", "keep"])

    return run


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, quality_score, toxic_score (probabilities) and keep, one row for each row of docs.

    docs: doc_id, text; labels: doc_id, quality (1 = good), toxic (1 = toxic);
    other columns aren't used.  Labels with a null are left out; of several
    labels of a doc_id the worse counts.  A null or empty text is one empty
    passage and is scored like any other.  Rows with a null doc_id, and rows that
    share one, are each scored.  Without labelled documents the scores are null
    and everything is kept.
    """
    model = fitted(docs, labels, max_labelled)
    docs = docs_of(docs)
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("quality_score"), F.lit(None).cast("double").alias("toxic_score"), F.lit(True).alias("keep"))
    return docs.mapInArrow(_scores(model), "doc_id bigint, quality_score double, toxic_score double, keep boolean")


def _filter(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in textcore.pieces(batch, "text"):
                yield b.filter(pa.array((model.score(b.column("text")) <= model.cut).all(axis=1)))

    return run


def accepted(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs without those that classify() doesn't keep, with all columns, in one pass without a shuffle."""
    model = fitted(docs, labels, max_labelled)
    return docs if model is None else docs.mapInArrow(_filter(model), docs.schema)
