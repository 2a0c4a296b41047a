"""Bag-of-words models over tables: document frequencies, similarity, n-gram coverage, one-hot features, thresholds."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import char_ngrams


def doc_words(docs: DataFrame, doc_id: str, words: str) -> DataFrame:
    """One row for each word of each document."""
    return docs.select(F.col(doc_id), F.explode(words).alias("word"))


def words_model(docs: DataFrame, doc_id: str, words: str) -> DataFrame:
    """word, df, idf = ln(N / df), for words in more than one document."""
    n = docs.agg(F.count("*").alias("n_docs"))
    d = docs.select(F.col(doc_id), F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("df")).filter("df > 1")
    return d.crossJoin(F.broadcast(n)).select("word", "df", F.ln(F.col("n_docs") / F.col("df")).alias("idf"))


def idf_of(words: DataFrame, model: DataFrame, n_docs: int) -> DataFrame:
    """idf of each word; ln(n_docs) for a word that the model hasn't."""
    return words.join(model.select("word", "idf"), "word", "left").withColumn("idf", F.coalesce("idf", F.ln(F.lit(float(n_docs)))))


def tfidf(docs: DataFrame, doc_id: str, words: str, model: DataFrame) -> DataFrame:
    """doc_id, word, w = tf * idf, for words of the model."""
    tf = doc_words(docs, doc_id, words).groupBy(doc_id, "word").agg(F.count("*").alias("tf"))
    return tf.join(model.select("word", "idf"), "word").select(doc_id, "word", (F.col("tf") * F.col("idf")).alias("w"))


def cosine_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Cosine of every pair of sparse vectors (id, word, w) that share a word with a weight; words without one, such as those of all documents, aren't joined."""
    norm = lambda d, i, n: d.groupBy(i).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(n), F.count("*").alias(n + "_size"))
    r = right.withColumnRenamed("w", "w2")
    dots = left.filter("w <> 0").join(r.filter("w2 <> 0"), "word").groupBy(left_id, right_id).agg(F.sum(F.col("w") * F.col("w2")).alias("dot"))
    return dots.join(norm(left, left_id, "n1"), left_id).join(norm(right, right_id, "n2"), right_id).withColumn("cosine", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("dot") / (F.col("n1") * F.col("n2"))).otherwise(0.0))


#: Cells of the matrix of one side's texts and words that is sent to every task; larger ones are joined.
MATRIX_CELLS = 8_000_000


def tfidf_cosine_above(left: DataFrame, right: DataFrame, left_id: str, right_id: str, words: str, least: float) -> DataFrame:
    """left_id, right_id and cosine of all pairs of texts whose vectors tf * idf have a cosine over least, which isn't negative.

    words is a column of arrays, '' in them isn't a word; idf is that of the
    right texts, for words in more than one of them.  The right texts' words are
    counted once and shuffled once by word: document frequencies are counted and
    joined there.  Where the left texts are few they go to the tasks as one
    matrix, and the vector of a right text is multiplied by it, so pairs below
    the threshold are made nowhere.  Otherwise vectors are joined by their words.
    """
    if least < 0:
        raise ValueError("least must not be negative")
    spark = left.sparkSession
    # of explode, Spark would infer a filter that splits every text once more before it is shuffled
    counted = lambda d, i: d.select(F.col(i), F.explode_outer(words).alias("word")).filter("word <> ''").groupBy(i, "word").agg(F.count("*").alias("tf"))
    t = counted(right, right_id).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    n = right.agg(F.count("*").alias("n_docs"))
    # all columns are read here too, so that both readers of t share one shuffle
    model = t.groupBy("word").agg(F.count(F.when(F.col("tf") > 0, F.struct(right_id))).alias("df")).filter("df > 1").crossJoin(F.broadcast(n)).select("word", F.ln(F.col("n_docs") / F.col("df")).alias("idf"))
    own = counted(left, left_id).limit(MATRIX_CELLS + 1).toArrow()
    ids, terms = (own.column(i).combine_chunks().dictionary_encode("encode") for i in (0, 1))
    tf, shape = np.asarray(own.column(2), np.float64), (len(terms.dictionary), len(ids.dictionary))
    if own.num_rows > MATRIX_CELLS or shape[0] * shape[1] > MATRIX_CELLS:
        vectors = lambda d, i: d.join(model, "word").select(i, "word", (F.col("tf") * F.col("idf")).alias("w"))
        return cosine_pairs(vectors(counted(left, left_id), left_id), vectors(t, right_id), left_id, right_id).filter(F.col("cosine") > least).select(left_id, right_id, "cosine")
    at, of = np.asarray(terms.indices), np.asarray(ids.indices)
    matrix = np.zeros(shape)
    matrix[at, of] = tf
    sent, block = spark.sparkContext.broadcast((ids.dictionary, matrix)), max(1, min(256, 2_000_000 // max(1, shape[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            norms = np.zeros(len(names))
            known = b.column("norms").slice(0, 1).flatten()
            norms[np.asarray(known.field("k"))] = np.asarray(known.field("n"))
            for start in range(0, b.num_rows, block):
                c = b.slice(start, block)
                v, size = c.column("v").flatten(), np.diff(np.asarray(c.column("v").offsets))
                x = np.zeros((c.num_rows, len(m)))
                x[np.repeat(np.arange(c.num_rows), size), np.asarray(v.field("at"))] = np.asarray(v.field("x"))
                by = np.asarray(c.column("n"), np.float64)[:, None] * norms
                cosine = np.divide(x @ m, by, out=np.zeros_like(by), where=by > 0)
                r, k = np.nonzero(cosine > least)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(k)), c.column(right_id).take(pa.array(r)), pa.array(cosine[r, k])], [left_id, right_id, "cosine"])

    small = lambda **columns: F.broadcast(spark.createDataFrame(pa.table(columns)))
    place = small(word=terms.dictionary.cast(pa.string()), at=np.arange(shape[0], dtype=np.int32))
    cells = small(word=terms.dictionary.cast(pa.string()).take(pa.array(at)), k=of.astype(np.int32), own_tf=tf)
    norm = lambda w: F.sqrt(F.sum(w * w))
    norms = model.join(cells, "word").groupBy("k").agg(norm(F.col("own_tf") * F.col("idf")).alias("n")).agg(F.collect_list(F.struct("k", "n")).alias("norms"))  # one row
    v = t.join(model.join(place, "word", "left").hint("shuffle_hash"), "word")
    w = F.col("tf") * F.col("idf")
    packed = v.groupBy(right_id).agg(norm(w).alias("n"), F.collect_list(F.when(F.col("at").isNotNull() & (w != 0), F.struct("at", (w * F.col("idf")).alias("x")))).alias("v"))
    kind = lambda d, c: d.schema[c].dataType.simpleString()
    return packed.filter(F.size("v") > 0).crossJoin(F.broadcast(norms)).mapInArrow(run, f"`{left_id}` {kind(left, left_id)}, `{right_id}` {kind(right, right_id)}, cosine double")


def same_text(left: DataFrame, right: DataFrame, left_id: str, right_id: str, scale: float = 0.5, enough: int = 15) -> DataFrame:
    """Probability that two texts are the same: cosine / scale, clipped, lowered where either has few words."""
    c = cosine_pairs(left, right, left_id, right_id)
    size = F.least(2 * F.col("n1_size"), F.col("n2_size"), F.lit(enough)) / F.lit(float(enough))
    return c.select(left_id, right_id, "cosine", (F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("cosine") / F.lit(scale))) * size).alias("same"))


def ngram_model(docs: DataFrame, text: str, n: int = 4, least: int = 2) -> DataFrame:
    """Character n-grams that occur at least `least` times."""
    return docs.select(F.explode(char_ngrams(text, n)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


#: N-grams of a model that is sent to every task; a larger one is joined.
MODEL_NGRAMS = 1_000_000


def ngram_score(docs: DataFrame, doc_id: str, text: str, model: DataFrame, n: int = 4) -> DataFrame:
    """covered: share of characters within frequent n-grams; matched: distinct ones found.

    A model of up to MODEL_NGRAMS n-grams goes to the tasks, and texts are
    scored where they are.  With a larger one n-grams are joined by equality, and
    the union of the overlapping intervals is a running maximum of their ends.
    """
    known = model.select("ngram").limit(MODEL_NGRAMS + 1)
    if (own := known.count()) <= MODEL_NGRAMS:
        return _ngram_score_here(docs, doc_id, text, [r[0] for r in known.collect()] if own else [], n)
    at = docs.select(doc_id, F.length(text).alias("len"), F.posexplode(char_ngrams(text, n)).alias("start", "ngram"))
    hit = at.join(model.select("ngram"), "ngram")
    w = Window.partitionBy(doc_id).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    hit = hit.withColumn("last", F.coalesce(F.max(F.col("start") + n).over(w), F.lit(0)))
    new = F.greatest(F.col("start") + n - F.greatest(F.col("start"), F.col("last")), F.lit(0))
    s = hit.groupBy(doc_id).agg(F.sum(new).alias("chars"), F.countDistinct("ngram").alias("matched"))
    base = docs.select(doc_id, F.length(text).alias("len"))
    return base.join(s, doc_id, "left").select(doc_id, F.when(F.col("len") > 0, F.coalesce("chars", F.lit(0)) / F.col("len")).otherwise(0.0).alias("covered"), F.coalesce("matched", F.lit(0)).alias("matched"))


class NgramSet:
    """Finds the places of a set of n-grams in texts: by a hash of each run of n code points, then by the code points themselves."""

    def __init__(self, ngrams: Sequence[str], n: int):
        own = sorted({g for g in ngrams if len(g) == n})
        self.n, codes = n, self.codes_of("".join(own)).reshape(-1, n)
        # two n-grams of one hash are very rare; another factor tells them apart
        for self.factor in np.random.default_rng(len(own)).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1):
            h = self.hashes(codes.reshape(-1))[::n] if len(own) else np.zeros(0, np.uint64)
            order = np.argsort(h)
            self.known, self.codes = h[order], codes[order]
            if (self.known[1:] != self.known[:-1]).all():
                break
        else:
            raise ValueError("no factor tells the n-grams apart")
        self.shift = np.uint64(64 - max(10, (16 * len(own)).bit_length()))
        self.filter = np.zeros(1 << int(np.uint64(64) - self.shift), bool)
        self.filter[self.known >> self.shift] = True

    @staticmethod
    def codes_of(s: str) -> np.ndarray:
        return np.frombuffer(s.encode("utf-32-le"), np.uint32)

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """One for each run of n code points."""
        m = len(codes) - self.n + 1
        c = codes.astype(np.uint64)
        h = c[:m].copy()
        for j in range(1, self.n):
            h *= self.factor
            h += c[j : j + m]
        h ^= h >> np.uint64(29)
        h *= self.factor
        return h

    def find(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place in it and n-gram of all that are found, in order."""
        codes, size = self.codes_of("".join(texts)), np.array([len(t) for t in texts], np.int64)
        if len(codes) < self.n or not len(self.known):
            return (np.zeros(0, np.int64),) * 3
        h, end = self.hashes(codes), np.cumsum(size)
        at = np.flatnonzero(self.filter[h >> self.shift])
        h = h[at]
        k = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        text = np.searchsorted(end, at, side="right")
        same = (self.known[k] == h) & (at + self.n <= end[text])
        at, k, text = at[same], k[same], text[same]
        same = (codes[at[:, None] + np.arange(self.n)] == self.codes[k]).all(axis=1)
        at, k, text = at[same], k[same], text[same]
        return text, at - (end - size)[text], k


#: Characters of texts that are searched at a time.
SEARCHED = 1 << 18


def _ngram_score_here(docs: DataFrame, doc_id: str, text: str, ngrams: list[str], n: int) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(NgramSet(ngrams, n))

    def scores(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        of, at, k = model.value.find(texts)
        new = np.full(len(at), n)
        near = of[1:] == of[:-1]
        new[1:][near] = np.minimum(n, at[1:] - at[:-1])[near]
        chars = np.bincount(of, weights=new, minlength=len(texts))
        pair = np.unique(of * np.int64(len(model.value.known) + 1) + k)
        size = np.array([len(t) for t in texts])
        return chars / np.maximum(size, 1), np.bincount(pair // (len(model.value.known) + 1), minlength=len(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(b.column(text)), 0)).astype(np.int64))
            start = 0
            while start < b.num_rows:  # at least one text, and as many as SEARCHED characters are
                stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SEARCHED, side="right")))
                own = b.slice(start, stop - start)
                covered, matched = scores([t or "" for t in own.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([own.column(doc_id), pa.array(covered, pa.float64()), pa.array(matched, pa.int64())], [doc_id, "covered", "matched"])
                start = stop

    spread = docs.select(doc_id, text).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), doc_id, F.length(text))  # many characters are few bytes to read
    return spread.mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, covered double, matched bigint")


def _best(q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates (a query's row, an item's id, their cosine) each query's k best, of equal ones those of lower ids."""
    order = np.lexsort((ids, -c, q))
    q, ids, c = q[order], ids[order], c[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], ids[rank < k], c[rank < k]


class _Search:
    """The k best items of a block of queries, over blocks of items that come one after the other."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.least = np.full(len(ids), -np.inf)  # the k-th best so far
        self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        c = self.rows @ rows.T
        own = np.flatnonzero(np.isin(ids, self.ids))
        a, j = np.nonzero(self.ids[:, None] == ids[own][None, :])
        c[a, own[j]] = -np.inf
        least = self.least
        if len(first := np.flatnonzero(np.isneginf(least))) and len(ids) > self.k:
            least = least.copy()
            least[first] = np.partition(c[first], len(ids) - self.k, axis=1)[:, len(ids) - self.k]
        # all that are as good as the k-th but for rounding, so that ties are settled by id
        q, j = np.nonzero(c >= least[:, None] - 1e-12)
        q, j = (x[np.isfinite(c[q, j])] for x in (q, j))
        if not len(q):
            return
        # summed alike wherever a vector is in its block, so that equal vectors have equal cosines
        exact = np.concatenate([np.einsum("ij,ij->i", self.rows[q[i : i + 65_536]], rows[j[i : i + 65_536]]) for i in range(0, len(q), 65_536)])
        self.found = _best(*(np.concatenate(x) for x in zip(self.found, (q, ids[j], exact))), self.k)
        n = np.bincount(self.found[0], minlength=len(self.ids))
        full = np.flatnonzero(n >= self.k)
        self.least[full] = self.found[2][(np.cumsum(n) - 1)[full]]

    def batch(self) -> pa.RecordBatch:
        q, ids, c = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(ids), pa.array(c)], ["q", "id", "c"])


def cosine_top_k(queries: DataFrame, items: DataFrame, key: str, vector: str, k: int, block: int = 1024) -> DataFrame:
    """q, id, r: the k items most similar to each query by cosine (of equal ones the lower id), a query itself left out.

    Both sides are packed into blocks of rows, the queries' spread over tasks.  A
    task takes a block of queries through the blocks of a part of the items, each
    pair one matrix product, and keeps k candidates a query; these are ranked.
    Memory is that of one pair of blocks and one Arrow batch.
    """
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packed(df: DataFrame, side: str, rows: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    c = b.slice(at, rows)
                    v = c.column("v")
                    x = np.asarray(v.flatten(), np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([np.asarray(c.column("id"), np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], [f"{side}_ids", f"{side}_rows"])

        return df.mapInArrow(run, f"{side}_ids binary, {side}_rows binary")

    def vectors(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null")

    def unit(ids: pa.Scalar, rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        i = np.frombuffer(ids.as_buffer(), np.int64)
        x = np.frombuffer(rows.as_buffer(), np.float64).reshape(len(i), -1)
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return i, x / np.where(n > 0, n, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, search = None, None
        for b in batches:
            q_ids, q_rows, i_ids, i_rows = (b.column(n) for n in ("q_ids", "q_rows", "i_ids", "i_rows"))
            for r in range(b.num_rows):
                if search is None or not (q_ids[r].as_buffer().equals(now[0]) and q_rows[r].as_buffer().equals(now[1])):
                    if search is not None:
                        yield search.batch()
                    now = pa.py_buffer(q_ids[r].as_py()), pa.py_buffer(q_rows[r].as_py())
                    search = _Search(*unit(q_ids[r], q_rows[r]), k)
                search.add(*unit(i_ids[r], i_rows[r]))
        if search is not None:
            yield search.batch()

    # blocks of items are shuffled once into few parts, each of which every task reads
    left, right = packed(vectors(queries).repartition(tasks, "id"), "q", block), packed(vectors(items), "i", 2 * block).repartition(max(1, tasks // 8))
    pairs = left.crossJoin(right).mapInArrow(run, "q bigint, id bigint, c double")
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("c"), "id"))).filter(F.col("r") <= k).select("q", "id", "r")


# ---- one-hot


def one_hot(value: Column | str, classes: Sequence, unknown: str = "error") -> Column:
    """array<double> with 1 at the class; null gives zeros, an unknown value an error or zeros."""
    v = F.col(value) if isinstance(value, str) else value
    known = v.isin(*classes)
    vec = F.array(*(F.when(v == c, 1.0).otherwise(0.0) for c in classes))
    if unknown != "error":
        return vec
    return F.when(v.isNull() | known, vec).otherwise(F.raise_error(F.concat(F.lit("unknown class: "), v.cast("string"))).cast("array<double>"))


def one_hot_multi(values: Column | str, classes: Sequence) -> Column:
    v = F.col(values) if isinstance(values, str) else values
    return F.array(*(F.when(F.array_contains(v, c), 1.0).otherwise(0.0) for c in classes))


def decode(vector: Column | str, classes: Sequence, none_threshold: float | None = None) -> Column:
    """The class of the largest value; null if that is below the threshold."""
    v = F.col(vector) if isinstance(vector, str) else vector
    best = F.element_at(F.array(*(F.lit(c) for c in classes)), F.array_position(v, F.array_max(v)).cast("int"))
    return best if none_threshold is None else F.when(F.array_max(v) >= none_threshold, best)


def decode_multi(vector: Column | str, classes: Sequence, threshold: float = 0.5) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.filter(F.array(*(F.when(F.element_at(v, i + 1) >= threshold, F.lit(c)) for i, c in enumerate(classes))), lambda x: x.isNotNull())


class OneHotFrame:
    """Categorical columns as 0/1 columns; classes are counted once by fit."""

    def __init__(self, columns: Sequence[str], max_vals: int | None = None, min_freq: int = 0, sort: bool = True):
        self.columns, self.max_vals, self.min_freq, self.sort = list(columns), max_vals, min_freq, sort
        self.classes: dict[str, list] = {}

    def fit(self, df: DataFrame) -> OneHotFrame:
        for c in self.columns:
            counts = df.filter(F.col(c).isNotNull()).groupBy(c).count().filter(F.col("count") > self.min_freq).orderBy(F.desc("count"), c)
            rows = (counts.limit(self.max_vals) if self.max_vals else counts).collect()  # the classes
            values = [r[0] for r in rows]
            self.classes[c] = sorted(values) if self.sort else values
        return self

    def names(self, c: str) -> list[str]:
        return [re.sub(r"[^a-zA-Z0-9]+", "_", f"{c}_{v}") for v in self.classes[c]]

    def transform(self, df: DataFrame) -> DataFrame:
        out: list[Column] = []
        for c in df.columns:
            if c not in self.classes:
                out.append(F.col(c))
            else:
                out += [F.when(F.col(c) == v, 1).otherwise(0).alias(n) for v, n in zip(self.classes[c], self.names(c))]
        return df.select(*out)


def best_threshold(df: DataFrame, score: str, label: str, steps: int = 100) -> DataFrame:
    """threshold (0, 0.01, ...) with the best F1 for score > threshold, the lowest of equal ones; f1.

    Scores are counted by grid step first, so the grid never meets the rows.
    """
    first = F.least(F.greatest(F.ceil(F.round(F.col(score) * steps, 9)), F.lit(0)), F.lit(steps)).cast("int")  # thresholds k/steps with k < first pass
    binned = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(first.alias("b")).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("pos"), F.count("*").alias("n"))
    grid = df.sparkSession.range(steps).select(F.col("id").alias("k"))
    above = grid.crossJoin(F.broadcast(binned)).groupBy("k").agg(F.sum(F.when(F.col("b") > F.col("k"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("b") > F.col("k"), F.col("n")).otherwise(0)).alias("pp"), F.sum("pos").alias("p"))
    f1 = F.when(F.col("pp") + F.col("p") > 0, 2.0 * F.col("tp") / (F.col("pp") + F.col("p"))).otherwise(0.0)
    return above.withColumn("f1", f1).orderBy(F.desc("f1"), "k").limit(1).select((F.col("k") / F.lit(float(steps))).alias("threshold"), "f1")
