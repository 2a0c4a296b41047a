"""Risk-controlled quality rules.

Each rule compares a statistic of a document with a cut-off.  The cut-offs come
from labelled documents, none of which shaped the statistics or the grids: in
each stratum (language) and for each rule, the grid is walked from the cut-off
that rejects least; a cut-off is valid if the exact binomial probability of as
few false rejections as were seen, were the true rate of false rejection above
the rule's share of the limit, is at most delta / (strata x rules).  The walk
ends at the first cut-off that isn't valid (fixed-sequence testing).  Of the valid
ones, that with the largest share of low-quality documents rejected less share of
good ones is used; a rule for which this is never above 0 isn't.  By the union bound, with probability 1 - delta no stratum
loses more than `limit` of its good documents to all rules together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shape, textcore
from .cluster import docs_of, need, stored

LIMIT, DELTA = 0.03, 0.05
#: name: (statistic, +1 to reject above the cut-off or -1 below, cut-offs from the one that rejects least)
RULES: dict[str, tuple[str, int, list[float]]] = {
    "symbols": ("symbol_share", 1, [round(0.5 - 0.01 * i, 4) for i in range(50)]),
    "capitals": ("upper_share", 1, [round(0.98 - 0.02 * i, 4) for i in range(49)]),
    "digits": ("digit_share", 1, [round(0.9 - 0.02 * i, 4) for i in range(45)]),
    "repetition": ("repeat_share", 1, [round(0.95 - 0.02 * i, 4) for i in range(48)]),
    "long_words": ("mean_word", 1, [round(40 - 0.5 * i, 4) for i in range(71)]),
    "short_words": ("mean_word", -1, [round(0.5 + 0.1 * i, 4) for i in range(36)]),
    "few_words": ("n_words", -1, [float(i) for i in range(1, 51)]),
}
STATISTICS = ("n_words", "mean_word", "symbol_share", "upper_share", "digit_share", "repeat_share")


def statistics(column) -> dict[str, np.ndarray]:
    """The statistics of each text; all are 0 for a text without words."""
    w, h = shape.ascii_words(column)
    c = shape.class_counts(w.buf, w.offsets)
    n = w.counts.astype(np.float64)
    dense = np.maximum(np.diff(w.offsets) - c["space"], 1)
    at_least = np.maximum(n, 1)
    return {
        "n_words": n,
        "mean_word": shape.sums(w.end - w.start, w.first) / at_least,
        "symbol_share": c["symbol"] / dense,
        "upper_share": c["upper"] / np.maximum(c["letter"], 1),
        "digit_share": c["digit"] / dense,
        "repeat_share": shape.sums(shape.repeats(h, w.docs()), w.first) / at_least,
    }


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in textcore.pieces(batch, "text"):
            s = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("stratum"), b.column("copy_of"), *(pa.array(s[k]) for k in STATISTICS)], ["doc_id", "stratum", "copy_of", *STATISTICS])


def described(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum ('' for a null), copy_of (a hash of the text, equal for equal texts) and the statistics of each row."""
    one = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    d = docs_of(docs, one.alias("stratum")).withColumn("copy_of", F.xxhash64("text"))
    return d.mapInArrow(_rows, "doc_id bigint, stratum string, copy_of bigint, " + ", ".join(f"{k} double" for k in STATISTICS))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed in logarithms."""
    if n == 0 or p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(min(k, n) + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def _step(rule: str) -> F.Column:
    """How many cut-offs of the rule's grid reject a row: it is rejected by cut-off i if this is more than len(grid) - 1 - i."""
    stat, way, grid = RULES[rule]
    cuts = F.array(*(F.lit(float(x)) for x in grid))
    x = F.col(stat)
    return F.aggregate(cuts, F.lit(0), lambda n, c: n + F.when((x > c) if way > 0 else (x < c), 1).otherwise(0))


def cut_offs(described_docs: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """The cut-off of each (stratum, rule) for which a valid one is of use.

    Equal texts of a stratum are one draw of the holdout, with the worst of their
    labels: copies aren't independent of each other, as the binomial bound asks.
    """
    need(labels, "doc_id", "quality")
    judged = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    held = described_docs.join(judged.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id")
    held = held.groupBy("stratum", "copy_of").agg(F.min("quality").alias("quality"), *(F.first(k).alias(k) for k in STATISTICS))
    one = held.select("stratum", "quality", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), _step(r).alias("step")) for r in RULES))).alias("x")).select("stratum", "quality", "x.rule", "x.step")
    counts: dict[tuple[str, str], tuple[dict[int, int], dict[int, int]]] = {}
    for r in one.groupBy("stratum", "rule", "quality", "step").count().collect():  # strata x rules x grid rows
        counts.setdefault((r["stratum"], r["rule"]), ({}, {}))[int(r["quality"] == 1)][r["step"]] = r["count"]
    tests, share, out = max(1, len(counts)), limit / len(RULES), {}
    for (s, rule), (low, good) in counts.items():
        grid, n, m, best = RULES[rule][2], sum(good.values()), sum(low.values()), 0.0
        for i, cut in enumerate(grid):
            false, true = (sum(c for step, c in by_step.items() if step > len(grid) - 1 - i) for by_step in (good, low))
            if binomial_tail(false, n, share) > delta / tests:
                break
            if m and true / m - false / n > best:
                best, out[s, rule] = true / m - false / n, cut
    return out


def _failed(cuts: dict[tuple[str, str], float]) -> F.Column:
    """The names of the rules that reject a row, joined by commas."""
    by_rule: dict[str, list] = {}
    for (s, rule), cut in sorted(cuts.items()):
        by_rule.setdefault(rule, []).append((s, cut))
    names = []
    for rule, own in by_rule.items():
        stat, way, _ = RULES[rule]
        m = F.create_map(*(x for s, c in own for x in (F.lit(s), F.lit(float(c)))))
        cut = F.try_element_at(m, F.col("stratum"))
        names.append(F.when((F.col(stat) > cut) if way > 0 else (F.col(stat) < cut), F.lit(rule)))
    return F.concat_ws(",", *names) if names else F.lit("")


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """doc_id, stratum, the statistics, failed (names of rules) and keep, one row for each row of docs.

    docs: doc_id, text and the stratum column (all rows are one stratum where it
    is missing); labels: doc_id, quality (1 = good).  Other columns aren't used.
    A null stratum is the stratum ''.  A null or empty text has statistics of 0.
    Rows with a null doc_id, and rows that share one, are each judged.  Of several
    labels of a doc_id the worse counts.  A stratum with too few labels for any
    guarantee has no cut-off, and all of it is kept.
    """
    # the texts are read once: cut-offs and result are made from their statistics
    d = stored(described(docs, stratum))
    failed = _failed(cut_offs(d, labels, limit, delta))
    return d.drop("copy_of").withColumn("failed", failed).withColumn("keep", F.col("failed") == "")


__all__ = ["apply_rules", "binomial_tail", "cut_offs", "described", "statistics"]
