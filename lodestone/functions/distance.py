"""Weighted edit distance and alignments, as Arrow UDFs; dynamic programming by rows or anti-diagonals in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import C, col, per_value


def edit_distance(a: str, b: str, case_cost: float = 1.0, space_cost: float = 1.0) -> float:
    """Edits from a to b; a change of case only, and spaces put in, left out or replaced, have costs of their own."""
    gap = lambda c: space_cost if c.isspace() else 1.0
    cost_b = np.array([gap(c) for c in b])
    row = np.concatenate([[0.0], np.cumsum(cost_b)])
    run = row.copy()
    low_b, chars = np.array([c.lower() for c in b], dtype=object), np.array(list(b), dtype=object)
    for c in a:
        sub = np.where(chars == c, 0.0, np.where(low_b == c.lower(), case_cost, np.maximum(cost_b, gap(c)))) if len(b) else np.zeros(0)
        best = np.empty_like(row)
        best[0] = row[0] + gap(c)
        best[1:] = np.minimum(row[1:] + gap(c), row[:-1] + sub)
        # insertions: best[j] = min over k <= j of best[k] + cost of b[k:j]
        row = np.minimum.accumulate(best - run) + run
    return float(row[-1])


def levenshtein(a: C, b: C, case_cost: float = 1.0, space_cost: float = 1.0) -> Column:
    """Edit distance; plain costs use the built-in function."""
    if case_cost == 1.0 and space_cost == 1.0:
        return F.levenshtein(col(a), col(b)).cast("double")

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(per_value(lambda p, q: edit_distance(p, q, case_cost, space_cost), x, y), dtype="float64")

    return run(col(a), col(b))


def leven_dist(a: C, b: C, case_cost: float = 0.5, space_cost: float = 0.5) -> Column:
    """Distance divided by the longer length: 0 for equal texts, 1 where one is empty."""
    n = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(col(a) == col(b), 0.0).when((F.length(col(a)) == 0) | (F.length(col(b)) == 0), 1.0).otherwise(levenshtein(a, b, case_cost, space_cost) / n)


def leven_score(a: C, b: C, case_cost: float = 0.5, space_cost: float = 0.5) -> Column:
    return F.lit(1.0) - leven_dist(a, b, case_cost, space_cost)


def align_pair(s1: str, s2: str, mismatch=None, gap_cost: float = 1.0, gap: str = "_", substring: bool = False) -> tuple[str, str, float]:
    """Alignment of least cost.  Of equal ways back: a gap in s1 first, then a gap in s2, then a substitution.

    mismatch(c1, c2) is the cost of a substitution, 1 for different characters by
    default.  With substring, what of s2 lies before and after s1 costs nothing.
    """
    n, m = len(s1), len(s2)
    cost = mismatch or (lambda p, q: 0.0 if p == q else 1.0)
    d = np.zeros((n + 1, m + 1))
    d[:, 0] = np.arange(n + 1) * gap_cost
    d[0, :] = 0 if substring else np.arange(m + 1) * gap_cost
    run = np.arange(m + 1) * gap_cost
    for i in range(1, n + 1):
        sub = np.array([cost(s1[i - 1], q) for q in s2])
        best = np.empty(m + 1)
        best[0] = d[i, 0]
        best[1:] = np.minimum(d[i - 1, 1:] + gap_cost, d[i - 1, :-1] + sub)
        d[i] = np.minimum.accumulate(best - run) + run
    i, j = n, int(d[n].argmin()) if substring else m
    total, a, b = float(d[n, j]), [], []
    if substring:
        a, b = [gap] * (m - j), list(reversed(s2[j:]))
    eps = 1e-9
    while i or j:
        if substring and i == 0:
            a += [gap] * j
            b += list(reversed(s2[:j]))
            break
        if j and abs(d[i, j] - d[i, j - 1] - gap_cost) < eps:
            a.append(gap)
            b.append(s2[j - 1])
            j -= 1
        elif i and abs(d[i, j] - d[i - 1, j] - gap_cost) < eps:
            a.append(s1[i - 1])
            b.append(gap)
            i -= 1
        else:
            a.append(s1[i - 1])
            b.append(s2[j - 1])
            i, j = i - 1, j - 1
    return "".join(reversed(a)), "".join(reversed(b)), total


def align(a: C, b: C, gap_cost: float = 1.0, gap: str = "_", substring: bool = False) -> Column:
    """struct(a1, a2, dist) of two texts."""

    @F.pandas_udf("a1 string, a2 string, dist double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = per_value(lambda p, q: align_pair(p, q, None, gap_cost, gap, substring), x, y)
        return pd.DataFrame([r or (None, None, None) for r in rows], columns=["a1", "a2", "dist"])

    return run(col(a), col(b))


def find_substring(query: str, text: str) -> tuple[int, int, float]:
    """Where text is most like query: begin, end, distance."""
    a, _, dist = align_pair(query, text, substring=True)
    inner = [i for i, c in enumerate(a) if c != "_"]
    if not inner:
        return 0, 0, dist
    _, b, _ = align_pair(query, text, substring=True, gap="\0")
    before = sum(c != "\0" for c in b[: inner[0]])
    return before, before + sum(c != "\0" for c in b[inner[0] : inner[-1] + 1]), dist


def align_substring(query: C, text: C) -> Column:
    """struct(start, stop, dist) of the part of text that is most like query."""

    @F.pandas_udf("start int, stop int, dist double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([r or (None, None, None) for r in per_value(find_substring, x, y)], columns=["start", "stop", "dist"])

    return run(col(query), col(text))


class Fuzzy:
    """A text whose positions are frequencies of characters."""

    def __init__(self, charset: str, freq: np.ndarray):
        self.charset, self.freq = charset, freq

    @classmethod
    def of(cls, s: str, charset: str, weight: float = 1.0) -> Fuzzy:
        f = np.zeros((len(s), len(charset)))
        f[np.arange(len(s)), [charset.index(c) for c in s]] = weight
        return cls(charset, f)

    @classmethod
    def merge(cls, items: list[Fuzzy], weights: list[float] | None = None, norm: bool = True) -> Fuzzy:
        total = sum(w * x.freq for w, x in zip(weights or [1.0] * len(items), items))
        if norm:
            s = total.sum(axis=1, keepdims=True)
            total = np.divide(total, s, out=np.zeros_like(total), where=s > 0)
        return cls(items[0].charset, total)

    def discretize(self, min_freq: float = 0.0, unknown: str = "?") -> str:
        """The most frequent character of each position, of equal ones the first in the charset."""
        return "".join(self.charset[k] if f[k] >= min_freq else unknown for f, k in zip(self.freq, self.freq.argmax(axis=1))) if len(self.freq) else ""

    def append(self, other: Fuzzy) -> Fuzzy:
        """Positions of both, one after the other."""
        return Fuzzy(self.charset, np.concatenate([self.freq, other.freq]))

    def convert(self, charset: str) -> Fuzzy:
        """The same frequencies over another charset, which has all characters that occur."""
        used = [i for i in range(len(self.charset)) if self.freq[:, i].any()]
        freq = np.zeros((len(self.freq), len(charset)))
        freq[:, [charset.index(self.charset[i]) for i in used]] = self.freq[:, used]
        return Fuzzy(charset, freq)

    def mismatch(self, other: Fuzzy, cost: np.ndarray | None = None) -> np.ndarray:
        """Expected cost of each position of one against each of the other; by default 1 for different characters."""
        c = 1.0 - np.eye(len(self.charset)) if cost is None else cost
        a, b = self.freq, other.freq
        a, b = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-300), b / np.maximum(b.sum(axis=1, keepdims=True), 1e-300)
        return a @ c @ b.T

    def distance(self, other: Fuzzy, p: int = 1) -> float:
        d = np.abs(self.freq - other.freq)
        return float(d.sum() / 2 if p == 1 else np.sqrt((d**2).sum(axis=1)).sum())

    def regexify(self, gap: str = "_", any_: str = ".", min_freq: float = 0.0) -> str:
        """A pattern: runs of the same set of characters with their numbers of repetitions."""
        import re
        from itertools import groupby

        def code(f: np.ndarray) -> tuple[str, bool]:
            chars = [c for c, x in zip(self.charset, f) if x > min_freq]
            optional = gap in chars
            chars = [c for c in chars if c != gap]
            body = re.escape(chars[0]) if len(chars) == 1 else "[" + "".join(map(re.escape, chars)) + "]" if chars else any_
            return body, optional

        out = ""
        for body, run in groupby((code(f) for f in self.freq), key=lambda x: x[0]):
            flags = [o for _, o in run]
            low, high = sum(not o for o in flags), len(flags)
            out += body + ("" if low == high == 1 else f"{{{low},{high}}}" if low != high else f"{{{low}}}")
        return out


def _align_to(consensus: np.ndarray, s: str, charset: str, cost: np.ndarray, gap: str, gap_gap: float) -> tuple[list[int], list[int]]:
    """Indices of consensus positions and of characters, -1 being a gap, on a path of least cost."""
    g = charset.index(gap)
    n, m = len(consensus), len(s)
    code = [charset.index(c) for c in s]
    w = consensus / np.maximum(consensus.sum(axis=1, keepdims=True), 1e-12)
    sub = w @ cost[:, code] if m else np.zeros((n, 0))
    drop = w @ cost[:, g]
    put = np.array([cost[g, c] for c in code])
    d = np.zeros((n + 1, m + 1))
    d[1:, 0], d[0, 1:] = np.cumsum(drop), np.cumsum(put)
    run = np.concatenate([[0.0], np.cumsum(put)])
    for i in range(1, n + 1):
        best = np.empty(m + 1)
        best[0] = d[i, 0]
        best[1:] = np.minimum(d[i - 1, 1:] + drop[i - 1], d[i - 1, :-1] + sub[i - 1])
        d[i] = np.minimum.accumulate(best - run) + run
    i, j, a, b = n, m, [], []
    while i or j:
        if j and abs(d[i, j] - d[i, j - 1] - put[j - 1]) < 1e-9:
            j -= 1
            a.append(-1)
            b.append(j)
        elif i and abs(d[i, j] - d[i - 1, j] - drop[i - 1]) < 1e-9:
            i -= 1
            a.append(i)
            b.append(-1)
        else:
            i, j = i - 1, j - 1
            a.append(i)
            b.append(j)
    return a[::-1], b[::-1]


def align_many(strings: list[str], base: float = 2.0, case: float = 1.0, gap_cost: float = 3.0, gap_gap: float = 0.0, gap: str = "_", weights: list[float] | None = None) -> list[str]:
    """Multiple alignment in two passes: each text is aligned to the consensus of those before, then all again to the final one."""
    if not strings:
        return []
    charset = "".join(sorted(set("".join(strings)) - {gap})) + gap
    k = len(charset)
    cost = np.full((k, k), base)
    for i, p in enumerate(charset):
        for j, q in enumerate(charset):
            cost[i, j] = 0.0 if i == j else case if p.lower() == q.lower() else gap_cost if gap in (p, q) else base
    cost[k - 1, k - 1] = gap_gap
    w = weights or [1.0] * len(strings)
    freq = Fuzzy.of(strings[0], charset, w[0]).freq
    total = w[0]
    for s, x in zip(strings[1:], w[1:]):
        a, b = _align_to(freq, s, charset, cost, gap, gap_gap)
        new = np.zeros((len(a), k))
        for r, (i, j) in enumerate(zip(a, b)):
            new[r] = freq[i] if i >= 0 else 0
            if i < 0:
                new[r, k - 1] += total
            new[r, charset.index(s[j]) if j >= 0 else k - 1] += x
        freq, total = new, total + x
    out = []
    for s in strings:
        a, b = _align_to(freq, s, charset, cost, gap, gap_gap)
        row = [gap] * len(freq)
        for i, j in zip(a, b):
            if i >= 0 and j >= 0:
                row[i] = s[j]
        out.append("".join(row))
    return out


def align_groups(df: DataFrame, group: str, order: str, text: str, **costs) -> DataFrame:
    """The texts of each group aligned in the given order; `aligned` is the result."""
    schema = T.StructType([*df.schema.fields, T.StructField("aligned", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(aligned=align_many([s or "" for s in pdf[text]], **costs))

    # groups are few bytes but much work: their partitions aren't to be merged
    spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), group)
    return spread.groupBy(group).applyInPandas(run, schema)
