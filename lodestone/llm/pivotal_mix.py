"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted m times, m = target share x all characters /
the source's characters.  The whole part of m is given to each; the fractions are
rounded together: two fractions are paired, and mass moves from one to the other
at random until one of them is 0 or 1.  Each document keeps its expected number
of copies, and the copies of a source add up to their expectation, rounded.

A source's documents are rounded in blocks of a fixed size, so a hot source is
spread over many tasks; each block leaves one fraction, and these are paired in
turn, 16 blocks at a time, up a reduction tree with one fraction at its root.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore
from .cluster import free, need, stored

TEMPERATURE, BLOCK, FAN_IN = 0.5, 20_000, 16
_EPS = 1e-9


def pivotal(fractions: np.ndarray, uniforms: np.ndarray) -> tuple[np.ndarray, int]:
    """Sequential pivotal rounding: the values, all 0 or 1 but for one, and the index of that one (-1 if there is none)."""
    x = fractions.tolist()
    out = x[:]
    u = uniforms.tolist()
    hold = -1
    a = 0.0
    for i, b in enumerate(x):
        if b <= _EPS or b >= 1 - _EPS:
            out[i] = round(b)
            continue
        if hold < 0:
            hold, a = i, b
            continue
        s = a + b
        if s < 1 - _EPS:
            if u[i] * s < b:
                out[hold], hold, a = 0, i, s
            else:
                out[i], a = 0, s
        elif s <= 1 + _EPS:
            if u[i] * s < b:
                out[hold], out[i] = 0, 1
            else:
                out[hold], out[i] = 1, 0
            hold = -1
        elif u[i] * (2 - s) < 1 - b:
            out[hold], hold, a = 1, i, s - 1
        else:
            out[i], a = 1, s - 1
    if hold >= 0:
        out[hold] = a
    return np.array(out, np.float64), hold


UNITS = "doc_id bigint, source string, block bigint, whole int, part double"


def _rounded(seed: int, level: int):
    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("doc_id").fill_null(-1), np.int64)
        with np.errstate(over="ignore"):
            h = textcore.mix(textcore.mix(ids.view(np.uint64) + np.uint64(seed)) + np.uint64(level))
        order = np.lexsort((ids, h))
        part, _ = pivotal(np.asarray(table.column("part"))[order], textcore.unit(textcore.mix(h[order])))
        t = table.take(pa.array(order))
        return pa.table({"doc_id": t.column("doc_id"), "source": t.column("source"), "block": t.column("block"), "whole": t.column("whole"), "part": pa.array(part)})

    return run


def copies(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """doc_id, source, copies: how many times each document is taken, 0 included.

    docs: doc_id, source, and n_chars or text; other columns aren't used.  The
    target share of a source is weights[source] (rescaled to a sum of 1; sources
    not named get 0), or without weights proportional to its characters to the
    power of `temperature`.  The mix has as many characters as docs.  Rows that
    share doc_id and source are one unit, with the sum of their characters, and
    get the same number of copies; there is one row for each unit.  A null source
    is a source of its own, a null doc_id a unit of it.  A null length counts 0;
    documents of a source without characters are taken once.  An empty table
    gives no rows.
    """
    need(docs, "doc_id", "source")
    size = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.length(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(size, F.lit(0)).alias("size"))
    units = stored(rows.groupBy("doc_id", "source").agg(F.sum("size").alias("size")))
    totals = units.groupBy("source").agg(F.sum("size").alias("chars"), F.count("*").alias("units"))
    if weights is None:
        share = F.pow(F.col("chars").cast("double"), F.lit(float(temperature)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        share = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    totals = totals.withColumn("share", F.when(F.col("chars") > 0, share).otherwise(0.0))
    all_ = totals.agg(F.sum("chars").alias("all_chars"), F.sum("share").alias("all_share"))
    m = F.when(F.col("chars") > 0, F.coalesce(F.col("share") / F.nullif(F.col("all_share"), F.lit(0.0)), F.lit(0.0)) * F.col("all_chars") / F.col("chars")).otherwise(1.0)
    wanted = stored(totals.crossJoin(all_).select(F.col("source").alias("source_"), "units", m.alias("m")))
    most = wanted.agg(F.max("units").alias("n")).first()["n"] or 0
    blocks = F.ceil(F.col("units") / F.lit(block))
    now = units.join(wanted, F.col("source").eqNullSafe(F.col("source_"))).select(
        "doc_id", "source", F.pmod(F.xxhash64("doc_id", F.lit(seed)), blocks).alias("block"), F.floor(F.col("m") + F.lit(_EPS)).cast("int").alias("whole"), F.greatest(F.col("m") - F.floor(F.col("m") + F.lit(_EPS)), F.lit(0.0)).alias("part")
    )
    done, level, left = [], 0, -(-most // block)
    while True:
        # every level is written: both what is decided and what goes on are read from the same draw
        drawn = stored(now.groupBy("source", "block").applyInArrow(_rounded(seed, level), UNITS))
        open_ = (F.col("part") > _EPS) & (F.col("part") < 1 - _EPS)
        done.append(drawn.filter(~open_))
        now = drawn.filter(open_).withColumn("block", F.floor(F.col("block") / FAN_IN))
        level += 1
        if left <= 1:
            break
        left = -(-left // FAN_IN)
    # the root's fraction, one for each source at most
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit("root")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    done.append(now.withColumn("part", F.when(u < F.col("part"), 1.0).otherwise(0.0)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", (F.col("whole") + F.round("part").cast("int")).alias("copies"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = 17) -> DataFrame:
    """docs with each row as often as copies() says; `copy` numbers them from 1.

    All columns of docs stay.  Where docs has a column `copy` already, the number
    is in `_copy`, and so on.
    """
    (number,) = free(docs.columns, "copy")
    i, s, n = free([*docs.columns, number], "unit_id", "unit_source", "unit_copies")
    c = copies(docs, weights, temperature, seed=seed).filter("copies > 0").select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("copies").alias(n))
    joined = docs.join(c, F.col("doc_id").cast("bigint").eqNullSafe(F.col(i)) & F.col("source").cast("string").eqNullSafe(F.col(s)))
    return joined.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(i, s, n)
