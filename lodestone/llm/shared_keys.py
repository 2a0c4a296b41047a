"""How many keys of each set occur in another set too, counted over all sets.

Sets of 44-bit keys are sent to buckets by key as packed arrays (about 5 bytes a
key after compression), counted there with numpy, and the counts are added up by
set.  Two keys of one bucket are taken as the same where their low 32 bits agree,
so a count may be slightly too high, never too low: it is an upper bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLUSH_KEYS = 1_500_000
FLUSH_SETS = 60_000
PACKED = "bucket int, flush bigint, a binary, b binary"
META = np.dtype([("id", "<i8"), ("n", "<u4"), ("s1", "<u8"), ("s2", "<u8")])


def _rows(cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols["bucket"], pa.int32()), pa.array(cols["flush"], pa.int64()), pa.array(cols["a"], pa.binary()), pa.array(cols["b"], pa.binary())], ["bucket", "flush", "a", "b"])


def packed(sets: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """sets: ids, sizes, two sums that identify a set, and keys as (set in chunk << 44 | key), sorted."""
    part, seq = TaskContext.get().partitionId(), 0
    meta, keys, n_sets, n_keys = [], [], 0, 0

    def flush():
        nonlocal meta, keys, n_sets, n_keys, seq
        flush_id = (part << 24) | seq
        seq += 1
        k = np.concatenate(keys)
        h, d = k & np.uint64((1 << 44) - 1), (k >> np.uint64(44)).astype(np.uint16)
        b = ((h >> np.uint64(12)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16)
        order = np.argsort(b, kind="stable")
        h, d, edge = h[order].astype(np.uint32), d[order], np.searchsorted(b[order], np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(edge))
        out = {"bucket": [-1 - flush_id % 1_000_003], "flush": [flush_id], "a": [np.concatenate(meta).tobytes()], "b": [b""]}
        out["bucket"] += used.tolist()
        out["flush"] += [flush_id] * len(used)
        out["a"] += [h[edge[i] : edge[i + 1]].tobytes() for i in used]
        out["b"] += [d[edge[i] : edge[i + 1]].tobytes() for i in used]
        meta, keys, n_sets, n_keys = [], [], 0, 0
        return _rows(out)

    for ids, sizes, s1, s2, k in sets:
        if n_sets and (n_sets + len(ids) > FLUSH_SETS or n_keys + len(k) > FLUSH_KEYS):
            yield flush()
        for at in range(0, len(ids), FLUSH_SETS):
            m = np.zeros(len(ids[at : at + FLUSH_SETS]), META)
            m["id"], m["n"], m["s1"], m["s2"] = (x[at : at + FLUSH_SETS] for x in (ids, sizes, s1, s2))
            lo, hi = np.searchsorted(k, [np.uint64(at << 44), np.uint64((at + len(m)) << 44)]) if len(ids) > FLUSH_SETS else (0, len(k))
            if n_sets and n_sets + len(m) > FLUSH_SETS:
                yield flush()
            meta.append(m)
            keys.append(k[lo:hi] + np.uint64((n_sets - at) % (1 << 20) << 44))
            n_sets, n_keys = n_sets + len(m), n_keys + hi - lo
    if n_sets:
        yield flush()


def _count(table: pa.Table) -> pa.Table:
    """In one bucket: by flush, the sets that hold keys of another set, and how many."""
    if table.num_rows == 0 or table.column("bucket")[0].as_py() < 0:
        return table
    flushes = table.column("flush").to_pylist()
    hs = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("a")]
    ds = [np.frombuffer(x.as_py(), np.uint16) for x in table.column("b")]
    h = np.concatenate(hs)
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    shared = np.zeros(len(h), bool)
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    out, at = {"bucket": [], "flush": [], "a": [], "b": []}, 0
    for f, d in zip(flushes, ds):
        n = np.bincount(d[shared[at : at + len(d)]])
        at += len(d)
        if len(some := np.flatnonzero(n)):
            out["bucket"].append(0)
            out["flush"].append(f)
            out["a"].append(some.astype(np.uint16).tobytes())
            out["b"].append(n[some].astype(np.uint32).tobytes())
    return pa.Table.from_batches([_rows(out)])


def _total(share: float) -> Callable[[pa.Table], pa.Table]:
    def total(table: pa.Table) -> pa.Table:
        a, b = table.column("a"), table.column("b")
        meta, n = None, np.zeros(FLUSH_SETS + 1, np.int64)
        for i, bucket in enumerate(table.column("bucket").to_pylist()):
            if bucket < 0:
                meta = np.frombuffer(a[i].as_py(), META)
            else:
                np.add.at(n, np.frombuffer(a[i].as_py(), np.uint16), np.frombuffer(b[i].as_py(), np.uint32))
        n = n[: len(meta)]
        keep = np.flatnonzero((meta["n"] > 0) & (n >= np.ceil(share * meta["n"] - 1e-9)) & (n > 0))
        m = meta[keep]
        return pa.table({"id": m["id"], "n": m["n"].astype(np.int32), "shared": n[keep].astype(np.int32), "s1": m["s1"].view(np.int64), "s2": m["s2"].view(np.int64)})

    return total


def sets_with_shared_keys(rows: DataFrame, share: float) -> DataFrame:
    """Sets at least `share` of whose keys occur in another set: id, n, shared, s1, s2.

    rows: what packed() yields, as a DataFrame of PACKED.
    """
    counted = rows.groupBy("bucket").applyInArrow(_count, PACKED)
    return counted.groupBy("flush").applyInArrow(_total(share), "id bigint, n int, shared int, s1 bigint, s2 bigint")


def buckets_for(df: DataFrame) -> int:
    """Number of buckets: the session's shuffle partitions, at most 65,535."""
    return max(1, min(65_535, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


__all__ = ["PACKED", "F", "buckets_for", "packed", "sets_with_shared_keys"]
