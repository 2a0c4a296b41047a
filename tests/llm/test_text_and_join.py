"""Text core, n-gram join, decontamination and repeats against brute force."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, jaccard_join, queries, suffix_repeats, textcore

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")
DOCS = "doc_id bigint, text string"


def words(t):
    return WORD.findall((t or "").lower())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB1 .\né", max_size=12)), max_size=6))
def test_words_match_the_pattern(texts):
    w = textcore.split_words(pa.array(texts, pa.string()))
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    found = [w.buf[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    assert found == [x for t in texts for x in words(t)]
    h = w.hashes()
    assert len(set(h.tolist())) == len(set(found))
    s, d, _ = w.shingles(2, h)
    assert Counter(d.tolist()) == Counter({i: len(words(t)) - 1 for i, t in enumerate(texts) if len(words(t)) > 1})


def test_pieces_keep_all_rows():
    b = pa.table({"text": ["x" * 10, None, "", "y" * 100, "z"]})
    got = [t for p in textcore.pieces(b, "text", 20) for t in p.column("text").to_pylist()]
    assert got == b.column("text").to_pylist()


def sets_of(rows, n=3):
    out = {}
    for i, t in rows:
        w = words(t)
        s = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())
        if i is not None and s:
            out[i] = s
    return out


def brute_pairs(rows, t):
    s, rep, want = sets_of(rows), {}, {}
    for i in sorted(s):
        if s[i] in rep:
            want[rep[s[i]], i] = 1.0
        else:
            rep[s[i]] = i
    for a, b in combinations(sorted(rep.values()), 2):
        if (j := len(s[a] & s[b]) / len(s[a] | s[b])) >= t:
            want[a, b] = j
    return want


def pairs(df):
    rows = [((r["doc_id_a"], r["doc_id_b"]), r["jaccard"]) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def corpus(seed, n=60):
    """Families of edited copies, a passage that many texts share, and odd ones."""
    r = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared, rows = list(r.choice(vocab, 30)), []
    for i in range(n):
        kind = i % 4
        if kind and rows and r.random() < 0.6:
            w = words(rows[int(r.integers(len(rows)))][1])
            for _ in range(int(r.integers(0, 4))):
                if w:
                    w[int(r.integers(len(w)))] = str(r.choice(vocab))
        else:
            w = list(r.choice(vocab, int(r.integers(1, 80)))) + (shared if r.random() < 0.5 else [])
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,t", [(1, 0.6), (2, 0.4), (3, 0.9)])
def test_group_edges_are_exact(spark, seed, t):
    rows = corpus(seed)
    got, want = pairs(jaccard_join.group_edges(spark.createDataFrame(rows, DOCS), t)), brute_pairs(rows, t)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert want


def test_jaccard_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, "a b"), (2, "A, b!"), (3, None), (4, ""), (5, "..."), (None, "a b"), (6, long), (7, long + " end"), (8, "a b c"), (8, "a b c"), (9, "c")]
    d = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit(1)).withColumn("id", F.lit("x")).withColumn("g", F.lit(0)).withColumn("id_of_group", F.lit(3))
    assert set(pairs(jaccard_join.group_edges(d))) == set(pairs(jaccard_join.jaccard_join(d))) == {(1, 2), (6, 7)}
    kept = jaccard_join.one_of_each_group(d)
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, None, 6, 8, 8, 9]))
    assert jaccard_join.group_edges(d.limit(0)).count() == 0 and jaccard_join.one_of_each_group(d.limit(0)).count() == 0


def edited_under_one_id(families=6):
    """Two texts T and U under one id; of two other texts one is near T only, the other near U only."""
    rows, want = [], set()
    for f in range(families):
        w = [f"f{f}w{i}" for i in range(60)]
        u = w[:50] + [f"u{x}" for x in w[50:]]
        rows += [(3 * f, " ".join(x)) for x in (w, u)]
        rows += [(3 * f + 1, " ".join([f"x{x}" for x in w[:8]] + w[8:])), (3 * f + 2, " ".join([f"y{x}" for x in w[:8]] + u[8:]))]
        want |= {(3 * f, 3 * f + 1), (3 * f, 3 * f + 2)}
    return rows, want


def test_group_edges_of_two_texts_under_one_id(spark):
    rows, want = edited_under_one_id()
    assert set(pairs(jaccard_join.group_edges(spark.createDataFrame(rows, DOCS)))) == want


def brute_all_pairs(rows, t):
    s = sets_of(rows)
    return {(a, b): j for a, b in combinations(sorted(s), 2) if (j := len(s[a] & s[b]) / len(s[a] | s[b])) >= t}


@pytest.mark.parametrize("copies,group_tokens", [(1000, 4_000_000), (2, 60)])
def test_jaccard_join_has_every_pair(spark, monkeypatch, copies, group_tokens):
    monkeypatch.setattr(jaccard_join, "_COPIES", copies)
    monkeypatch.setattr(jaccard_join, "GROUP_TOKENS", group_tokens)
    rows = corpus(1)
    rows += [(1000 + 100 * k + i, rows[i][1]) for k in range(4) for i in range(0, 60, 7)]
    got, want = pairs(jaccard_join.jaccard_join(spark.createDataFrame(rows, DOCS))), brute_all_pairs(rows, 0.6)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert len(want) > len(brute_pairs(rows, 0.6))


def test_jaccard_join_of_two_texts_under_one_id(spark):
    rows, want = edited_under_one_id()
    assert set(pairs(jaccard_join.jaccard_join(spark.createDataFrame(rows, DOCS)))) == want
    d = spark.createDataFrame(rows, DOCS)
    assert jaccard_join.jaccard_join(d.limit(0)).count() == 0


def brute_classes(rows, t):
    """Class and number of links of each id; an id may have several texts."""
    sets = [(i, next(iter(sets_of([(i, x)]).values()))) for i, x in rows if i is not None and words(x)]
    near = defaultdict(set)
    for (i, a), (k, b) in combinations(sets, 2):
        if i != k and len(a & b) / len(a | b) >= t:
            near[i].add(k)
            near[k].add(i)
    want = {}
    for i in sorted({i for i, _ in rows if i is not None}):
        todo = [i] if i not in want else []
        while todo:
            k = todo.pop()
            if k not in want:
                want[k] = (i, len(near[k]))
                todo += near[k]
    return want


def class_rows(df):
    rows = [(r["doc_id"], (r["class_id"], r["n_links"])) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def family(n, seed=3):
    """Copies of a text of 200 words, each with up to five words of its own."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        w = [f"t{k}" for k in range(200)]
        for k in range(int(r.integers(1, 6))):
            w[int(r.integers(len(w)))] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    return rows


def test_one_of_each_group_lists_no_square_of_links(spark, monkeypatch):
    seen, components = [], jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda e: components(seen.append(e.count()) or e))
    kept = jaccard_join.one_of_each_group(spark.createDataFrame(family(300), DOCS))
    assert [r["doc_id"] for r in kept.collect()] == [0] and seen[0] < 10 * 300


@pytest.mark.parametrize("group_tokens,cells,sparse", [(4_000_000, 8_000_000, 0.002), (60, 300, 0.5)])
def test_classes_count_every_link(spark, monkeypatch, group_tokens, cells, sparse):
    for name, value in (("GROUP_TOKENS", group_tokens), ("_MATRIX_CELLS", cells), ("_SPARSE", sparse)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus(1)
    rows += [(1000 + 100 * k + i, rows[i][1]) for k in range(4) for i in range(0, 60, 7)]
    # ids with several texts, equal to or near those of others
    rows += [(2000 + i % 3, rows[i][1]) for i in range(12)] + [(5, rows[6][1]), (7, rows[7][1])] + edited_under_one_id()[0]
    rows += [(3000, None), (3001, "..."), (None, rows[0][1])]
    got, want = class_rows(jaccard_join.classes(spark.createDataFrame(rows, DOCS))), brute_classes(rows, 0.6)
    assert got == want and max(n for _, n in want.values()) > 10
    assert jaccard_join.classes(spark.createDataFrame(rows[:0], DOCS)).count() == 0


def test_a_family_is_compared_as_a_few_groups(spark):
    """Links grow with the square of a family; groups, and what is sent to them, don't."""
    d = spark.createDataFrame(family(600), DOCS)
    sets = jaccard_join._set_join(d, 0.6, 3)[2]
    assert sets.count() == 600 and sets.select("g").distinct().count() < 10
    assert class_rows(jaccard_join.classes(d)) == {i: (0, 599) for i in range(600)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (101, 100), (7, 7), (None, 3)]
    got = {r["doc_id"]: r["group_id"] for r in jaccard_join.components(spark.createDataFrame(edges, "doc_id_a bigint, doc_id_b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 100: 50, 101: 50}


# ---- decontamination


def brute_contained(rows, items, t, k=5):
    want = {}
    for o, x in items:
        w = words(x)
        n = min(k, len(w))
        if o is None or not n:
            continue
        g = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, d in rows:
            v = words(d)
            c = len(g & {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}) / len(g)
            if i is not None and c >= t:
                want[i, o] = max(c, want.get((i, o), 0))
    return want


def test_key_filter_has_no_false_negatives(spark):
    r = np.random.default_rng(2)
    key = r.integers(0, 1 << 44, 3000)
    kind = [(int(w), int(c)) for w, c in zip(r.integers(1, 6, 3000), r.integers(0, 9, 3000))]
    keys = spark.createDataFrame([(int(x), w, c, 1) for x, (w, c) in zip(key, kind)], "key bigint, width int, class int, item_id bigint")
    f = decontaminate._key_filter(keys, 3000)
    assert all(f.admits(np.array([x], np.uint64), w).all() for x, (w, _) in zip(key, kind))
    assert f.admits(r.integers(0, 1 << 44, 200_000).astype(np.uint64), 5).sum() < 5


def test_without_benchmark_keeps_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b c d e f", 5), (2, "x", 6)], "doc_id bigint, text string, contaminated int")
    b = spark.createDataFrame([(1, "a b c d e")], "item_id bigint, text string")
    got = decontaminate.without_benchmark(d, b)
    assert got.columns == d.columns and [tuple(r) for r in got.collect()] == [(2, "x", 6)]


@pytest.mark.parametrize("filter_bits", [1 << 29, 1 << 15])
def test_contained_items(spark, monkeypatch, filter_bits):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", filter_bits)
    r = np.random.default_rng(5)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(o, " ".join(r.choice(vocab, int(r.integers(1, 60))))) for o in range(60)] + [(100, None), (101, "--"), (None, "v1 v2 v3")]
    rows = []
    for i in range(120):
        w = list(r.choice(vocab, int(r.choice([0, 5, 40, 400, 6000]))))
        if i % 2:
            own = words(items[i % 60][1])
            own = own[: max(1, int(len(own) * r.choice([0.3, 0.8, 1.0])))]
            at = int(r.integers(len(w) + 1))
            w[at:at] = own
        rows.append((i, " ".join(w)))
    rows += [(200, None), (None, items[0][1]), (201, items[1][1]), (201, items[2][1]), (202, items[1][1]), (202, items[1][1])]
    items += [(102, items[1][1]), (102, items[2][1])]
    d, b = spark.createDataFrame(rows, DOCS).withColumn("item", F.lit(1)), spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(9))
    want = brute_contained(rows, items, 0.6)
    here = {(x["doc_id"], x["item_id"]): x["containment"] for x in decontaminate.contaminated(d, b).collect()}
    assert all(want[k] == v for k, v in here.items())
    assert len(here) >= 0.99 * len(want)
    clean = {x["doc_id"] for x in decontaminate.without_benchmark(d, b).collect()}
    assert clean == ({i for i, _ in rows} - {i for i, _ in here})
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), b).count() == 0


# ---- repeats


def brute_repeats(rows, least):
    w = {i: words(t) for i, t in rows if i is not None}
    groups = defaultdict(list)
    for i, x in w.items():
        for p in range(len(x) - least + 1):
            groups[tuple(x[p : p + least])].append((i, p))
    want = set()
    for occ in groups.values():
        todo = [(occ, least)]
        while todo:
            o, n = todo.pop()
            if len(o) < 2:
                continue
            nxt = defaultdict(list)
            for i, p in o:
                nxt[w[i][p + n] if p + n < len(w[i]) else ("end", i, p)].append((i, p))
            if len(nxt) > 1:
                if len({w[i][p - 1] if p else ("start", i) for i, p in o}) > 1:
                    want.add((n, tuple(sorted(o))))
            todo += [(v, n + 1) for v in nxt.values()]
    return want


def found_repeats(df):
    rows = df.collect()
    got = {(r["n_words"], tuple(zip(r["doc_ids"], r["starts"]))) for r in rows}
    assert len(got) == len(rows) and all(r["n_occurrences"] == len(r["doc_ids"]) for r in rows)
    return got


@pytest.mark.parametrize("seed,least", [(1, 6), (2, 9), (3, 2), (4, 20)])
def test_maximal_repeats(spark, seed, least):
    r = np.random.default_rng(seed)
    rows = corpus(seed, 40)
    rows += [(100, "a b c d e f g h " * 8), (101, "q " * 60), (102, " ".join(r.choice(["x", "y"], 80)))]
    assert found_repeats(suffix_repeats.maximal_repeats(spark.createDataFrame(rows, DOCS), least)) == brute_repeats(rows, least)


def repeats_of_places(df):
    """Repeats with all occurrences, as found_repeats() has them, and the number of rows."""
    rows = df.collect()
    repeats, places = {r["repeat_id"]: (r["parent_id"], r["n_words"], r["n_occurrences"]) for r in rows}, defaultdict(set)
    for r in rows:
        i = r["repeat_id"]
        while i is not None:
            places[i].add((r["doc_id"], r["start"]))
            i = repeats[i][0]
    assert all(len(places[i]) == n for i, (_, _, n) in repeats.items())
    assert all(up is None or repeats[up][1] < w for up, w, _ in repeats.values())
    return {(w, tuple(sorted(places[i]))) for i, (_, w, _) in repeats.items()}, len(rows)


@pytest.mark.parametrize("seed,least,at_once", [(1, 6, 200_000), (3, 2, 7)])
def test_repeat_places_have_every_repeat_and_occurrence(spark, monkeypatch, seed, least, at_once):
    monkeypatch.setattr(suffix_repeats, "OCCURRENCES_AT_ONCE", at_once)
    r = np.random.default_rng(seed)
    rows = corpus(seed, 40)
    rows += [(100, "a b c d e f g h " * 8), (101, "q " * 60), (102, " ".join(r.choice(["x", "y"], 80))), (None, "q " * 60), (103, None), (101, "q " * 60)]
    d = spark.createDataFrame(rows, DOCS)
    want = brute_repeats(rows[:-1], least)
    got, n = repeats_of_places(suffix_repeats.repeat_places(d, least))
    assert got == want
    assert n <= len({p for _, o in want for p in o}) + len(want)
    assert suffix_repeats.repeat_places(d.limit(0)).count() == 0


def test_op9_has_a_doc_id_in_each_row(spark, sf):
    df = queries.QUERIES["op9_suffix_array_repeats"](spark, sf)
    assert dict(df.dtypes)["doc_id"] == "bigint" and df.filter("doc_id is null").count() == 0


def test_maximal_repeats_odd_rows(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, p), (2, "x " + p + " y"), (3, None), (None, p), (4, ""), (5, p), (5, p), (6, "short")]
    d = spark.createDataFrame(rows, DOCS).withColumn("part", F.lit(1)).withColumn("lead", F.lit(1))
    assert found_repeats(suffix_repeats.maximal_repeats(d)) == {(60, ((1, 0), (2, 1), (5, 0)))}
    assert suffix_repeats.maximal_repeats(d.limit(0)).count() == 0


@pytest.mark.parametrize("shard_words,at_once", [(1_000_000, 200_000), (200, 7)])
def test_maximal_repeats_of_a_family(spark, monkeypatch, shard_words, at_once):
    monkeypatch.setattr(suffix_repeats, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(suffix_repeats, "SUFFIXES_AT_ONCE", at_once)
    monkeypatch.setattr(suffix_repeats, "OCCURRENCES_AT_ONCE", at_once)
    r = np.random.default_rng(9)
    text = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(80):
        w = list(text)
        for _ in range(int(r.integers(0, 3))):
            w[int(r.integers(len(w)))] = f"e{i}"
        rows.append((i, " ".join(w)))
    assert found_repeats(suffix_repeats.maximal_repeats(spark.createDataFrame(rows, DOCS), 10)) == brute_repeats(rows, 10)


def test_repeats_of_a_large_family_take_little_memory():
    """One part of 5,000 copies of a text of 600 words, each with a change of its own: no suffix is copied."""
    import tracemalloc

    r = np.random.default_rng(4)
    copies, n, least = 5000, 600, 50
    text = r.integers(0, 1 << 60, n).astype(np.uint64)
    seg = {k: [] for k in ("lead", "shard", "doc_id", "first", "words", "suffixes")}
    for i in range(copies):
        w = text.copy()
        w[int(r.integers(60, n))] = i
        x = np.array([(7, 0, 0, n)], suffix_repeats.SUFFIX)
        for k, v in zip(seg, (0, 0, i, 0, w.tobytes(), x.tobytes())):
            seg[k].append(v)
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in seg.items()})
    textcore._WORDS.get(copies * n + 1)
    tracemalloc.start()
    counted = sum(b.num_rows for b in suffix_repeats._tree(least)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counted >= 500 and most < 6 * copies * n * 8
