"""Near-duplicate groups against brute force: borders, ties, hot groups, common passages."""

import itertools
import random
import re

import numpy as np
import pytest

from epilake.llm import near_dup as N

SCHEMA = "doc_id long, text string, id string, key int, n_shingles string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Rows as (doc_id, text) to sorted (doc_id, n_shingles, component_id, kept)."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for d, s in sets:
        if s and d is not None:
            by.setdefault(s, []).append(d)
    near = {}
    for s in by:
        for g in s:
            near.setdefault(g, []).append(s)
    pairs = {frozenset(p) for v in near.values() for p in itertools.combinations(v, 2)}
    links = [(x[0], y) for x in by.values() for y in x]
    links += [(by[s][0], by[t][0]) for s, t in map(tuple, pairs) if 100 * len(s & t) >= 75 * len(s | t)]
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out = [(d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets]
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    got = N.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def corpus(seed=1, n=260):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    passage = rng.choices(words, k=25)
    rows = []
    for i in range(n):
        rows.append(rng.choices(words, k=rng.randint(0, 90)) + (passage if i % 3 == 0 else []))
    for i in range(90):  # near copies around the threshold
        base = list(rows[rng.randrange(40, 70)])
        for _ in range(rng.randint(1, 4)):
            if base:
                base[rng.randrange(len(base))] = rng.choice(words)
        rows.append(base)
    hot = rng.choices(words, k=120)
    for i in range(120):  # a hot group of near copies, and of equal ones
        copy = list(hot)
        copy[rng.randrange(len(copy))] = f"edit{i}"
        rows.append(copy if i % 2 else hot)
    texts = [" ".join(r) for r in rows] + [None, "", " \n", "A b C", "a B c", "one two three four five", "ONE two three  four\tfive",
                                           "Ünicode text É with five words", "ünicode text é with five words"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def test_against_brute_force(spark):
    check(spark, corpus())


def test_blocks_of_mixed_tables(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 3)
    check(spark, corpus(seed=2, n=120))


def test_repeated_and_null_ids(spark):
    a, b, c = ("p q r s t u v w x y z " * 3, "one two three four five six seven", "alpha beta gamma delta epsilon")
    rows = [(5, a), (5, b), (9, b), (3, a), (None, a), (None, None), (7, c), (7, c), (7, None), (8, None)]
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    got = sorted(map(tuple, N.near_duplicates(df).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (9, 3, False), (3, 3, True), (None, None, True), (None, None, True),
                          (7, 7, True), (7, 7, True), (7, 7, True), (8, 8, True)], key=str)


@pytest.mark.parametrize("contract", [3, 10_000])
def test_components_of_chains_and_stars(spark, monkeypatch, contract):
    """Contracted by several tasks with rounds behind them, and by one."""
    monkeypatch.setattr(N, "CONTRACT", contract)
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(300 + rng.randrange(60), 300 + rng.randrange(60)) for _ in range(50)]
    links += [(500, 499), (500, 499), (600, 600)]
    rng.shuffle(links)
    root = {}

    def find(i):
        return i if root.get(i, i) == i else find(root[i])

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(i, find(i)) for link in links if link[0] != link[1] for i in link}
    got = N.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_hot_group_with_outsiders(spark):
    """Thousands of near copies, and texts that share tables with them without being near."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=120)
    rows = []
    for i in range(1500):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"edit{i}"
        rows.append(copy)
    outside = []
    for i in range(25):  # every 8th to 60th word is another one: shares some tables, few are near
        copy = list(base)
        for k in range(rng.randrange(8), len(copy), rng.choice([8, 12, 20, 30, 60])):
            copy[k] = f"out{i}-{k}"
        outside.append(copy)
    texts = [" ".join(r) for r in outside[:12] + rows + outside[12:]]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame([(i, t, "", 1, "") for i, t in enumerate(texts)], SCHEMA)).collect()}
    sets = [{tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for t in texts]

    def near(i, j):
        both = len(sets[i] & sets[j])
        return 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)

    copies = set(range(12, 1512))
    assert len({got[i] for i in copies}) == 1
    linked = [i for i in range(len(texts)) if i not in copies and any(near(i, j) for j in copies)]
    alone = [i for i in range(len(texts)) if i not in copies and i not in linked]
    assert alone and linked
    assert {got[i] for i in linked} == {got[12]}
    for i in alone:  # outsiders may be near one another
        assert got[i] == got[12] or got[i] <= i
        if not any(near(i, j) for j in range(len(texts)) if j != i):
            assert got[i] == i


def test_keep_one_row_of_each_document(spark):
    a, b, c = "p q r s t u v w x y z " * 3, "one two three four five six seven", "alpha beta gamma delta epsilon"
    rows = [(5, a), (5, b), (9, b), (3, a), (None, a), (None, a), (7, c), (7, c), (7, None), (7, ""), (8, None), (6, "lone words are here to stay")]
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    got = N.keep_one(df)
    assert got.columns == df.columns
    kept = sorted(((r[0], r[1]) for r in got.collect()), key=str)
    # (5, b) or (9, b): the one with the smaller number; 5 keeps its number with the first of its texts by hash
    fives = [r for r in kept if r[0] == 5]
    assert len(fives) <= 1 and all(r[1] == b for r in fives)
    rest = [r for r in kept if r[0] not in (5, 9)]
    assert rest == sorted([(3, a), (None, a), (None, a), (7, c), (7, None), (7, ""), (8, None), (6, rows[-1][1])], key=str)
    assert {r[1] for r in kept if r[0] in (5, 9)} == {b} and len(kept) == len(rest) + 1
    plain = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in [(1, a), (2, a), (4, b), (None, b)]], SCHEMA)
    assert sorted(((r[0], r[1]) for r in N.keep_one(plain).collect()), key=str) == sorted([(1, a), (4, b), (None, b)], key=str)


def test_spent_tables_are_deleted(spark):
    import os
    from epilake.session import ensure_work_dir
    base = f"{ensure_work_dir(spark).removeprefix('file:')}/llm"
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    out = N.near_duplicates(spark.createDataFrame([(i, f"some text of {i % 3} words that is long enough", "", 1, "") for i in range(9)], SCHEMA))
    left = set(os.listdir(base)) - before
    assert len(left) == 1 and next(iter(left)).startswith("near-result") and out.count() == 9


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_runs_across_partitions():
    """Live rows and stars keep what a key has in neighbouring partitions."""
    import pyarrow as pa

    def batches(rows, size):
        for i in range(0, len(rows), size):
            k, v = zip(*rows[i:i + size])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(v, pa.int64())], ["key", "id"])

    rows = [(1, 1), (2, 1), (2, 2), (2, 3), (3, 9), (4, 1), (4, 5), (5, 2), (6, 1), (6, 2), (7, 7)]
    for size in range(1, 12):
        live = [tuple(r.values()) for b in N._live_partition(batches(rows, size)) for r in b.to_pylist()]
        assert sorted(live) == [(1, 1), (2, 1), (2, 2), (2, 3), (4, 1), (4, 5), (6, 1), (6, 2), (7, 7)]
        star = [tuple(r.values()) for b in N._star_partition(batches(rows, size)) for r in b.to_pylist()]
        votes = {}
        for a, b, key, n in star:
            if key is None:
                votes[a, b] = votes.get((a, b), 0) + n
        assert votes == {(1, 2): 2, (1, 3): 1, (1, 5): 1}
        assert sorted(x[:3] for x in star if x[2] is not None) == [(1, None, 1), (7, None, 7)]


@pytest.mark.parametrize("s", [0.75, 0.9])
def test_tables_meet(s):
    """The share of pairs of similarity s that meet in a table is as derived."""
    rng = np.random.default_rng(3)
    n, miss = 400, 0
    for _ in range(n):
        both = rng.integers(0, 1 << 63, int(400 * s), dtype=np.uint64)
        x, y = (np.concatenate([both, rng.integers(0, 1 << 63, (400 - len(both)) // 2, dtype=np.uint64)]) for _ in "xy")
        k = N._half_keys((N._minima([x, y]) >> np.uint64(32)))
        miss += not ((k[0, 0] == k[1, 0]).any() and (k[0, 1] == k[1, 1]).any())
    assert miss <= 1
