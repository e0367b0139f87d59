"""Mixing against a plain computation: targets, copies, ties, nulls, an all-capped source."""

import hashlib
import math
import re

from epilake.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size int, target string"


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = {}
    for _, t, s in rows:
        per[s] = per.get(s, 0) + size(t)
    order = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None] * (None in per)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, held = sum(per.values()), set()
    while True:
        free = [s for s in per if s not in held]
        level = (total - sum(3 * per[s] for s in held)) / sum(w[s] for s in free) if free and total else 0
        more = {s for s in free if 3 * per[s] < level * w[s]}
        if not more:
            break
        held |= more
    target = {s: 3 * per[s] if s in held else level * w[s] for s in per}
    out = []
    for d, t, s in rows:
        rate = target[s] / per[s] if per[s] else 0
        u = int(hashlib.md5(f"17:{'' if d is None else d}".encode()).hexdigest()[:13], 16) / 2 ** 52
        out.append((d, size(t), per[s], float(target[s]), math.floor(rate) + (u < rate - math.floor(rate))))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(d, t, s, 1, "x") for d, t, s in rows], SCHEMA)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    want = brute(rows)
    got = [(r.doc_id, r.size, r.source_size, r.target, r.copies) for r in M.with_copies(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    mixed = M.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r[4] for r in want)


def test_against_brute_force(spark):
    rows = [(i, "w " * (i % 13) if i % 11 else None, f"s{i % 7}" if i % 5 else None) for i in range(300)]
    rows += [(i, "hot word joined here", "s0") for i in range(300, 600)]
    rows += [(7, "repeat me", "S"), (7, "repeat me", "S"), (None, "no id", "é"), (601, "", "empty"), (602, "one", "tiny")]
    check(spark, rows)


def test_one_source_and_empty(spark):
    check(spark, [(i, "a b c", "only") for i in range(10)])
    check(spark, [(1, None, None)])
    assert M.with_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1, "")], SCHEMA)
    plan = M.with_copies(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
