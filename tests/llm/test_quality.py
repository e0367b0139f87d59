"""Importance resampling against plain counts; sampling, ties and odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from epilake.llm import quality as Q

SCHEMA = "doc_id long, text string, target string, n_features int, rank string"


def corpus(n=200, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = rng.choices(["clear", "Plain", "prose", "with", "sense,", "and", "order."], k=rng.randint(1, 80))
        text = " ".join(words if good else [w + rng.choice(["***", "!!", " |"]) for w in words])
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(good)))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    return docs, Q.target_rows(spark.createDataFrame([(d, q, 0, "z") for d, q in labels], "doc_id long, quality int, toxic int, text string"))


def test_counts_and_sample(spark):
    rows, labels = corpus()
    rows += [(500, None), (501, ""), (None, "clear prose"), (7, rows[7][1]), (502, "long clear " * 60_000)]
    labels += [(0, 1 - labels[0][1]), (0, labels[0][1]), (None, 1), (9, None)]
    docs, lab = frames(spark, rows, labels)
    good = {d for d, q in labels[1:100] if q} | {0}
    raw, target = np.full(Q.BUCKETS, Q.SMOOTH), np.full(Q.BUCKETS, Q.SMOOTH)
    for d, t in rows:
        f, _ = Q.features([(t or "").encode()])
        np.add.at(raw, f, 1)
        if d in good:
            np.add.at(target, f, 1)
    want = np.log(target / target.sum()) - np.log(raw / raw.sum())
    ratios = Q.log_ratios(docs, lab)
    assert np.allclose(ratios, want)
    weight = {(d, t): want[Q.features([(t or "").encode()])[0]].sum() for d, t in rows}
    got = Q.resample(docs, lab, share=0.5).collect()
    assert [r.rank for r in sorted(got, key=lambda r: r.rank)] == list(range(round(0.5 * len(rows))))

    def key(d, t):
        u = (int(hashlib.md5(f"29:{'' if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        return weight[d, t] - math.log(-math.log(u))

    keys = sorted((key(d, t) for d, t in rows), reverse=True)
    assert sorted((r.gumbel_key for r in got), reverse=True) == pytest.approx(keys[:len(got)])
    default = Q.resample(docs, lab)
    assert default.count() == round(lab.where("target").count() / lab.count() * len(rows))


def test_sample_prefers_target(spark):
    rows, labels = corpus(400, 3)
    docs, lab = frames(spark, rows, labels)
    kept = {r.doc_id for r in Q.resample(docs, lab).collect()}
    bad = {d for d, q in labels if not q}
    good = {d for d, q in labels if q}
    assert len(kept & good) > 0.95 * len(good) and len(kept & bad) < 0.2 * len(bad)


def test_gumbel_is_proportional():
    """Without text the weights are equal, so every document is taken as often as another."""
    u = [(int(hashlib.md5(f"{s}:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52 for s in range(300) for d in range(10)]
    keys = -np.log(-np.log(np.array(u).reshape(300, 10)))
    top = np.bincount(np.argsort(-keys, axis=1)[:, :5].ravel(), minlength=10)
    assert top.min() > 110 and top.max() < 190


def test_without_labels_or_rows(spark):
    docs, lab = frames(spark, [(1, "a b"), (2, None)], [])
    assert Q.resample(docs, lab).count() == 2
    assert Q.resample(docs.limit(0), lab).count() == 0


def test_features_of_groups_are_those_of_texts():
    texts = [b"One two two!!", b"", "É é 12 x".encode()]
    bucket, owner = Q.features(texts)
    for i, t in enumerate(texts):
        assert sorted(bucket[owner == i]) == sorted(Q.features([t])[0])
