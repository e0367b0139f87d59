"""Toxicity: held-out accuracy, lexicon counts against plain ones, the label model, odd rows."""

import random
import zlib

import numpy as np

from epilake.llm import toxicity as X

SCHEMA = "doc_id long, text string, toxic string, score int, terms string"


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("house", "garden", "river", "winter", "letter", "mountain") for b in ("", "s", "ly", "ing", "er")]
    bad = ["grobnik" + s for s in ("a", "ov", "ists", "est", "ling", "ed")] + ["idiot", "scum"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(3, 120))
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.7:
            labels.append((i, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    return docs, spark.createDataFrame([(d, q, "t") for d, q in labels], "doc_id long, toxic int, text string")


def _held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out(spark):
    rows, labels = corpus()
    odd = [(900, None), (901, ""), (902, "river " * 60_000), (903, "river " * 60_000 + "scum grobnikov idiot"), (None, "grobnikists scum"), (5, rows[5][1])]
    docs, lab = frames(spark, rows + odd, labels + [(5, None), (None, 1), (labels[0][0], labels[0][1])])
    train = X.toxic_rows(lab).where(~X.held_out(lab.doc_id))
    got = X.score(docs, train).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [(d, q) for d, q in labels if _held(d)]
    assert np.mean([by[d].predicted == q for d, q in held]) > 0.95
    assert by[900].score == by[901].score < 0.5 and by[902].predicted == 0 and by[903].predicted == 1 and by[None].predicted == 1


def test_lexicon_counts(spark):
    rows, labels = corpus(150, 2)
    docs, lab = frames(spark, rows, labels)
    labelled = docs.drop("toxic").join(X.toxic_rows(lab), "doc_id").select("text", "toxic")
    part = labelled.mapInArrow(X._frequency_partition, "term long, toxic long, clean long").groupBy("term").sum("toxic", "clean").collect()
    got = {r[0]: (r[1], r[2]) for r in part}
    want = {}
    truth = dict(labels)
    for d, t in rows:
        if d in truth:
            for term in {-1, *X.terms([t.encode()]).term.tolist()}:
                c = want.setdefault(term, [0, 0])
                c[1 - truth[d]] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_label_model_finds_rates_and_correlations():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.2
    votes = np.stack([np.where(rng.random(len(y)) < np.where(y, t, f), 1, 0) for t, f in ((0.8, 0.05), (0.7, 0.02), (0.6, 0.1), (0.5, 0.5))], axis=1)
    votes = np.concatenate((votes[:, :2], votes[:, 1:2], votes[:, 2:]), axis=1)  # a voter that copies another
    patterns, n = np.unique(np.concatenate((votes, -(votes[:, :4].max(axis=1, keepdims=True) == 0).astype(int)), axis=1), axis=0, return_counts=True)
    m = X.LabelModel(patterns.astype(float), n.astype(float))
    assert m.correlations[1, 2] > 0.8 > m.correlations[0, 1] and m.weight[1] < 0.7
    # the copied pair counts about once, the coin says nothing
    odds = np.log(m.rates[1][:, 2] / m.rates[0][:, 2])
    assert odds[0] > 1 and abs(odds[4]) < 0.5


def test_without_labels_or_rows(spark):
    docs, lab = frames(spark, [(1, "you idiot scum"), (2, "a quiet river"), (3, None)], [])
    rows = {r.doc_id: r.score for r in X.score(docs, X.toxic_rows(lab)).collect()}
    assert len(rows) == 3 and rows[1] >= rows[2]
    assert X.score(docs.limit(0), X.toxic_rows(lab)).collect() == []
