"""Language models: probabilities, lookups, held-out accuracy, rejection, odd rows."""

import random
import re
import zlib

import numpy as np
import pytest

from epilake.llm import lang_id as L

SCHEMA = "doc_id long, text string, lang string, score string, rejected int"
WORDS = {"en": ["the", "and", "house", "with", "thing", "over", "water"], "de": ["der", "und", "haus", "über", "schön", "nicht", "straße"],
         "fr": ["les", "été", "maison", "très", "avec", "où", "chien"]}


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(5, 60))) + ".", lang))
    return rows


def brute_kn(texts, order, ctx, char):
    """p(char | ctx) by the definition, over dictionaries."""
    grams = {order: {}}
    for t in texts:
        s = " " * (order - 2) + " " + re.sub(r"[^a-z]+", " ", t.lower()).strip() + " "
        for i in range(len(s) - order + 1):
            grams[order][s[i:i + order]] = grams[order].get(s[i:i + order], 0) + 1
    for k in range(order - 1, 0, -1):
        grams[k] = {}
        for g in grams[k + 1]:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1
    p = 1 / (len(grams[1]) + 1)
    for k in range(1, order + 1):
        c = ctx[len(ctx) - k + 1:] if k > 1 else ""
        d = L._discount(np.array(list(grams[k].values())))
        own = {g: n for g, n in grams[k].items() if g[:-1] == c}
        if own:
            total = sum(own.values())
            p = max(own.get(c + char, 0) - d, 0) / total + d * len(own) / total * p
    return p


def model_of(rows, order=3):
    langs = sorted({r[2] for r in rows})
    parts = []
    for j, lang in enumerate(langs):
        u, n = np.unique(np.concatenate([L.ngrams(L.codes_of(t), order) for _, t, x in rows if x == lang]), return_counts=True)
        parts.append((np.full(len(u), j), u, n))
    return L.build_model(langs, *(np.concatenate(x) for x in zip(*parts)), order=order)


def test_probabilities_are_kneser_ney():
    rows = [(0, "abracadabra bar", "x"), (1, "cab abba", "x")]
    m = model_of(rows, 3)
    texts = [r[1] for r in rows]
    for ctx, char in [("ab", "r"), ("ab", "b"), ("ab", "z"), ("zz", "a"), ("br", "a"), (" c", "a"), ("qa", "b")]:
        g = np.array([sum(ord(c) << 12 * (2 - i) for i, c in enumerate(ctx + char))], np.uint64)
        assert np.exp(-m.losses(g)[0, 0]) == pytest.approx(brute_kn(texts, 3, ctx, char), rel=1e-4), (ctx, char)


def test_table_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 60, 5000, dtype=np.uint64))
    t = L.Table(keys[::2], np.arange(len(keys[::2]), dtype=np.float32)[:, None] + 1)
    got = t.values[t.find(keys)][:, 0]
    assert (got[::2] == np.arange(len(keys[::2])) + 1).all() and (got[1::2] == 0).all()


def test_codes():
    assert len(L.codes_of("")) == len(L.codes_of("12 34!")) == 0
    assert L.codes_of("Ab--9c").tolist() == [32, 97, 98, 32, 99, 32]


def _held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_rejection(spark):
    rows = corpus(600)
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "de"), (1003, "über schön und der", None), (None, "the house", "en"),
           (1004, "жили были дед да баба ели кашу с молоком " * 5, None), (1005, "the water " * 40000, None), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(d, t, x, "a", 1) for d, t, x in rows + odd], SCHEMA)
    df = df.withColumn("held_out", L.held_out(df.doc_id))
    model = L.train(df.where("not held_out"), calibrate=5)
    got = L.predict(df.select("doc_id", "text", "held_out"), model, keep=("doc_id", "held_out")).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    for d, _, x in rows:
        assert by[d].held_out == _held(d)
    held = [(d, x) for d, _, x in rows if _held(d)]
    assert np.mean([by[d].lang_pred == x for d, x in held]) > 0.97
    assert sum(by[d].rejected for d, _, _ in rows) <= 3
    for d in (1000, 1001, 1002):
        assert (by[d].lang_pred, by[d].score, by[d].rejected) == ("und", 0.0, True)
    assert by[1004].rejected and by[1003].lang_pred == "de" and by[1005].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text here", None, "a", 1)], SCHEMA)
    assert L.train(df) is None
    assert L.predict(df, None).collect()[0].lang_pred == "und"
    empty = spark.createDataFrame([], SCHEMA)
    assert L.predict(empty, L.train(empty)).collect() == []


def test_cutoff_keeps_model_within_rows(spark):
    df = spark.createDataFrame([(d, t, x, "a", 1) for d, t, x in corpus(200)], SCHEMA)
    big, small = L.train(df), L.train(df, model_rows=150)
    assert len(small.grams[-1].hashes) <= 151 < len(big.grams[-1].hashes)


def test_blocks_are_the_whole_model(spark):
    """Beyond the bound: same losses, discounts and predictions, and a rare language stays."""
    rows = [*corpus(200), (5000, "qat zyx", "rare"), (5001, "wol vyk", "rare")]
    df = spark.createDataFrame([(d, t, x, "a", 1) for d, t, x in rows + [(300, None, None), (301, "the", None), (7, rows[7][1], None)]], SCHEMA)
    big, small = L.train(df), L.train(df, model_rows=150)
    assert isinstance(small, L.Blocks) and len(small) > 3 and small.langs == big.langs and "rare" in small.langs
    assert small.temperature == pytest.approx(big.temperature)
    parts = [small.block(b) for b in range(len(small))]
    g = np.unique(np.concatenate([L.ngrams(L.codes_of(t)) for t in [r[1] for r in rows] + ["unseen quyx words été"]]))
    at = np.searchsorted(np.asarray(small.cuts, np.uint64), L._pair(g), "right")
    for b, m in enumerate(parts):
        assert np.allclose(m.losses(g[at == b]), big.losses(g[at == b]), atol=1e-5)
    order = lambda rows: sorted(map(str, ((r.doc_id, r.lang_pred, r.rejected, round(r.score, 3), round(r.cross_entropy, 3)) for r in rows)))
    assert order(L.predict(df, small).collect()) == order(L.predict(df, big).collect())
    assert L.predict(df.where("doc_id >= 5000"), small).where("lang_pred = 'rare'").count() == 2
    for model in (big, small):  # a kept text is the text
        got = L.predict(df, model, keep=("text", "doc_id"))
        assert got.columns[:3] == ["text", "doc_id", "lang_pred"]
        assert order(got.drop("text").collect()) == order(L.predict(df, model).collect())
        assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, df.select("doc_id", "text").collect()))


def test_noisy_labels_leave_rejection_on(spark):
    """Short and wrongly labelled training texts don't lift the bounds out of reach."""
    rng = random.Random(3)
    garbage = lambda n: "".join(rng.choices("qxzjkvw жщцъ", k=n))
    rows = corpus(900) + [(2000 + i, garbage(rng.randint(2, 40)), lang) for i, lang in enumerate(sorted(WORDS) * 6)]
    df = spark.createDataFrame([(d, t, x, "a", 1) for d, t, x in rows], SCHEMA)
    model = L.train(df, calibrate=3)
    rejected = L.decide(model, [garbage(300) for _ in range(20)])[3]
    assert rejected.all()
    assert L.decide(model, [t for _, t, _ in corpus(300, 9)])[3].sum() <= 3
