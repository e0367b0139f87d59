"""SimHash: edited texts, likeness and block-table search against brute force."""

import hashlib
import random

import numpy as np

from epilake.llm import simhash as S

SCHEMA = "doc_id long, text string, bucket string, real int"


def _docs():
    rng = random.Random(2)
    words = [f"w{i}é" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 400))), "x", 1) for i in range(60)]
    rows += [(60, None, None, None), (61, "", "x", 1), (62, "x", "x", 1), (63, "日本語テキスト", "x", 1), (64, "z" * 300_000, "x", 1)]
    base = " ".join(rng.choices(words, k=300))
    rows += [(70 + i, base, "x", 1) for i in range(20)] + [(100, "ab cd", "x", 1), (100, "tie two", "x", 1), (None, "no id", "x", 1)]
    rng.shuffle(rows)
    return rows


def test_edit_and_next(spark):
    rows = _docs()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = {}
    texts = [r[1] or "" for r in order]
    prints = S.fingerprints([t.encode() for t in texts])
    for k, (r, t) in enumerate(zip(order, texts)):
        nxt = texts[(k + 1) % len(texts)]
        n = len(t) // 2
        edited = t[:len(t) - n] + nxt[:n]
        fp = S.fingerprints([edited.encode()])
        want[(r[0], hashlib.sha256(edited.encode()).hexdigest())] = (
            len(t), prints[k].tobytes().hex(), fp[0].tobytes().hex(),
            float(S.likeness(prints[k:k + 1], fp)[0]), float(S.likeness(prints[k:k + 1], prints[[(k + 1) % len(texts)]])[0]))
    got = S.edited_likeness(spark.createDataFrame(rows, SCHEMA), parts=5).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.edited_sha256): tuple(r)[1:2] + tuple(r)[3:] for r in got} == want


def test_one_row_and_none(spark):
    one = S.edited_likeness(spark.createDataFrame([(5, "abcd", "", 0)], SCHEMA)).collect()
    assert [(r.doc_id, r.edited_sha256) for r in one] == [(5, hashlib.sha256(b"abab").hexdigest())]
    assert S.edited_likeness(spark.createDataFrame([], SCHEMA)).collect() == []


def test_likeness_follows_overlap():
    rng = random.Random(4)
    words = [f"t{i}" for i in range(5000)]
    a, b = rng.choices(words, k=2000), rng.choices(words, k=2000)
    near = []
    for share in (1.0, 0.9, 0.5, 0.0):
        mixed = a[:int(2000 * share)] + b[int(2000 * share):]
        fp = S.fingerprints([" ".join(a).encode(), " ".join(mixed).encode()])
        near.append(float(S.likeness(fp[:1], fp[1:])[0]))
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] and near[3] < 0.3 and 0.2 < near[2] < 0.8


def test_long_text_counts_like_short_path():
    words = [f"q{i % 37}" for i in range(3000)]
    h = np.arange(3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one = S._sums(h, np.array([3000]), 128)
    many = S._sums(h, np.array([200] * 15), 128).sum(axis=0)
    assert (one[0] == many).all() and len(words) == 3000


def test_search_finds_all_within_radius(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 256, (40, 16), dtype=np.uint8)
    rows = []
    for i in range(400):
        bits = np.unpackbits(base[i % 40])
        flip = rng.choice(128, rng.integers(0, 6), replace=False)
        bits[flip] ^= 1
        rows.append((i, np.packbits(bits).tobytes().hex()))
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # a group of equal fingerprints
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    got = {(r.query_id, r.doc_id): r.distance for r in S.search(df.where("doc_id % 50 = 0"), df, radius=3).collect()}
    as_int = {i: int(f, 16) for i, f in rows}
    want = {(q, d): (as_int[q] ^ as_int[d]).bit_count() for q in as_int if q % 50 == 0 for d in as_int}
    assert got == {k: v for k, v in want.items() if v <= 3}
