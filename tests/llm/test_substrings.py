"""Removal of repeated passages against a dictionary of all windows."""

import hashlib
import random
import re

import pytest

from epilake.llm import substrings as S

SCHEMA = "doc_id long, text string, bucket string, key long"
WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    for doc_id, text, *_ in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - window + 1):
            w = tuple(words[i:i + window])
            if doc_id is not None:
                first[w] = min(first.get(w, doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        words = WORD.findall(text or "")
        keep = [True] * len(words)
        for i in range(len(words) - window + 1):
            if doc_id is not None and first[tuple(words[i:i + window])] < doc_id:
                keep[i:i + window] = [False] * window
        kept = " ".join(w for w, k in zip(words, keep) if k)
        out.append((doc_id, len(words), keep.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    got = S.remove_repeats(spark.createDataFrame(rows, SCHEMA), **more).collect()
    return sorted((tuple(r) for r in got), key=str)


def _table(seed, window, n=120):
    """Shared passages at all places, near copies, copies, periodic texts, branches."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["né", "日本", "a\x85b", "x\xa0y", "."]
    passages = [rng.choices(vocabulary, k=rng.randint(window - 2, 4 * window)) for _ in range(6)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(0, 3 * window))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            b = rng.randint(2 * len(p) // 3, len(p))
            at = rng.randint(0, len(words))
            words[at:at] = p[a:b]
        if rows and rng.random() < 0.3:
            words = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.randint(0, 2)):
                if words:
                    words[rng.randrange(len(words))] = "edit"
        rows.append((rng.choice([i, i, i, 3, None] if i % 9 == 0 else [i]), rng.choice([" ", " ", "\n"]).join(words), "b", i))
    rows += [(500, "ha " * 200, "", 0), (501, "ha " * 150 + "end", "", 0), (502, "ha hi " * 90, "", 0), (503, "hi ha " * 90, "", 0),
             (504, None, "", 0), (505, "", "", 0), (506, " \n\t ", "", 0), (700, " ".join(passages[0] * 3), "", 0)]
    rows += [rows[20], rows[20], (rows[30][0], rows[40][1], "", 0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window,seed", [(8, 3), (50, 12), (5, 5)])
def test_against_all_windows(spark, window, seed):
    rows = _table(window, window)
    want = brute(rows, window)
    assert sum(r[2] > 0 for r in want) > 20
    assert run(spark, rows, window=window, seed=seed) == want


def test_hot_buckets_edge_by_edge(spark):
    rows = _table(4, 8)
    assert run(spark, rows, window=8, seed=3, hot=1) == brute(rows, 8)


def test_shuffled_texts(spark, monkeypatch):
    """Ids beyond the broadcast bound: texts are joined by a shuffle."""
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    rows = _table(6, 8, 60)
    assert run(spark, rows, window=8, seed=3) == brute(rows, 8)


def test_one_passage_in_a_third_of_the_rows(spark):
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(130)]
    rows = []
    for i in range(900):
        own = [f"{i}x{k}" for k in range(rng.randint(0, 60))]
        rows.append((i, " ".join(own[:20] + (passage if i % 3 == 0 else []) + own[20:]), "", 0))
    got = run(spark, rows)
    assert got == brute(rows, 50)
    assert sum(r[2] for r in got) >= 299 * 130


def test_a_long_text_and_an_empty_table(spark):
    text = " ".join(f"v{i}" for i in range(300_000))
    rows = [(1, text, "", 0), (2, "intro " + text[:200_000] + " outro", "", 0), (3, "z" * 500_000, "", 0)]
    assert run(spark, rows) == brute(rows, 50)
    assert run(spark, []) == []


def test_words_that_differ_from_the_source_stay():
    """Other words than those at the source's coordinates are kept, whatever the hashes say."""
    import pyarrow as pa
    words = [f"w{i}" for i in range(60)]
    text = " ".join(words)

    def removed(digest):
        span = [{"at": S.text_key(text.encode()) << 32 | 4, "size": 3, "digest": digest, "pieces": [{"off": 1, "n": 2}]}]
        batch = pa.RecordBatch.from_pylist([{"doc_id": 1, "text": text, "spans": span}])
        return next(S._remove_partition(50)(iter([batch])))["n_removed"].to_pylist()

    own = [w.encode() for w in words[4:4 + 52]]
    assert removed(S._digest(own)) == [51]
    assert removed(S._digest([b"other", *own[1:]])) == [0]


def test_whole_table(spark):
    from conftest import SF_SMALL
    from epilake.llm.tables import read_table
    rows = [tuple(r) for r in read_table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in S.op11_substrings(spark, SF_SMALL).collect()), key=str)
    assert got == brute(rows, 50)
