"""The pipeline against a plain version of its stages on a small corpus, and stage by stage."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from epilake.llm import lang_id, tokens
from test_lang_id import WORDS
from test_mixing import brute as mixing_brute
from test_near_dup import brute as near_brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(WORDS))
        text = " ".join(rng.choices([f"{w}{s}" for w in WORDS[lang] for s in ("", "s", "er", "in")], k=rng.randint(8, 70))) + "."
        rows.append([text, lang, f"s{i % 7 if i % 3 else 0}"])
    item = "how many red boxes does the old baker carry to the far market on a cold day"
    rows += [[rows[k][0], rows[k][1], "s1"] for k in range(20)]  # copies
    rows += [[rows[k][0] + " " + item + ".", rows[k][1], "s2"] for k in (30, 31, 32)]  # leaks
    rows += [[None, "en", "s1"], ["", "en", None], ["123 456", "de", "s3"], ["жили были дед да баба ели кашу с молоком " * 4, None, "s4"]]
    rng.shuffle(rows)
    rows = [(i, t, x, s, len(t or "")) for i, (t, x, s) in enumerate(rows)]
    return rows + [rows[5], (None, "the house and the water " * 3, "en", "s0", 72)], item


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, item = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, item


def test_run_against_plain_stages(spark, tables):
    folder, rows, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = lang_id.train(docs.select("doc_id", "text", "lang"))
    kept = [r for r, bad in zip(rows, lang_id.decide(model, [r[1] for r in rows])[3]) if not bad]
    assert 240 <= len(kept) < len(rows)
    groups = {d for d, _, c, keep in near_brute([(r[0], r[1]) for r in kept]) if keep and d is not None}
    one = {}
    for r in kept:
        if r[0] in groups:
            one.setdefault(r[0], r)
    kept = [*one.values(), *(r for r in kept if r[0] is None)]
    words = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
    kept = [r for r in kept if words(item) not in words(r[1])]
    copies = mixing_brute([(r[0], r[1], r[3]) for r in kept])
    out = sorted(((r[0] is not None, r[0] or 0, r[1]) for r, c in zip(kept, copies) for _ in range(c[4])))
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(tokens.tokenizer_path())
    want, at = [], 0
    for known, d, t in out:
        ids = whole.encode(t, add_special_tokens=False).ids + [2]
        want.append((d if known else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted((tuple(r) for r in P.run(spark, folder).collect()), key=lambda r: r[1])
    assert got == want and len(want) > 100


def test_stages_return_documents(spark, tables):
    folder, rows, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(P.STAGES) <= 5
    for name, stage in P.STAGES[:-1]:
        assert [(f.name, f.dataType) for f in stage(spark, docs, folder).schema] == [(f.name, f.dataType) for f in docs.schema], name


def test_empty(spark, tables, tmp_path):
    folder, *_ = tables
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
