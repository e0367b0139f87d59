"""Token output: ids against the whole tokenizer, file order, positions, metadata pruning."""

import random
import zlib

import numpy as np
import pytest

from epilake.llm import tokens as K
from epilake.llm.tables import fresh_path

SCHEMA = "doc_id long, text string, start string, bucket string"


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(K.tokenizer_path())


def test_pieces_equal_whole_encoding(whole):
    rng = random.Random(3)
    parts = ["Hello,", "it's", "THE***", "naïve", "Straße", "été", "́x", "x\u0085y", "a b", "1,000.5kg",
             "<|endoftext|>", "a<|startoftext|>b", "ΟΔΟΣ", "İstanbul", "日本語", "don't!!", "\x1cq", "ß", "é!'s", "w'S", "µm", "🙂🙂", "_a_"]
    enc = K.WordEncoder(K.tokenizer_path())
    for _ in range(400):
        text = "".join(rng.choice(parts) + rng.choice([" ", "\n", "\t", "  ", "\r\n", ""]) for _ in range(rng.randint(0, 12)))
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text.encode()), "<u4").tolist() == want, repr(text)


def test_memo_is_bounded():
    m = K.Memo(10)
    for i in range(100):
        m.put(i, str(i))
        assert len(m) <= 10
    assert m.get(99) == "99"


def _rows(spark):
    rng = random.Random(5)
    texts = [None, "", "a", "the cat " * 3000] + [" ".join(rng.choices(["red", "blue", "Grün", "x1!"], k=rng.randint(1, 40)))
                                                   for _ in range(60)]
    rows = [(i * 7 % 64, t, "s", "b") for i, t in enumerate(texts)]
    rows += [(None, "nothing", "s", "b"), (5, None, "s", "b"), (5, "tie", "s", "b"), (5, "tie", "s", "b")]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA), rows


def test_round_trip_order_and_positions(spark, whole):
    df, rows = _rows(spark)
    path = fresh_path(spark, "t")
    K.write_tokens(df, path, parts=5)
    back = K.read_tokens(spark, path)
    got = {}
    for r in K.digests(back).collect():
        got.setdefault(r.start, r)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    at = 0
    for doc_id, text, *_ in sorted(rows, key=key):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        r = got[at]
        assert (r.doc_id, r.n_tokens, r.ids_crc32) == (doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(rows)
    ranges = sorted((r.min_doc_id, r.max_doc_id) for r in spark.read.orc(f"{path}/manifest").collect() if r.min_doc_id is not None)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:])) and len(ranges) > 1
    plan = back.where("doc_id = 9")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,9)" in plan
    assert back.where("doc_id = 9").count() == sum(r[0] == 9 for r in rows)


def test_empty(spark):
    assert K.tokenize_and_digest(spark.createDataFrame([], SCHEMA)).collect() == []
