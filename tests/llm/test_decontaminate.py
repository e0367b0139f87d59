"""Decontamination: planted passages, re-parameterised questions, slot consistency, odd rows."""

import random
import re

from epilake.llm import decontaminate as D

SCHEMA = "doc_id long, text string, item_id string, kind int"
ITEM = ("A train leaves Boston at 9 and travels 120 miles to Albany at 40 miles per hour, "
        "while Maria walks 3 km from Boston; how long does the train to Albany take?")


def found(doc, item=ITEM):
    bench = D.Benchmark([1], [item.encode()])
    return [(m, round(share, 2), changed) for _, _, m, share, changed in D.find(bench, [doc.encode()])]


def test_reparameterised():
    other = "Some words first. " + (ITEM.replace("Boston", "Denver").replace("Albany", "Austin").replace("Maria", "Peter")
                                    .replace("120", "1,250.5").replace("40", "75").replace("9", "eleven").replace("km", "miles")) + " And more."
    (m, share, changed), = found(other)
    assert share == 1.0 and changed >= 8
    assert found(ITEM.upper())[0][1] == 1.0  # case alone
    assert found("x " * 500 + ITEM)[0][1:] == (1.0, 0)


def test_slots_must_be_consistent():
    bad = ITEM.replace("from Boston", "from Dover").replace("leaves Boston", "leaves Austin").replace("train to Albany", "train to Lima").replace("miles to Albany", "miles to Cairo").replace("Maria", "Austin")
    assert not found(bad) or found(bad)[0][1] < 1.0
    swapped = [(D.NAME, 1, 7), (D.NAME, 2, 7), (D.NAME, 1, 8), (D.NAME, 2, 9)]
    assert not D._consistent(swapped) and D._consistent([(D.NUM, 1, 5), (D.NUM, 1, 5), (D.NAME, 2, 2)]) and D._consistent([])


def test_clean_texts_stay():
    rng = random.Random(1)
    vocabulary = re.findall(r"\w+", ITEM)
    for _ in range(50):
        assert not found(" ".join(rng.choices(vocabulary, k=200)))
    assert not found("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 " * 10, "5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20")


def brute(rows, items):
    """Verbatim items (lower-cased words without punctuation) inside documents."""
    tok = lambda s: " " + " ".join(re.findall(r"[^\W_]+", (s or "").lower())) + " "
    return [(d, i) for d, t in rows for i, x in items if x and len(tok(x).split()) >= D.LEAST and tok(x) in tok(t)]


def test_tables(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("th", "on", "er", "é") for b in ("an", "ing", "es", "ö")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(9, 30)))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "thing er"), (43, "short item of six words here"), (None, "item without id " + " ".join(words)), (44, items[0][1])]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 80)))) for i in range(80)]
    rows = [(i, t + " " + rng.choice(items[:30])[1].upper() + ". tail" if i % 4 == 0 else t) for i, t in rows]
    rows += [(90, None), (91, ""), (92, "so: Short item, of six WORDS here!"), (93, "thing er"), (None, items[1][1]), (94, items[2][1]), (94, items[2][1]),
             (95, "filler " * 60_000 + items[3][1]), (96, "x" * 300_000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    key = lambda p: str(p)
    for size in (D.BLOCK_BYTES, 600):  # one block, and several
        got = D.matches(df, bench, size).select("doc_id", "item_id").collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute(rows, items), key=key)
        dirty = {d for d, _ in brute(rows, items)}
        left = D.remove(df, bench, size)
        assert left.columns == df.columns
        assert sorted((r.doc_id for r in left.collect()), key=key) == sorted((d for d, _ in rows if d not in dirty), key=key)


def test_empty(spark):
    docs = spark.createDataFrame([(1, ITEM, "", 0)], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert D.matches(docs, none).collect() == [] and D.remove(docs, none).count() == 1
    assert D.matches(docs.limit(0), bench).collect() == []


def test_exact_copies_of_numbers():
    """Number-heavy and short items are found verbatim; other numbers in them are no copy."""
    around = "Some 3 words first. {} And 7 more of them."
    for item in ("What is 17 times 23?", "Compute 12 * 15", "12 * 15", "1 1 2 3 5 8 13 21 34 55", "Q: 4 8 15 16 23 42",
                 "year 1990 1991 1992 total 12.5 13,000 14 15 16 17 18 19 20"):
        (_, share, changed), = found(around.format(item), item)
        assert (share, changed) == (1.0, 0), item
        assert found(around.format(item.upper()), item), item
        assert not found(around.format(item.replace("1", "9").replace("2", "6")), item), item
    assert not found("page 2 of the thing er text 42", "page 2") and not found("a 42 b", "42") and not found("one day later", "one day later")


def plain_tokens(text):
    """(kind, value) of the tokens of an ASCII text."""
    out = []
    for m in re.finditer(r"\d[A-Za-z0-9]*(?:[.,]\d[A-Za-z0-9]*)*|[A-Za-z][A-Za-z0-9]*", text):
        w = m[0]
        if w[0].isdigit() or w.lower() in D.NUMBER_WORDS:
            kind = D.NUM
        elif w.lower() in D.UNITS and out and out[-1][2] == D.NUM:
            kind = D.UNIT
        else:
            kind = D.NAME if re.match(r"[A-Z][a-z]", w) else D.LITERAL
        out.append((kind, w.lower(), kind))
    return [(k, v) for k, v, _ in out]


def plain_found(doc, item):
    """Whether an item of WINDOW tokens or more is found, by every diagonal of every stream."""
    d, t = plain_tokens(doc), plain_tokens(item)
    covered = set()
    for stream in (0, 1, 2):
        slots = {0: (D.NUM, D.UNIT), 1: (D.NUM, D.UNIT, D.NAME), 2: ()}[stream]
        typed = lambda x: ("slot", x[0]) if x[0] in slots else x[1]
        for shift in range(-len(t), len(d)):
            own = set()
            for at in range(len(t) - D.WINDOW + 1):
                w = t[at:at + D.WINDOW]
                many = sum(k == D.LITERAL for k, _ in w)
                names = sum(k == D.NAME for k, _ in w)
                fits = stream == 2 or (many + names >= D.LITERALS if stream == 0 else names and many >= D.LITERALS)
                if fits and 0 <= at + shift and [typed(x) for x in w] == [typed(x) for x in d[at + shift:at + shift + D.WINDOW]]:
                    own |= set(range(at, at + D.WINDOW))
            if D._consistent([(t[i][0], t[i][1], d[i + shift][1]) for i in sorted(own) if t[i][0] in slots]):
                covered |= own
    return len(covered) >= D.MATCHED or len(covered) >= D.SHORT_SHARE * len(t)


def templated(rng, n):
    """Items of a few templates, some with a common first line, and texts made from them with other values."""
    names, units = ("Boston", "Maria", "Albany", "Peter", "Lima"), ("km", "miles", "hours")
    shapes = ["{0} buys {1} red boxes and gives {2} of them to {3} who has {1} old ones left",
              "find the sum of {1} and {2} then divide by {1} to get the answer",
              "read the text below and answer the question that follows with care, {0} walks {1} {u} in {2} hours to {3}",
              "read the text below and answer the question that follows with care, the shop sells {1} caps for {2} dollars"]

    def one():
        a, b = rng.choices(names, k=2)
        return rng.choice(shapes).format(a, rng.randint(2, 4), rng.randint(2, 4), b, u=rng.choice(units))

    items = [one() for _ in range(n)]
    texts = []
    for _ in range(n):
        words = one().split()
        for _ in range(rng.choice((0, 0, 1, 2))):
            words[rng.randrange(len(words))] = rng.choice(("other", "7", "Dora"))
        texts.append(" ".join(["so it goes"] * rng.randint(0, 2) + words[rng.randint(0, 4):len(words) - rng.randint(0, 4)] * rng.randint(1, 2)))
    return items, texts


def test_classes_against_all_pairs():
    rng = random.Random(11)
    items, texts = templated(rng, 60)
    bench = D.Benchmark(list(range(60)), [x.encode() for x in items])
    assert len(bench.members[0]) > 1 and len(bench.item) < 160
    want = {(d, i) for d, x in enumerate(texts) for i, y in enumerate(items) if plain_found(x, y)}
    assert 200 < len(want) < 3000
    for limit in (1, 100, D.CHUNK_ROWS):
        got = [(d, i) for d, u, *_ in D.find(bench, [x.encode() for x in texts], limit) for i in bench.members[u]]
        assert len(got) == len(set(got)) and set(got) == want


def test_hot_template_is_one_class(spark):
    """Thousands of items of one template give one row a document; a line that all items begin with costs no pairs."""
    text = "what is the total price of {} small pens and {} large books at the old shop"
    items = [(i, text.format(i + 2, 3 * i + 7_000)) for i in range(4000)]
    docs = [(d, "Exam. " + text.format(d + 31, 20_000 + d) + " End.", "x", 1) for d in range(40)] + [(99, text.format(2, 2), "x", 1), (100, "nothing", "x", 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.class_matches(df, bench).collect()}
    assert {(r.item_id, r.items, r.item_share) for r in got.values()} == {(0, 4000, 1.0)} and len(got) == 41
    assert got[0].changed_slots == 1 and got[30].changed_slots == 1
    ids = {r.named_id for r in D.members(bench).collect()}  # no names: the key of what all share
    assert {r.class_id for r in got.values()} == ids
    assert D.matches(df, bench).count() == 41 * 4000 and [r.doc_id for r in D.remove(df, bench).collect()] == [100]

    line = "please choose the best of all the answers below"
    some = D.Benchmark(list(range(2000)), [f"{line} q{i} a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i}".encode() for i in range(2000)])
    assert list(D.find(some, [(line + " and then. ").encode() * 200])) == []


def test_classes_of_odd_rows(spark):
    """Null ids, null and empty texts, copies, texts without a letter, extra columns."""
    bench = spark.createDataFrame([(None, ITEM, 1), (7, ITEM, 2), (8, None, 3), (9, "", 4), (10, "...", 5)], "item_id long, text string, class_id int")
    docs = spark.createDataFrame([(None, ITEM, "", 0), (1, ITEM, "", 0), (2, None, "", 0), (3, "", "", 0)], SCHEMA)
    got = D.class_matches(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.items, r.item_share, r.changed_slots) for r in got) == [("1", 7, 2, 1.0, 0), ("None", 7, 2, 1.0, 0)]
    exact = {(r.item_id, r.exact_id) for r in D.members(bench).collect()}
    assert {i for i, k in exact if k == got[0].class_id} == {None, 7} and {i for i, _ in exact} == {None, 7, 9, 10}
    assert D.members(bench.limit(0)).count() == 0 and D.class_matches(docs.limit(0), bench).count() == 0
