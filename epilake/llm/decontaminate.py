"""Benchmark decontamination by templates: finds benchmark items in documents, also with other numbers, names or units.

Tokens are runs of ASCII letters, digits and other non-ASCII bytes, letters of Latin-1 folded.
A token that begins with a digit (parts split by one "." or "," count as one) or
is a number word becomes <NUM>, a unit word behind a number <UNIT>, and, in a
second stream, a capitalised word <NAME>. The streams of an item are cut into
windows of WINDOW tokens; a document's windows are joined to them by hash. Each
joined window lies on a diagonal (document position less item position). On a
diagonal the slots must be consistent: one item value stands for one document
value throughout, and different names stay different, in at least CONSISTENT of
the slots. An item is found if consistent windows cover at least MATCHED of its
tokens or, if it is shorter, SHORT_SHARE of them.

The first stream finds passages whose case was changed, the second renamed ones;
a window of the first must hold LITERALS literal or name tokens at least, one of the
second a name and LITERALS literal tokens. A third stream has the tokens themselves and
no such condition: it finds exact copies, also of passages made of numbers.

The benchmark is a query set: it is packed by a hash of the item into blocks of at
most about BLOCK_BYTES of text, and every block is broadcast against all
documents. The join happens inside the tasks that read the documents, so these
are not shuffled and no passage, however common, meets in one task.

Items of one template are one class: they are joined and their slots are checked
once, and a document gets one row for the class. Only what their names or exact
tokens add is looked up below it, for items with equal names or tokens at once. A
window that many items share counts once a document, however often it stands there.

Edge cases: null or empty texts are never contaminated; null or empty items are found
nowhere. Items of fewer than LEAST tokens are found by the third stream if they hold a
number in digits and another two tokens, or two such numbers, else nowhere (a few words
are no evidence). Items of less than WINDOW tokens are one window. Repeated items are all
reported; repeated documents each get their rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilake.llm import text as T
from epilake.llm.tables import read_table

WINDOW = 8
LEAST = 5
MATCHED = 13
SHORT_SHARE = 0.8
LITERALS = 4
CONSISTENT = 0.8
BLOCK_BYTES = 16 << 20
#: Rows of windows joined at once, one document's at least.
CHUNK_ROWS = 1 << 20
OUT_ROWS = 10_000

NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
                "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
                "million billion half twice").split()
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound "
         "pounds ton tons ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days "
         "week weeks month months year years dollar dollars cent cents euro euros percent degree degrees").split()
LITERAL, NUM, NAME, UNIT, MERGED = range(5)
_PLACE = np.array([0, 0x1F0E1D2C3B4A5968, 0x2E3D4C5B6A798807, 0x3C2B1A0F9E8D7C6B], np.uint64)


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(T.words([w.encode() for w in words], T.PUNCT, latin=True)[0])


_NUMBER_HASHES, _UNIT_HASHES = _hashes(NUMBER_WORDS), _hashes(UNITS)


def _kinds(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, span) -> tuple[np.ndarray]:
    at = lambda i: b[np.minimum(i, len(b) - 1)]
    first, second, third = at(starts), at(starts + 1), at(starts + 2)
    low = lambda x: ((x >= 97) & (x <= 122)) | (x >= 128)
    title = (first >= 65) & (first <= 90) & low(second) & (ends - starts > 1)
    # capital letters of Latin-1, which are two bytes
    title |= (first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97) & low(third) & (ends - starts > 2)
    digit = (first >= 48) & (first <= 57)
    kind = np.where(digit, NUM, np.where(title, NAME, LITERAL)).astype(np.uint8)
    if len(starts) > 1:
        joint = (starts[1:] - ends[:-1] == 1) & np.isin(b[ends[:-1]], (44, 46)) & digit[1:] & digit[:-1]
        kind[1:][joint] = MERGED
    return (kind,)


class Tokens:
    """Hash, kind and stream values of the tokens of texts, with the number of tokens of each text."""

    def __init__(self, texts: list[bytes]):
        h, counts, more = T.words(texts, T.PUNCT, latin=True, also=_kinds)
        kind = more[0] if more else np.empty(0, np.uint8)
        own = kind != MERGED
        if not own.all():  # the value of a number covers all its parts
            group = np.cumsum(own) - 1
            value = h[own]
            np.bitwise_xor.at(value, group[~own], T.mix(h[~own]))
            owner = np.repeat(np.arange(len(texts)), counts)
            counts = np.bincount(owner[own], minlength=len(texts))
            h, kind = value, kind[own]
        kind[np.isin(h, _NUMBER_HASHES) & (kind != NUM)] = NUM
        first = (np.cumsum(counts) - counts)[counts > 0]
        behind = np.append(False, kind[:-1] == NUM)[:len(kind)]
        behind[first] = False
        kind[behind & np.isin(h, _UNIT_HASHES)] = UNIT
        self.value, self.kind, self.counts = h, kind, counts
        slot = (kind == NUM) | (kind == UNIT)
        self.streams = (np.where(slot, _PLACE[kind], h), np.where(kind > 0, _PLACE[kind], h), h)

    def windows(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each stream, below LEAST tokens the third alone: hashes of windows of n tokens, and the token that each begins at."""
        many = np.maximum(self.counts - n + 1, 0)
        starts = np.cumsum(self.counts) - self.counts
        at = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(many.sum())
        literal = np.concatenate(([0], np.cumsum(self.kind == LITERAL)))
        names = np.concatenate(([0], np.cumsum(self.kind == NAME)))
        for s in (0, 1, 2) if n >= LEAST else (2,):
            g, _ = T.grams(self.streams[s], self.counts, n, whole=False)
            if s == 0:  # not a run of slots alone
                keep = literal[at + n] - literal[at] + names[at + n] - names[at] >= min(n, LITERALS)
            elif s == 2:
                keep = np.ones(len(at), bool)
            else:
                keep = (names[at + n] > names[at]) & (literal[at + n] - literal[at] >= min(n, LITERALS))
            yield s, T.mix(g[keep] ^ np.uint64(s + 1)), at[keep]


def _keys(t: Tokens) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """For each text its keys as template, as template with names, and as tokens, and the numbers of its slot values.

    Texts of one template have equal typed tokens and repeat their slot values in the same places.
    """
    ends = np.cumsum(t.counts)
    for a, b in zip((ends - t.counts).tolist(), ends.tolist()):
        kind, value = t.kind[a:b], t.value[a:b]
        numbers, first = np.zeros(b - a, np.int64), {}
        for i in np.flatnonzero(kind).tolist():
            numbers[i] = first.setdefault((int(kind[i]), int(value[i])), len(first) + 1)
        digest = blake2b(t.streams[1][a:b].tobytes() + numbers.tobytes(), digest_size=8)
        keys = []
        for stream in (None, t.streams[0], t.streams[2]):
            if stream is not None:
                digest.update(stream[a:b].tobytes())
            keys.append(int.from_bytes(digest.digest(), "little", signed=True))
        yield (*keys, numbers)


class Benchmark:
    """Windows of a block of items, sorted by hash.

    Items of one template are one unit; where their names differ, those with equal names
    are units below it, and where their other values differ, those with equal tokens are
    units below these. A window that all items of a unit share is kept once, for the unit.
    """

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids = ids
        self.tokens = t = Tokens(texts)
        self.starts = np.cumsum(t.counts) - t.counts
        owner = np.repeat(np.arange(len(ids)), t.counts)
        keys = list(_keys(t))
        self.numbers = np.concatenate([k[3] for k in keys]) if keys else np.empty(0, np.int64)
        place = np.arange(len(owner)) - self.starts[owner]
        self._units([k[:3] for k in keys])
        slot = t.kind > 0
        self.known = np.unique(self._placed(self.root[self.unit[0][owner[slot]]], place[slot], t.value[slot]))
        digits = np.bincount(owner, (t.kind == NUM) & ~np.isin(t.value, _NUMBER_HASHES), len(ids))
        evident = (t.counts >= LEAST) | (digits >= 2) | ((digits == 1) & (t.counts > 2))
        named, slots = (np.concatenate(([0], np.cumsum(x))) for x in (t.kind == NAME, slot))
        self.windows: dict[int, tuple] = {}
        for n in sorted({WINDOW} | {int(c) for c in t.counts[evident] if c < WINDOW}):
            rows = []
            for s, h, at in t.windows(n):
                own = at + n
                level = np.zeros(len(at), np.int64) if s == 1 else (named[own] > named[at]).astype(np.int64) if s == 0 else 2 * (slots[own] > slots[at])
                item = owner[at]
                unit = self.unit[level, item]
                keep = self.first[level, item] == item
                if n < WINDOW:
                    keep &= (t.counts[item] == n) & evident[item]
                rows.append((h[keep], np.full(keep.sum(), s), place[at[keep]], unit[keep]))
            h, s, at, unit = (np.concatenate(x) for x in zip(*rows))
            by = np.argsort(h, kind="stable")
            marks = np.zeros(1 << 20, bool)
            marks[(h >> np.uint64(44)).astype(np.int64)] = True
            self.windows[n] = (h[by], s[by], at[by], unit[by], marks)

    def _units(self, keys: list[tuple[int, int, int]]) -> None:
        """unit, first: for each level and item its unit there and that level's first item of its kind. A unit has its first
        item, its parent (itself at the top), its top, its members and the key of what its members share."""
        groups: list[dict] = [{}, {}, {}]
        for i, k in enumerate(keys):
            for level in (0, 1, 2):
                groups[level].setdefault(k[level], []).append(i)
        self.first = np.array([[groups[x][k[x]][0] for k in keys] for x in (0, 1, 2)], np.int64).reshape(3, -1)
        self.unit = np.zeros((3, len(keys)), np.int64)
        self.item, self.parent, self.members, self.key = [], [], [], []
        for level in (0, 1, 2):
            for key, got in groups[level].items():
                above = int(self.unit[level - 1, got[0]]) if level else -1
                if level and len(got) == len(self.members[above]):  # as its parent
                    self.unit[level, got] = above
                    self.key[above] = key
                    continue
                self.unit[level, got] = u = len(self.item)
                self.item.append(got[0])
                self.parent.append(above if level else u)
                self.members.append(got)
                self.key.append(key)
        self.item, self.parent = np.array(self.item, np.int64), np.array(self.parent, np.int64)
        self.root = self.parent[self.parent]
        length = self.tokens.counts[self.item] if keys else np.empty(0, np.int64)
        self.need = np.minimum(MATCHED, np.ceil(SHORT_SHARE * length - 1e-9)).astype(np.int64)
        self.length = length

    @staticmethod
    def _placed(unit, place, value) -> np.ndarray:
        return T.mix(value ^ T.mix((unit.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64)))

    def hits(self, docs: Tokens) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length and stream: document tokens at which a window begins that the block has, and its rows there, from and to."""
        for n, (hashes, _, _, _, marks) in self.windows.items():
            for s, h, begin in docs.windows(n):
                may = np.flatnonzero(marks[(h >> np.uint64(44)).astype(np.int64)])
                lo, hi = np.searchsorted(hashes, h[may], "left"), np.searchsorted(hashes, h[may], "right")
                got = np.flatnonzero(hi > lo)
                yield n, s, begin[may[got]], lo[got], hi[got]


def _consistent(pairs: list[tuple[int, int, int]]) -> bool:
    """(kind, item value, document value) of the slots on a diagonal."""
    if not pairs:
        return True
    best: dict = {}
    taken: dict = {}
    for (kind, x, y), n in sorted(Counter(pairs).items(), key=lambda p: -p[1]):
        if (kind, x) not in best and not (kind == NAME and y in taken):
            best[kind, x] = n
            taken[y] = x
    return sum(best.values()) >= CONSISTENT * len(pairs)


def _ranges(lo: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())


class _Joined:
    """Windows of documents joined to a block: occurrences by document and window, and a window's rows once a document."""

    def __init__(self, bench: Benchmark, docs: Tokens):
        ends = np.cumsum(docs.counts)
        sizes = [len(w[0]) for w in bench.windows.values()]
        base = dict(zip(bench.windows, np.cumsum([0, *sizes]).tolist()))
        parts = [(np.searchsorted(ends, d, "right"), lo + base[n], hi - lo, d) for n, _, d, lo, hi in bench.hits(docs)]
        doc, run, many, d = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 4
        by = np.lexsort((d, run, doc))
        self.doc, self.run, many, self.d = doc[by], run[by], many[by], d[by]
        new = np.flatnonzero(np.append(True, (np.diff(self.doc) != 0) | (np.diff(self.run) != 0))) if len(by) else by
        self.lo, self.hi = new, np.append(new[1:], len(by))  # occurrences of each (document, window)
        self.doc, self.run, self.many = self.doc[new], self.run[new], many[new]

    def chunks(self, limit: int) -> Iterator[tuple[int, int]]:
        """Ranges of whole documents whose windows have at most `limit` rows, one document at least."""
        if not len(self.doc):
            return
        cut = np.append(np.flatnonzero(np.append(True, np.diff(self.doc) != 0)), len(self.doc))
        rows = np.append(0, np.cumsum(self.many))
        a = 0
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if x > a and rows[y] - rows[a] > limit:
                yield a, x
                a = x
        yield a, int(cut[-1])


def find(bench: Benchmark, texts: list[bytes], limit: int = CHUNK_ROWS) -> Iterator[tuple[int, int, int, float, int]]:
    """(text number, unit, tokens matched, share of the item, slots whose value no item of the template has there)
    of each unit found; of a unit that is found the units below are not told."""
    docs = Tokens(texts)
    lengths = np.concatenate([np.full(len(w[0]), n) for n, w in bench.windows.items()])
    streams, places, units = (np.concatenate([w[k] for w in bench.windows.values()]) for k in (1, 2, 3))
    joined = _Joined(bench, docs)
    for a, b in joined.chunks(limit):
        many = joined.many[a:b]
        row, cell = _ranges(joined.run[a:b], many), np.repeat(np.arange(a, b), many)
        doc, unit = joined.doc[cell], units[row]
        by = np.lexsort((places[row], unit, doc))
        row, cell, doc, unit = row[by], cell[by], doc[by], unit[by]
        # what a unit's windows cover at most, and with those of the units above
        new = np.append(True, (np.diff(doc) != 0) | (np.diff(unit) != 0))
        gap = np.append(places[row][1:] - places[row][:-1], 0)
        last = np.append(new[1:], True)
        covers = np.add.reduceat(np.where(last, lengths[row], np.minimum(gap, lengths[row])), np.flatnonzero(new))
        pair = doc[new] * len(bench.item) + unit[new]
        total, up = covers.copy(), unit[new]
        for _ in (1, 2):
            above = bench.parent[up]
            at = np.minimum(np.searchsorted(pair, doc[new] * len(bench.item) + above), len(pair) - 1)
            total += np.where((above != up) & (pair[at] == doc[new] * len(bench.item) + above), covers[at], 0)
            up = above
        alive = total >= bench.need[unit[new]]
        top = doc[new] * len(bench.item) + bench.root[unit[new]]
        keep = np.repeat(np.isin(top, top[alive]), np.diff(np.append(np.flatnonzero(new), len(row))))
        live = set(pair[alive].tolist())
        row, cell, doc, unit = row[keep], cell[keep], doc[keep], unit[keep]
        by = np.lexsort((unit, bench.root[unit], doc))
        row, cell, doc, unit = row[by], cell[by], doc[by], unit[by]
        top = bench.root[unit]
        new = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(top) != 0))) if len(row) else row
        for x, y in zip(new.tolist(), np.append(new[1:], len(row)).tolist()):
            yield from _family(bench, docs, joined, int(doc[x]), int(top[x]), unit[x:y], row[x:y], cell[x:y],
                               (lengths, streams, places), live)


def _family(bench: Benchmark, docs: Tokens, joined: _Joined, doc: int, top: int, unit, row, cell, windows, live) -> Iterator[tuple]:
    """The units of one template that are found in a document, from the template down."""
    lengths, streams, places = windows
    begin, length = int(bench.starts[bench.item[top]]), int(bench.length[top])
    kinds, numbers = bench.tokens.kind[begin:begin + length], bench.numbers[begin:begin + length]
    own: dict[int, tuple] = {}
    for u in np.unique(unit).tolist():
        mine = unit == u
        lo, hi = joined.lo[cell[mine]], joined.hi[cell[mine]]
        r = np.repeat(row[mine], hi - lo)
        own[u] = (streams[r], joined.d[_ranges(lo, hi - lo)] - places[r], places[r], lengths[r])

    def matched(chain: list[int]) -> tuple[int, int]:
        s, shift, at, n = (np.concatenate(z) for z in zip(*(own[u] for u in chain if u in own)))
        by = np.lexsort((s, shift))
        s, shift, at, n = s[by], shift[by], at[by], n[by]
        covered, changed = np.zeros(length, bool), 0
        cuts = np.flatnonzero(np.append(True, (np.diff(shift) != 0) | (np.diff(s) != 0)))
        for x, y in zip(cuts, np.append(cuts[1:], len(s))):
            sums = np.zeros(length + 1, np.int64)
            np.add.at(sums, at[x:y], 1)
            np.add.at(sums, at[x:y] + n[x:y], -1)
            has = np.cumsum(sums)[:length] > 0
            if not (has & ~covered).any():
                continue
            slot = np.flatnonzero(has & ((kinds > 0) if s[x] == 1 else ((kinds == NUM) | (kinds == UNIT)) & (s[x] == 0)))
            value = docs.value[slot + shift[x]]
            if _consistent(list(zip(kinds[slot].tolist(), numbers[slot].tolist(), value.tolist()))):
                fresh = ~covered[slot]
                placed = bench._placed(np.full(fresh.sum(), top), slot[fresh], value[fresh])
                changed += int((~np.isin(placed, bench.known)).sum())
                covered |= has
        return int(covered.sum()), changed

    done: dict[int, bool] = {}

    def judge(u: int, chain: list[int]) -> Iterator[tuple]:
        if u in done:
            return
        many, changed = matched(chain) if any(c in own for c in chain) else (0, 0)
        done[u] = many >= MATCHED or many >= SHORT_SHARE * length
        if done[u]:
            yield doc, u, many, many / length, changed

    yield from judge(top, [top])
    if done[top]:
        return
    for u in sorted(own):
        if u == top or doc * len(bench.item) + u not in live:
            continue
        middle = int(bench.parent[u])
        if middle != top:
            yield from judge(middle, [top, middle])
            if done[middle]:
                continue
        yield from judge(u, list(dict.fromkeys((top, middle, u))))


def _blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Benchmark]:
    """The items in blocks, each collected on its own and within the byte bound."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    dealt = items.withColumn("_b", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for b in range(n):
        got = dealt.where(F.col("_b") == b).select("item_id", "text").toArrow()
        if got.num_rows:
            yield Benchmark(got["item_id"].to_pylist(), T.texts_of(got["text"]))


CLASS_SCHEMA = "doc_id long, item_id long, class_id long, items long, matched_tokens long, item_share double, changed_slots long"
MATCH_SCHEMA = "doc_id long, item_id long, matched_tokens long, item_share double, changed_slots long"
MEMBER_SCHEMA = "item_id long, template_id long, named_id long, exact_id long"


def _found(docs: DataFrame, benchmark: DataFrame, schema: str, rows, block_bytes: int) -> DataFrame:
    """rows(block, unit): the columns between doc_id and matched_tokens, one tuple for each row of a unit found."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], schema)
    types = [pa.float64() if "double" in c else pa.int64() for c in schema.split(",")]
    names = [c.split()[0] for c in schema.split(",")]
    for block in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for batch in batches:
                texts, ids = T.texts_of(batch["text"]), batch["doc_id"].to_pylist()
                for a, b in T.groups(texts):
                    got = ((ids[a + d], *r, *more) for d, u, *more in find(bench, texts[a:b]) for r in rows(bench, u))
                    while part := list(islice(got, OUT_ROWS)):
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), types)], names)

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def class_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and class of items found in it, with the smallest item_id and the number of items of the
    class in its block. class_id is a template_id, named_id or exact_id of `members`."""
    def rows(bench, u):
        ids = [bench.ids[i] for i in bench.members[u]]
        return [(min((i for i in ids if i is not None), default=None), bench.key[u], len(ids))]

    return _found(docs, benchmark, CLASS_SCHEMA, rows, block_bytes)


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item found in it: the classes found with all their items."""
    return _found(docs, benchmark, MATCH_SCHEMA, lambda bench, u: [(bench.ids[i],) for i in bench.members[u]], block_bytes)


def members(benchmark: DataFrame) -> DataFrame:
    """Classes of each item: of its template, of its template with its names, and of its tokens. Null texts are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k[:3] for k in _keys(Tokens(T.texts_of(batch["text"])))]
            columns = zip(*keys) if keys else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["item_id"], *(pa.array(k, pa.int64()) for k in columns)],
                                             ["item_id", "template_id", "named_id", "exact_id"])

    return benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, MEMBER_SCHEMA)


def remove(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` without the rows in which an item is found, all columns kept."""
    spark = docs.sparkSession
    schema = docs.schema
    for block in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                texts = T.texts_of(batch["text"])
                keep = np.ones(len(texts), bool)
                for a, b in T.groups(texts):
                    keep[[a + r[0] for r in find(shared.value, texts[a:b])]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return class_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
