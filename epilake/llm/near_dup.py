"""MinHash near-duplicate groups with tensored banding.

Documents are sets of shingles (5 words; fewer words: all of them as one).
Two collections of `HALVES` half keys, each the hash of `ROWS` minimum hashes,
are computed for every set; a table's key pairs one half key of each collection,
so HALVES x HALVES tables of 2 x ROWS minima take only 2 x HALVES x ROWS minimum
hashes, about the square root of the independent number. Two sets of Jaccard
similarity s share a table with probability (1 - (1 - s^ROWS)^HALVES)^2: at the
threshold 0.75 that is 0.9999, above it more.

Steps, each a Spark job over written tables:

1. `sketches`: size, signature of the exact set and minimum hashes of every document.
   Documents of equal sets form a class with its smallest doc_id as representative.
2. Half keys that only one representative has are dropped; the live ones are
   paired into table keys. A table's rows are range-partitioned by (key, id) and
   read as a sorted stream, so a key of any size is cut across tasks; each task
   links a key's rows to its first row there (a star), and the first rows of keys
   that span tasks are linked in a second, small pass.
3. Of its star links every representative first tries the one with the most tables;
   links are confirmed on the full shingle sets, read again from the texts of the
   candidates, and joined into components.
4. Tables whose rows are in more than one component hold pairs that are not tested
   yet. Their rows are compared across components on packed sketches inside tasks.
   In MERGES rounds each component tries its most similar pair only; components
   that are joined by it drop out of each other's tables. For the rest, members of
   a group are packed into blocks of about BLOCK_SETS with their full sets. A task
   that finds a pair whose sketches allow the threshold names the two blocks, and
   all pairs of components of two named blocks are confirmed together on the sets.

So every pair that shares a table is either in one component already or compared.
Nothing that grows with the documents goes through the driver.

Edge cases: a null or empty text (or one without words) has the empty set and is
linked with nothing. Rows that repeat a doc_id are one document: what is linked
with any of them is linked with all; the result has a row for each of them. A row
without doc_id is in no group: its component_id is null and it is kept.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilake.llm import text as T
from epilake.llm.tables import lookup, only, partitions, ranked, read_table, written

SHINGLE = 5
THRESHOLD = 75  # percent
ROWS, HALVES = 3, 18
N_HASH = 2 * HALVES * ROWS
#: Standard deviations of a sketch's agreement that a pair may lie below the threshold's expectation.
SIGMAS = 5.0
#: Rounds in which a component tries its most similar pair, before all pairs are tried.
MERGES = 1
#: Rows of a mixed table that make a block, and components whose best pair a task holds.
BLOCK_ROWS = 512
MOST_HELD = 200_000
#: Sets in a block that is confirmed as a whole.
BLOCK_SETS = 64
#: Pairs of rows of small blocks, and rows of a large one, that are compared at once.
PAIRS, STEP = 1 << 16, 64

_rng = np.random.default_rng(1009)
_XOR = _rng.integers(0, 1 << 64, N_HASH, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 64, N_HASH, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each text, a group of texts at a time."""
    for a, b in T.groups(texts):
        h, counts, _ = T.words(texts[a:b])
        g, many = T.grams(h, counts, shingle, whole=True)
        ends = np.cumsum(many)
        yield a, [np.unique(g[e - m:e]) for e, m in zip(ends, many)]


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """N_HASH minimum hashes of each non-empty set; blocks of sets that fit a cache."""
    out = np.empty((len(sets), N_HASH), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(sets):
            j, n = i, 0
            while j < len(sets) and (j == i or n + len(sets[j]) <= 1 << 14):
                n += len(sets[j])
                j += 1
            x = np.concatenate(sets[i:j])
            at = np.cumsum([0] + [len(s) for s in sets[i:j - 1]])
            for k in range(N_HASH):
                out[i:j, k] = np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], at)
            i = j
    return out


SKETCH_SCHEMA = "doc_id long, n_shingles long, sig binary, minima binary"


def _sketch_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = T.texts_of(batch["text"]), batch["doc_id"]
        for a, sets in shingle_sets(texts):
            full = [s for s in sets if len(s)]
            minima = iter((_minima(full) >> np.uint64(32)).astype("<u4") if full else ())
            sig, mins = [], []
            for s in sets:
                if len(s):
                    with np.errstate(over="ignore"):
                        two = (int(s.sum(dtype=np.uint64)), int(T.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                    sig.append(struct.pack("<QQQ", *two, len(s)))
                    mins.append(next(minima).tobytes())
                else:
                    sig.append(None)
                    mins.append(None)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()),
                 pa.array(mins, pa.binary())], ["doc_id", "n_shingles", "sig", "minima"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def sketches(docs: DataFrame) -> DataFrame:
    return _texts(docs).mapInArrow(_sketch_partition, SKETCH_SCHEMA)


def _half_keys(minima: np.ndarray) -> np.ndarray:
    """n x 2 x HALVES keys; the side and the number in it are part of a key."""
    rows = minima.reshape(len(minima), 2 * HALVES, ROWS).astype(np.uint64)
    key = T.mix(np.arange(1, 2 * HALVES + 1, dtype=np.uint64))[None, :]
    for r in range(ROWS):
        key = T.mix(key ^ rows[:, :, r])
    return key.reshape(len(minima), 2, HALVES)


def _stack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, N_HASH)


def _half_partition(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            keys = _half_keys(_stack(part["minima"]))
            # the lowest bit tells the side
            keys = (keys << np.uint64(1)) | np.array([0, 1], np.uint64)[None, :, None]
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)),
                                              pa.array(np.repeat(np.asarray(part["id"]), 2 * HALVES))], ["key", "id"])


def _by_key(rows: DataFrame) -> DataFrame:
    """Sorted runs of a key; a run of many rows may span partitions."""
    order = ["key", "id"]
    return rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)


def _runs(batches, name="key"):
    """For each batch: keys, whether a row begins a run (judged with the batch before)."""
    last = None
    for batch in batches:
        key = np.asarray(batch[name])
        if len(key):
            new = np.empty(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = key[0] != last if last is not None else True
            last = key[-1]
            yield batch, key, new


def _live_partition(batches):
    """Rows of keys with more than one row; a partition's first and last run may go on elsewhere and stay."""
    held, begin = None, True  # held: the last row, if its run has no other row so far

    def rows(key, ids):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ids, pa.int64())], ["key", "id"])

    for batch, key, new in _runs(batches):
        ids = np.asarray(batch["id"])
        keep = ~(new & np.append(new[1:], True))
        if held is not None and not new[0]:
            yield rows([held[0]], [held[1]])
        held = None
        if begin:
            keep[0], begin = True, False
        elif new[-1]:
            held = (int(key[-1]), int(ids[-1]))
        if len(key) > 1 and new[-1] and held is None:
            held = (int(key[-1]), int(ids[-1]))
        yield rows(key[keep], ids[keep])
    if held is not None:
        yield rows([held[0]], [held[1]])


def _pair_partition(batches):
    """Table keys of each representative: its live half keys of one side with those of the other. Other
    columns are repeated."""
    for batch in batches:
        keys = batch["keys"]
        at, flat = np.asarray(keys.offsets), np.asarray(keys.values).view(np.uint64)
        rest = [n for n in batch.schema.names if n != "keys"]
        pairs, many, begin = [], [], 0
        for i in range(batch.num_rows):
            k = flat[at[i]:at[i + 1]]
            pairs.append(T.mix(T.mix(k[k & np.uint64(1) == 0])[:, None] ^ k[k & np.uint64(1) == 1][None, :]).ravel())
            many.append(len(pairs[-1]))
            if sum(many) > 1 << 17 or i + 1 == batch.num_rows:
                rows = pa.array(np.repeat(np.arange(begin, i + 1), many))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(pairs).view(np.int64)),
                                                  *[batch[n].take(rows) for n in rest]], ["key", *rest])
                pairs, many, begin = [], [], i + 1


STAR_SCHEMA = "a long, b long, key long, n long"


def _star_partition(batches):
    """(a, b, null, n): a run's first row in this partition with a later row, and the number of such runs in a
    batch. (a, null, key, 0): the first rows of the partition's first and last run, which may go on elsewhere."""
    centre, edges = None, []
    for batch, key, new in _runs(batches):
        ids = np.asarray(batch["id"])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        centres = np.where(begin >= 0, ids[begin], centre if centre is not None else 0)
        if not edges:
            edges.append((int(ids[0]), int(key[0])))
        centre, last_key = int(centres[-1]), int(key[-1])
        keep = ~new & (centres != ids)
        if keep.any():
            pairs, n = np.unique(np.stack([centres[keep], ids[keep]], axis=1), axis=0, return_counts=True)
            yield _star_batch(pairs[:, 0], pairs[:, 1], None, n)
    if edges:
        if (centre, last_key) != edges[0]:
            edges.append((centre, last_key))
        yield _star_batch([e[0] for e in edges], None, [e[1] for e in edges], [0] * len(edges))


def _star_batch(a, b, key, n):
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()),
         pa.nulls(len(a), pa.int64()) if key is None else pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "key", "n"])


def _first_links(table_rows: DataFrame) -> DataFrame:
    """(a, b), a < b: for each row that is not first in all its tables, the first row that it meets most often."""
    got = written(_by_key(table_rows).mapInArrow(_star_partition, STAR_SCHEMA), "near-stars")
    # two rows for each partition at most
    ends = got.where("key is not null").groupBy("key").agg(F.min("a").alias("a"), F.collect_set("a").alias("more"))
    across = ends.select("a", F.explode("more").alias("b"), F.lit(1).cast("long").alias("n")).where("a < b")
    votes = got.where("key is null").select("a", "b", "n").unionByName(across).groupBy("a", "b").agg(F.sum("n").alias("n"))
    best = votes.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("m"))
    return best.select((-F.col("m.a")).alias("a"), "b")


def _set_partition(batches):
    for batch in batches:
        texts, ids = T.texts_of(batch["text"]), batch["doc_id"].to_pylist()
        for a, sets in shingle_sets(texts):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:a + len(sets)], pa.int64()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])


def _confirm_partition(threshold: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= threshold * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(mask)

    return run


def confirm(pairs: DataFrame, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold; texts of other documents are not read on."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs)
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return rows.mapInArrow(_confirm_partition(threshold), "a long, b long")


#: Links that a task contracts by itself.
CONTRACT = 200_000


def _contract_partition(batches):
    """The links of a task as stars: each id with the smallest one that it reaches there."""
    root: dict[int, int] = {}

    def find(i):
        top = i
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(i, i)) != top:
            root[i], i = top, up
        return top

    def stars():
        rows = [(find(i), i) for i in list(root)]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > 5 * CONTRACT:  # a larger task than planned goes on with an empty memory
            yield stars()
            root.clear()
    yield stars()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id with a link; component is the smallest id reachable.

    Tasks of about CONTRACT links each turn these into stars first, which keeps what is
    connected; one such task is the result. Stars of several tasks go on in rounds.
    Alternating stars: every id links its larger neighbours to its smallest
    (large star), then its smaller ones and itself to the smallest (small star),
    until nothing changes; a number of rounds that grows with the logarithm of the
    longest path. Aggregates combine before the shuffle, and rounds are written.
    """
    now = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "near-links")
    tasks = -(-now.count() // CONTRACT)
    stars = now.coalesce(max(1, tasks)).mapInArrow(_contract_partition, "a long, b long")
    now = written(stars.distinct() if tasks > 1 else stars, "near-links")
    total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while total[0] and tasks > 1:
        both = now.select(F.col("b").alias("v"), F.col("a").alias("u")).unionByName(now.select(F.col("a").alias("v"), F.col("b").alias("u")))
        least = both.groupBy("v").agg(F.least("v", F.min("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = lookup(both.where("u > v"), least, "v", "near-least", how="inner", weight="n").select(F.col("m").alias("a"), F.col("u").alias("b")).where("a < b").distinct()
        large = written(large, "near-large")
        smallest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(smallest, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")),
                                                                   F.struct(F.col("m").alias("a"), "b"))).alias("l"))
        now = written(small.select("l.*").where("a < b").distinct(), "near-links")
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == total:
            break
        total = after
    return now.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "id").unionByName(
        now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


#: Minima in 64-bit lanes of 16 nibbles.
LANES = -(-N_HASH // 16)
_ONES = np.uint64(0x1111111111111111)


def _packed(minima: np.ndarray) -> np.ndarray:
    """The lowest 4 bits of each minimum, two to a byte, filled up with zeros to whole lanes."""
    low = np.zeros((len(minima), 16 * LANES), np.uint8)
    low[:, :N_HASH] = minima & 15
    return low[:, ::2] << 4 | low[:, 1::2]


def _least_agreement(threshold: int) -> int:
    s = threshold / 100
    p = s + (1 - s) / 16
    return int(np.floor(N_HASH * p - SIGMAS * np.sqrt(N_HASH * p * (1 - p))))


def _agreement(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    """Equal minima of pairs of sketches (last axis: lanes) of sets of sizes n and m; 0 where these rule the
    threshold out."""
    differ = np.zeros(np.broadcast_shapes(x.shape, y.shape)[:-1], np.uint8)
    for k in range(LANES):
        d = x[..., k] ^ y[..., k]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        d &= _ONES  # a bit for each nibble that differs
        differ += np.bitwise_count(d)
    same = N_HASH - differ.astype(np.int64)
    size = 100 * np.minimum(n, m) >= threshold * np.maximum(n, m)
    return np.where(size & (same >= _least_agreement(threshold)), same, 0)


PAIR_SCHEMA = "component long, same long, a long, b long"
BLOCK_SCHEMA = "p long, q long"


class _Side:
    """The rows of the blocks of a batch, one block after another."""

    def __init__(self, batch, side: str):
        lists = {c: batch[f"{side}_{c}"] for c in ("ids", "comps", "ns", "blks", "low")}
        at = np.asarray(lists["ids"].offsets).astype(np.int64)
        self.first, self.size = at[:-1] - at[0], np.diff(at)
        self.ids, self.comps, self.ns, self.blks = (np.asarray(lists[c].flatten()) for c in ("ids", "comps", "ns", "blks"))
        low = lists["low"].flatten()
        begin = int(np.frombuffer(low.buffers()[1], np.int32)[low.offset]) if len(low) else 0
        self.low = np.frombuffer(low.buffers()[2], np.uint8, len(low) * LANES * 8, begin).view(np.uint64).reshape(-1, LANES) if len(low) else np.empty((0, LANES), np.uint64)


def _mixed_partition(threshold: int, best: bool):
    """Pairs of different components of two blocks of a table's rows (or one block with itself).

    best: of all pairs of a task only the most similar one of each component, under its name, at the task's end (and
    whenever MOST_HELD components are held); else the set blocks of the pairs.
    """

    def pairs_of(x, y, i, j):
        """Rows (component, same, a, b), or (p, q), of pairs of rows i of x and j of y."""
        ok = (x.comps[i] != y.comps[j]) & (100 * np.minimum(x.ns[i], y.ns[j]) >= threshold * np.maximum(x.ns[i], y.ns[j]))
        i, j = i[ok], j[ok]
        same = _agreement(x.low[i], x.ns[i], y.low[j], y.ns[j], threshold)
        ok = same > 0
        i, j, same = i[ok], j[ok], same[ok]
        a, b = np.minimum(x.ids[i], y.ids[j]), np.maximum(x.ids[i], y.ids[j])
        if best:
            names = np.append(x.comps[i], y.comps[j])
            return one_each(np.stack([names, np.tile(same, 2), np.tile(a, 2), np.tile(b, 2)]))
        p, q = x.blks[i], y.blks[j]
        return np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)]), axis=1)

    def blocks(x, y, one):
        """Indexes of the pairs of all blocks, PAIRS or one block's STEP rows at a time."""
        many = x.size * y.size
        held, total = [], 0
        for k in np.argsort(many, kind="stable"):
            if many[k] > PAIRS:
                continue
            held.append(k)
            total += many[k]
            if total > PAIRS:
                yield small(x, y, one, np.array(held))
                held, total = [], 0
        if held:
            yield small(x, y, one, np.array(held))
        for k in np.flatnonzero(many > PAIRS):
            i, j = x.first[k] + np.arange(x.size[k]), y.first[k] + np.arange(y.size[k])
            for begin in range(0, len(i), STEP):
                part = i[begin:begin + STEP]
                rest = j[begin:] if one[k] else j
                u, v = np.repeat(part, len(rest)), np.tile(rest, len(part))
                keep = u < v if one[k] else np.ones(len(u), bool)
                yield u[keep], v[keep]

    def small(x, y, one, rows):
        many = x.size[rows] * y.size[rows]
        row = np.repeat(np.arange(len(rows)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        wide = y.size[rows][row]
        i, j = at // wide, at % wide
        keep = ~one[rows][row] | (i < j)
        return x.first[rows][row][keep] + i[keep], y.first[rows][row][keep] + j[keep]

    def one_each(rows):
        """The best row (component, same, a, b) of each component: most agreement, then least ids."""
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        return rows[:, np.append(True, np.diff(rows[0]) != 0)[:rows.shape[1]]]

    def run(batches):
        seen: set = set()
        held = np.empty((4, 0), np.int64)
        for batch in batches:
            x, y = _Side(batch, "x"), _Side(batch, "y")
            for i, j in blocks(x, y, np.asarray(batch["one"].to_pylist(), bool)):
                rows = pairs_of(x, y, i, j)
                if best:
                    held = one_each(np.concatenate([held, rows], axis=1)) if rows.shape[1] else held
                    if held.shape[1] > MOST_HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], ["component", "same", "a", "b"])
                        held = np.empty((4, 0), np.int64)
                    continue
                if rows.shape[1]:
                    fresh = [t not in seen for t in zip(*rows.tolist())]
                    rows = rows[:, np.array(fresh, bool)]
                    if len(seen) > MOST_HELD:
                        seen.clear()
                    seen.update(zip(*rows.tolist()))
                if rows.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["p", "q"])
        if held.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], ["component", "same", "a", "b"])

    return run


def _low_partition(batches):
    for batch in batches:
        low = _packed(_stack(batch["minima"]))
        yield pa.RecordBatch.from_arrays([batch["id"], batch["n"], pa.array([r.tobytes() for r in low], pa.binary())], ["id", "n", "low"])


def _placed(live: DataFrame, first: DataFrame, comps: DataFrame) -> DataFrame:
    """id, keys, component (its own id without one) and blk of every live representative.

    A block holds about BLOCK_SETS members of one group: of a component, or of those whose first link leads to it.
    """
    label = comps.select("id", "component")
    rows = live.join(label, "id", "left").join(first.select(F.col("b").alias("id"), F.col("a").alias("_centre")), "id", "left")
    rows = rows.withColumn("_centre", F.coalesce("_centre", "id")).join(
        label.select(F.col("id").alias("_centre"), F.col("component").alias("_other")), "_centre", "left")
    rows = rows.select("id", "keys", F.coalesce("component", "id").alias("component"), F.coalesce("component", "_other", "_centre").alias("hub"))
    rows = written(rows, "near-hubs")
    sizes = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK_SETS).alias("n_blocks"))
    rows = lookup(rows, sizes, "hub", "near-hub-sizes", how="inner", weight="n")
    blk = F.xxhash64("hub", F.pmod(F.xxhash64("id"), F.col("n_blocks")))
    return written(rows.select("id", "component", "keys", blk.alias("blk")), "near-placed")


def _packed_low(reps: DataFrame) -> DataFrame:
    return reps.select("id", F.col("n_shingles").alias("n"), "minima").mapInArrow(_low_partition, "id long, n long, low binary")


def _untested(placed: DataFrame, reps: DataFrame, threshold: int, best: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a table and whose sketches allow the threshold: with
    `best` only the most similar one of each component, else the blocks (p, q) of such pairs.

    Tables inside one component are found by their least and largest component (a
    partial aggregate) and dropped. The rows of a mixed table are packed into blocks of about
    BLOCK_ROWS by component: a component of as many rows there has blocks of its own, the others share
    blocks. Only blocks that can hold different components are paired, by their numbers; rows are then
    joined to the pairs by (table, block). So a large component is compared with the outsiders of a
    table, never with itself, and a hot table spreads over as many tasks as it has blocks.
    """
    rows = placed.mapInArrow(_pair_partition, "key long, id long, component long, blk long")
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n_rows"))
    mixed = mixed.where("lo < hi").select("key", "n_rows")
    rows = written(lookup(rows, mixed, "key", "near-mixed", how="inner", weight="n_rows"), "near-mixed-rows")

    sizes = written(rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")), "near-mixed-sizes")
    large = sizes.where(F.col("n") >= BLOCK_ROWS).select("key", "component", F.ceil(F.col("n") / BLOCK_ROWS).alias("n_own"))
    packs = sizes.where(F.col("n") < BLOCK_ROWS).groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_ROWS).alias("n_packs"))
    # units: a large component with its own blocks, or one shared block
    units = large.select("key", F.lit(True).alias("own"), F.col("component").alias("unit"), "n_own").unionByName(
        packs.select("key", F.lit(False).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_packs") - 1)).alias("unit"),
                     F.lit(1).cast("long").alias("n_own")))
    units = written(units, "near-units")
    left, right = (units.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("own", "unit", "n_own")]) for s in "xy")
    order = F.struct("x_own", "x_unit"), F.struct("y_own", "y_unit")
    met = left.join(right, "key").where((order[0] < order[1]) | ((order[0] == order[1]) & ~F.col("x_own")))
    number = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    met = met.withColumn("x_at", number("x_n_own")).withColumn("y_at", number("y_n_own"))
    block = lambda own, unit, at: F.xxhash64("key", own, unit, at)
    met = met.select(block("x_own", "x_unit", "x_at").alias("x_block"), block("y_own", "y_unit", "y_at").alias("y_block"))

    rows = rows.join(large, ["key", "component"], "left").join(packs, "key", "left").join(_packed_low(reps), "id")
    own = F.col("n_own").isNotNull()
    unit = F.when(own, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.col("n_packs")))
    at = F.when(own, F.pmod(F.xxhash64("id"), F.col("n_own"))).otherwise(F.lit(0).cast("long"))
    rows = rows.select(block(own, unit, at).alias("block"), F.struct("id", "component", "n", "blk", "low").alias("r"))
    packed = rows.groupBy("block").agg(F.collect_list("r").alias("r"))  # about BLOCK_ROWS rows
    packed = written(packed.select("block", F.col("r.id").alias("ids"), F.col("r.component").alias("comps"), F.col("r.n").alias("ns"),
                                   F.col("r.blk").alias("blks"), F.col("r.low").alias("low")), "near-blocks")
    x, y = (packed.select(F.col("block").alias(f"{s}_block"), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "comps", "ns", "blks", "low")]) for s in "xy")
    met = met.join(x, "x_block").join(y, "y_block").withColumn("one", F.col("x_block") == F.col("y_block")).drop("x_block", "y_block")
    if best:
        pairs = met.mapInArrow(_mixed_partition(threshold, True), PAIR_SCHEMA)
        pairs = pairs.groupBy("component").agg(F.max(F.struct("same", "a", "b")).alias("m")).select("m.a", "m.b")
        return pairs.distinct()
    return met.mapInArrow(_mixed_partition(threshold, False), BLOCK_SCHEMA).distinct()


def _confirm_blocks(threshold: int):
    """Links between different components of two blocks of sets (or inside one), one for two components."""

    def members(batch, side, k):
        return [(i, c, n, np.frombuffer(low, np.uint64), np.frombuffer(s, np.uint64)) for i, c, n, low, s in zip(
            *(batch[f"{side}_{c}"][k].as_py() for c in ("ids", "comps", "ns", "low", "sets")))]

    def run(batches):
        linked: set = set()
        for batch in batches:
            for k in range(batch.num_rows):
                xs = members(batch, "x", k)
                one = batch["p"][k].as_py() == batch["q"][k].as_py()
                ys = xs if one else members(batch, "y", k)
                comps, ns = np.array([y[1] for y in ys]), np.array([y[2] for y in ys])
                low = np.stack([y[3] for y in ys])
                out = []
                for at, (i, c, n, mine, own) in enumerate(xs):
                    ok = (comps != c) & (_agreement(mine[None, :], n, low, ns, threshold) > 0)
                    if one:
                        ok[:at + 1] = False
                    some = [j for j in np.flatnonzero(ok) if (min(c, int(comps[j])), max(c, int(comps[j]))) not in linked]
                    if not some:
                        continue
                    flat = np.concatenate([ys[j][4] for j in some])
                    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                    both = np.add.reduceat(hit, np.cumsum([0] + [len(ys[j][4]) for j in some[:-1]]), dtype=np.int64)
                    for j, m in zip(some, both.tolist()):
                        pair = (min(c, int(comps[j])), max(c, int(comps[j])))
                        if 100 * m >= threshold * (len(own) + len(ys[j][4]) - m) and pair not in linked:
                            linked.add(pair)
                            out.append((min(i, ys[j][0]), max(i, ys[j][0])))
                if len(linked) > 1_000_000:
                    linked.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return run


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Written (id, shingles) of the asked documents (ids: column doc_id, unique)."""
    texts = lookup(_texts(docs), ids.withColumn("_n", F.lit(1)), "doc_id", "near-asked", how="inner")
    return written(texts.select("doc_id", "text").mapInArrow(_set_partition, "id long, shingles binary"), "near-sets")


def confirm_blocks(blocks: DataFrame, placed: DataFrame, reps: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between the components of the named blocks (p, q)."""
    named = written(blocks.select(F.explode(F.array("p", "q")).alias("blk")).distinct(), "near-named")
    rows = written(placed.select("id", "component", "blk").join(named, "blk", "left_semi"), "near-members")
    sets = _sets_of(rows.select(F.col("id").alias("doc_id")).distinct(), docs)
    rows = rows.join(_packed_low(reps), "id").join(sets, "id")
    # a representative's n is of one of its rows; a set's own size counts
    packed = rows.select("blk", F.struct("id", "component", (F.octet_length("shingles") / 8).cast("long").alias("n"), "low", "shingles").alias("r"))
    packed = packed.groupBy("blk").agg(F.collect_list("r").alias("r"))
    packed = written(packed.select("blk", F.col("r.id").alias("ids"), F.col("r.component").alias("comps"), F.col("r.n").alias("ns"),
                                   F.col("r.low").alias("low"), F.col("r.shingles").alias("sets")), "near-set-blocks")
    x, y = (packed.select(F.col("blk").alias(k), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "comps", "ns", "low", "sets")]) for k, s in (("p", "x"), ("q", "y")))
    met = blocks.join(x, "p").join(y, "q")
    return met.mapInArrow(_confirm_blocks(threshold), "a long, b long")


def _sketch_filter(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """Drops pairs whose sketches or sizes rule the threshold out."""
    side = reps.select("id", F.col("n_shingles").alias("n"), "minima")
    rows = pairs.join(side.select(F.col("id").alias("a"), F.col("n").alias("xn"), F.col("minima").alias("x")), "a")
    rows = rows.join(side.select(F.col("id").alias("b"), F.col("n").alias("yn"), F.col("minima").alias("y")), "b")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                same = ((_stack(part["x"]) & 15) == (_stack(part["y"]) & 15)).sum(axis=1)
                n, m = np.asarray(part["xn"]), np.asarray(part["yn"])
                keep = (same >= _least_agreement(threshold)) & (100 * np.minimum(n, m) >= threshold * np.maximum(n, m))
                yield pa.RecordBatch.from_arrays([part["a"], part["b"]], ["a", "b"]).filter(pa.array(keep))

    return rows.select("a", "b", "xn", "yn", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`; what is written on the way is deleted."""
    return only(docs.sparkSession, lambda: _near_duplicates(docs, threshold), "near-result")


def _near_duplicates(docs: DataFrame, threshold: int) -> DataFrame:
    spark = docs.sparkSession
    sketch = written(sketches(docs), "near-sketches")
    full = sketch.where("sig is not null and doc_id is not null")
    classes = full.groupBy("sig").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n_docs"))
    classes = written(classes, "near-classes")
    firsts = full.join(classes.select(F.col("id").alias("doc_id"), "sig"), ["doc_id", "sig"], "left_semi")
    reps = written(firsts.select(F.col("doc_id").alias("id"), "n_shingles", "minima").distinct(), "near-reps")

    # documents whose rows have different texts link the classes of these
    twice = full.groupBy("doc_id").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo < hi").select("doc_id")
    twice = written(full.select("doc_id", "sig").join(twice, "doc_id", "left_semi"), "near-twice").join(classes, "sig").select("doc_id", "id")
    same_doc = twice.join(twice.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a < b")

    halves = reps.select("id", "minima").mapInArrow(_half_partition, "key long, id long")
    live = _by_key(halves).mapInArrow(_live_partition, "key long, id long")
    live = live.groupBy("id").agg(F.collect_set("key").alias("keys"))  # 2 x HALVES keys at most
    live = written(live, "near-live")
    table_rows = live.mapInArrow(_pair_partition, "key long, id long")

    tested = only(spark, lambda: _first_links(table_rows), "near-tested")
    links = only(spark, lambda: confirm(_sketch_filter(tested, reps, threshold), docs, threshold).unionByName(same_doc), "near-confirmed")
    comps = only(spark, lambda: components(links), "near-components")

    first = tested
    for _ in range(MERGES):
        pairs = only(spark, lambda: _untested(_placed(live, first, comps), reps, threshold, best=True).join(tested, ["a", "b"], "left_anti"), "near-pairs")
        if not pairs.head(1):
            break
        links = only(spark, lambda: links.unionByName(confirm(pairs, docs, threshold)), "near-confirmed")
        tested = written(tested.unionByName(pairs), "near-tested")
        comps = only(spark, lambda: components(links), "near-components")
    placed = only(spark, lambda: _placed(live, first, comps), "near-placed")
    blocks = only(spark, lambda: _untested(placed, reps, threshold, best=False), "near-block-pairs")
    if blocks.head(1):
        more = only(spark, lambda: confirm_blocks(blocks, placed, reps, docs, threshold), "near-more")
        if more.head(1):
            comps = only(spark, lambda: components(links.unionByName(more)), "near-components")

    classes = classes.join(comps, "id", "left").select("sig", F.coalesce("component", "id").alias("component_id"), "n_docs")
    out = lookup(sketch.select("doc_id", "n_shingles", "sig"), classes, "sig", "near-labels", weight="n_docs")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs`, one document of each near-duplicate group: that with the smallest doc_id.

    A document is a doc_id with a text: rows that share a doc_id but not the text are judged as documents of their
    own (the others than the first by text hash behind all doc_ids), of rows that share both one stays. A null doc_id
    is in no group and stays. Columns and values stay as they are.
    """
    spark = docs.sparkSession
    known = docs.where("doc_id is not null")
    several = written(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "near-repeated")
    if not several.head(1):
        kept = only(spark, lambda: near_duplicates(known, threshold).where("kept").select("doc_id"), "near-kept")
        return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))

    # rows of a repeated doc_id under numbers of their own, one for each text
    text_hash = F.sha2(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")), 256)
    some = lookup(known.select("doc_id", "text"), several, "doc_id", "near-repeated-ids", how="left_semi")
    texts = some.select("doc_id", text_hash.alias("_hash")).distinct()
    first = texts.groupBy("doc_id").agg(F.min("_hash").alias("_first"))
    top = known.agg(F.max("doc_id")).first()[0]
    numbers = ranked(texts, [F.col("doc_id"), F.col("_hash")], "_rank", "near-texts").join(first, "doc_id")
    number = F.when(F.col("_hash") == F.col("_first"), F.col("doc_id")).otherwise(F.lit(top) + 1 + F.col("_rank"))
    numbers = written(numbers.select("doc_id", "_hash", number.alias("_id")), "near-numbers")
    one = F.min(F.struct(*docs.columns)).alias("_row")
    rows = lookup(known, several, "doc_id", "near-repeated-rows", how="left_semi")
    rows = rows.withColumn("_hash", text_hash).groupBy("doc_id", "_hash").agg(one).join(numbers, ["doc_id", "_hash"]).select("_id", "_row")
    rows = rows.unionByName(known.join(several, "doc_id", "left_anti").select(F.col("doc_id").alias("_id"), F.struct(*docs.columns).alias("_row")))
    rows = written(rows, "near-numbered")
    kept = only(spark, lambda: near_duplicates(rows.select(F.col("_id").alias("doc_id"), F.col("_row.text").alias("text")), threshold)
                .where("kept").select(F.col("doc_id").alias("_id")), "near-kept")
    return rows.join(kept, "_id", "left_semi").select("_row.*").unionByName(docs.where("doc_id is null"))


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
