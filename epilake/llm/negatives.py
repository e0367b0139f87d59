"""Hard negatives by Four-Russians scoring of vectors.

A component x counts as the integer floor(256 * x). A candidate's integers are
cut into bit planes (two's complement, as many as the largest one takes), and the
bits of eight dimensions of a plane are packed into a byte. For each anchor and
each group of eight dimensions a table holds the sum of the anchor's integers over
each of the 256 subsets of the group. A byte of a candidate looks up its subset's
sum for a tile of anchors at once; sums of all groups are added and shifted plane by
plane, the top plane counting negatively. What comes out is the exact inner product.

Two passes, each over all rows against all anchors (rows whose vec_id is divisible
by ANCHOR_STEP) in blocks of ANCHOR_BLOCK anchors, which is all that the driver
holds and broadcasts at once: one finds the positives of each anchor, one the
negatives in the score window of each positive. A task keeps the best rows of each
anchor in running lists, so its memory and output do not grow with its rows, and
nothing is left out: a row is passed over only if enough better ones are in the list.

Edge cases: rows with a null vec_id, label, vector or component, or a component that
is not finite, take no part. Vectors of unequal length are filled up with zeros (and
equal if they differ in zeros at the end only); an empty one scores 0. Scores tie by smaller vec_id. Rows that are equal in all
columns count once, and rows of one vec_id, label and score too; a row with its
anchor's vec_id and label is not its positive. An anchor without positives gives no row.
Integers so large that scores could exceed 63 bits are an error. An empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epilake.llm.tables import read_table, written

SCALE = 256
ANCHOR_STEP = 100
N_POSITIVES = N_NEGATIVES = 5
#: Percent of a positive's score that a negative's has to reach.
MARGIN = 80
#: Anchors of a pass over the candidates (their integers are broadcast).
ANCHOR_BLOCK = 65_536
#: Anchors whose tables exist at a time, candidates that meet these, and candidates scored at once.
TILE, CHUNK, STEP = 256, 8192, 512
#: Rows of a candidate task at least, where there are more tasks than cores.
TASK_ROWS = 20_000
GROUP = 8


def _integers(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each vector whether it is whole and finite, and the integers of those that are."""
    ok = np.zeros(len(column), bool)
    out = []
    for i, v in enumerate(column):
        if not v.is_valid:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
        x = np.floor(SCALE * x)
        if np.isfinite(x).all():
            ok[i] = True
            out.append(x)
    return ok, out


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """vec_id, label and integers (as doubles, filled up with zeros) of the rows that take part."""
    column, keys = batch["embedding"], [batch["vec_id"], batch["label"]]
    flat = column.flatten()
    sizes = set(np.diff(np.asarray(column.offsets)).tolist()) if len(column) else set()
    if not column.null_count and not flat.null_count and len(sizes) == 1:
        width = sizes.pop()
        x = np.floor(SCALE * flat.to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), width)
        ok = np.isfinite(x).all(axis=1)
        x = x[ok]
    else:
        ok, vectors = _integers(column)
        x = np.zeros((len(vectors), max(map(len, vectors), default=0)))
        for i, v in enumerate(vectors):
            x[i, :len(v)] = v
    mask = pa.array(ok)
    return (*(np.asarray(k.filter(mask).cast(pa.int64())) for k in keys), x)


def _stats_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = width = most = 0
    for batch in batches:
        ids, _, x = _rows(batch)
        n, width = n + len(ids), max(width, x.shape[1])
        most = max(most, float(np.abs(x).max(initial=0)))
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([width], pa.int64()), pa.array([float(most)], pa.float64())], ["n", "width", "most"])


def _anchor_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, x = _rows(batch)
        # without the zeros at the end, so that equal vectors stay equal wherever they were filled up
        x = [np.trim_zeros(v, "b") for v in x.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array(x, pa.list_(pa.int64()))], ["vec_id", "label", "q"])


def bit_planes(x: np.ndarray, planes: int, width: int) -> np.ndarray:
    """planes x rows x groups bytes, the top plane first; width: dimensions, filled up to whole groups."""
    full = np.zeros((len(x), -(-width // GROUP) * GROUP), np.int64)
    full[:, :x.shape[1]] = x
    return np.stack([np.packbits((full >> k) & 1, axis=1) for k in range(planes - 1, -1, -1)]) if len(x) else np.empty((planes, 0, full.shape[1] // GROUP), np.uint8)


def subset_sums(anchors: np.ndarray, kind) -> np.ndarray:
    """groups x 256 x anchors: sums of the anchors' integers over each subset of a group's dimensions."""
    n, width = anchors.shape
    by_group = np.ascontiguousarray(anchors.reshape(n, width // GROUP, GROUP).transpose(1, 2, 0)).astype(kind)
    out = np.zeros((width // GROUP, 1 << GROUP, n), kind)
    for d in range(GROUP):  # the first dimension is the highest bit, as packbits has it
        have = 1 << d
        out[:, have:2 * have] = out[:, :have] + by_group[:, GROUP - 1 - d][:, None, :]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """rows x anchors: exact inner products by lookups, shifted and added from the top plane down."""
    total = np.zeros((planes.shape[1], tables.shape[2]), tables.dtype)
    part = np.empty_like(total)
    for k, plane in enumerate(planes):
        if k:
            total <<= 1
        for g in range(tables.shape[0]):
            np.take(tables[g], plane[:, g], axis=0, out=part, mode="clip")
            total += part
        if k == 0:
            np.negative(total, out=total)
    return total


class _Best:
    """The `keep` highest scores of each list, ties by smaller id, of all that were added; equal (id, score) once."""

    def __init__(self, lists: int, keep: int):
        self.keep = keep
        self.at, self.score, self.ids = (np.empty(0, np.int64) for _ in range(3))
        #: A score must be at least this to come into a full list.
        self.least = np.full(lists, np.iinfo(np.int64).min)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        touched = np.zeros(len(self.least), bool)
        touched[at] = True
        old = touched[self.at]
        a, s, i = (np.concatenate(p) for p in ((self.at[old], at), (self.score[old], score), (self.ids[old], ids)))
        order = np.lexsort((i, -s, a))
        a, s, i = a[order], s[order], i[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        a, s, i = a[first], s[first], i[first]
        begin = np.searchsorted(a, a)
        rank = np.arange(len(a)) - begin
        top = rank < self.keep
        last = rank == self.keep - 1
        self.least[a[last]] = s[last]
        self.at, self.score, self.ids = (np.concatenate(p) for p in (
            (self.at[~old], a[top]), (self.score[~old], s[top]), (self.ids[~old], i[top])))


class _Scored:
    """All rows of a task against all anchors of a block, a tile and a step at a time."""

    def __init__(self, block: dict, batches):
        self.block, self.batches = block, batches

    def chunks(self):
        held, size = [], 0
        for batch in self.batches:
            rows = _rows(batch)
            if len(rows[0]):
                held.append(rows)
                size += len(rows[0])
            if size >= CHUNK:
                yield held
                held, size = [], 0
        if held:
            yield held

    def __iter__(self):
        """(first anchor of the tile, ids, labels, rows x anchors scores)"""
        b = self.block
        for held in self.chunks():
            ids, labels = (np.concatenate([h[c] for h in held]) for c in (0, 1))
            labels = np.where(ids % 7 == 0, np.fmod(labels + 1, 10), labels) if b["relabel"] else labels
            planes = np.concatenate([bit_planes(h[2].astype(np.int64), b["planes"], b["width"]) for h in held], axis=1)
            for a in range(0, len(b["q"]), TILE):
                tables = subset_sums(b["q"][a:a + TILE], b["kind"])
                for i in range(0, len(ids), STEP):
                    yield a, ids[i:i + STEP], labels[i:i + STEP], scores(tables, planes[:, i:i + STEP])


def _out(nos, best: _Best, per: int):
    return pa.RecordBatch.from_arrays([pa.array(nos[best.at // per]), pa.array(best.at % per), pa.array(best.score), pa.array(best.ids)],
                                      ["no", "p", "score", "vec_id"])


BEST_SCHEMA = "no long, p long, score long, vec_id long"


def _positive_partition(shared, keep: int):
    def run(batches):
        block = shared.value
        best = _Best(len(block["q"]), keep)
        for a, ids, labels, s in _Scored(block, batches):
            tile = slice(a, a + s.shape[1])
            hit = (labels[:, None] == block["label"][tile]) & (s >= best.least[tile])
            i, j = np.nonzero(hit)
            other = ids[i] != block["vec_id"][a + j]
            i, j = i[other], j[other]
            best.add(a + j, s[i, j].astype(np.int64), ids[i])
        yield _out(block["no"], best, 1)

    return run


def _negative_partition(shared, keep: int, margin: int):
    def run(batches):
        block = shared.value
        goal = block["positives"]  # anchors x positives, -1 where there is none; a negative score has no window
        per = goal.shape[1]
        low = -(-margin * goal // 100)
        best = _Best(goal.size, keep)
        most = goal.max(axis=1)
        for a, ids, labels, s in _Scored(block, batches):
            tile = slice(a, a + s.shape[1])
            least = np.maximum(low[tile], best.least.reshape(goal.shape)[tile])
            floor = np.where(goal[tile] >= 0, least, np.iinfo(np.int64).max).min(axis=1)
            i, j = np.nonzero((s >= floor) & (s <= most[tile]) & (labels[:, None] != block["label"][tile]))
            for p in range(per):
                v = s[i, j].astype(np.int64)
                ok = (goal[a + j, p] >= 0) & (v >= least[j, p]) & (v <= goal[a + j, p])
                best.add((a + j[ok]) * per + p, v[ok], ids[i[ok]])
        yield _out(block["no"], best, per)

    return run


def _ranked(rows: DataFrame, keep: int) -> DataFrame:
    """The best `keep` of each anchor (and positive) over all tasks; a task gives `keep` at most."""
    w = Window.partitionBy("no", "p").orderBy(F.desc("score"), "vec_id")
    return rows.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def _planes(most: int) -> int:
    """Bits of two's complement that hold -most .. most."""
    return max(2, int(most).bit_length() + 1)


def hard_negatives(rows: DataFrame, relabel: bool = False, anchor_step: int = ANCHOR_STEP, n_positives: int = N_POSITIVES,
                   n_negatives: int = N_NEGATIVES, margin: int = MARGIN, block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, embedding, label. relabel: rows whose vec_id is divisible by 7 take label (label + 1) % 10.
    """
    spark = rows.sparkSession
    rows = rows.where("vec_id is not null and label is not null and embedding is not null")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                       F.col("label").cast("long").alias("label"))
    stats = rows.mapInArrow(_stats_partition, "n long, width long, most double").agg(F.sum("n"), F.max("width"), F.max("most")).first()
    n, width, most = stats[0] or 0, stats[1] or 0, stats[2] or 0.0
    width = max(GROUP, -(-width // GROUP) * GROUP)
    if width * (most + 1) ** 2 * 2 >= 2 ** 62:
        raise ValueError(f"inner products of {width} components up to {most:g} do not fit a long")
    kind = np.int32 if width * (most + 1) ** 2 * 4 < 2 ** 31 else np.int64
    candidates = rows.coalesce(max(spark.sparkContext.defaultParallelism, math.ceil(n / TASK_ROWS)))

    anchors = rows.where(F.col("vec_id") % anchor_step == 0).mapInArrow(_anchor_partition, "vec_id long, label long, q array<bigint>").distinct()
    if relabel:
        anchors = anchors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    anchors = written(anchors.withColumn("no", F.monotonically_increasing_id()), "negatives-anchors")
    blocks = math.ceil(anchors.count() / block)
    in_block = F.pmod(F.xxhash64("no"), F.lit(blocks)) if blocks else F.lit(0)

    def shared(k: int, more: DataFrame | None = None):
        """The anchors of block k, broadcast."""
        got = anchors.where(in_block == k)
        got = (got.join(more, "no") if more is not None else got).toArrow()
        q = np.zeros((got.num_rows, width), np.int64)
        for i, v in enumerate(got["q"]):
            q[i, :len(v.values)] = v.values.to_numpy()
        value = {"q": q, "planes": _planes(int(most)), "width": width, "kind": kind, "relabel": relabel,
                 **{c: got[c].to_numpy() for c in ("no", "vec_id", "label")}}
        if more is not None:
            value["positives"] = np.full((got.num_rows, n_positives), -1, np.int64)
            for i, v in enumerate(got["scores"]):
                value["positives"][i, :len(v.values)] = v.values.to_numpy()
        return spark.sparkContext.broadcast(value)

    def passes(name, run, keep, more=None):
        """One pass over the candidates for each block of anchors."""
        out = None
        for k in range(blocks):
            value = shared(k, more)
            if not len(value.value["no"]):
                continue
            got = written(_ranked(candidates.mapInArrow(run(value), BEST_SCHEMA), keep), name)
            value.destroy()
            out = got if out is None else out.unionByName(got)
        return out if out is not None else spark.createDataFrame([], f"{BEST_SCHEMA}, rank int")

    positives = passes("negatives-positives", lambda v: _positive_partition(v, n_positives), n_positives)
    positives = positives.select("no", (F.col("rank") - 1).cast("long").alias("p"), F.col("vec_id").alias("positive_id"),
                                 F.col("score").alias("positive_score"))
    # in order of rank; at most n_positives
    goals = positives.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("p", "positive_score"))).alias("s"))
    goals = goals.select("no", F.col("s.positive_score").alias("scores"))
    found = passes("negatives-found", lambda v: _negative_partition(v, n_negatives, margin), n_negatives, goals)
    found = found.join(positives, ["no", "p"]).join(anchors.select("no", F.col("vec_id").alias("anchor_id")), "no")
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(read_table(spark, sf_dir, "embeddings"), relabel=True)
