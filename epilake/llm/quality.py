"""Importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Features of a text are its token unigrams, token bigrams and bigrams of token
shapes (capitals, digits, punctuation, length), hashed into BUCKETS; tokens are
runs of letters and digits or of punctuation, folded; a token that repeats the
one before is one feature whatever the token. Both models are the smoothed
bucket frequencies over all documents (raw) and over all documents labelled as
target; counts of a task are combined before they leave it. A text's log weight
is the sum over its features of log p_target - log p_raw. With Gumbel noise
seeded by a hash of the doc_id added, the k highest keys are a sample without
replacement with probabilities in proportion to the weights.

k is a share of the documents, by default that of target rows among the labelled
ones. The top k are taken by a distributed rank, not by a sort in one task.

Edge cases: a null or empty text has log weight 0. Ties go to the smaller doc_id
(nulls last), then to the row with the larger hash of the text; equal rows to
either. Rows that repeat a doc_id share their noise. Labels that disagree count
as target if half of them do. Without labels or target rows the weights are 0
and, k being unknown, every document is kept. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilake.llm import text as T
from epilake.llm.tables import lookup, ranked, read_table

BUCKETS = 1 << 16
SMOOTH = 1.0
SEED = 29
_REPEAT = np.uint64(0x7265706561742121)


def _shapes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, span) -> tuple[np.ndarray]:
    """A small number for capitals, digits, punctuation and length."""
    first, last = b[starts], b[ends - 1]
    upper = lambda x: (x >= 65) & (x <= 90)
    kind = np.where(T.PUNCT[first], 3, np.where((first >= 48) & (first <= 57), 4, upper(first) + (upper(first) & upper(last))))
    size = np.minimum(np.ceil(np.log2(ends - starts + 1)), 6)
    return ((kind * 8 + size).astype(np.uint64),)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the texts, and the text that each belongs to."""
    h, counts, more = T.words(texts, T.TOKENS, latin=True, also=_shapes)
    owner = np.repeat(np.arange(len(texts)), counts)
    if not len(h):
        return np.empty(0, np.int64), owner
    shape = more[0]
    same_text = owner[1:] == owner[:-1]
    with np.errstate(over="ignore"):
        pair = np.where(h[1:] == h[:-1], _REPEAT, T.mix(h[:-1] * np.uint64(3) ^ h[1:]))[same_text]
        form = T.mix((shape[:-1] * np.uint64(64) + shape[1:])[same_text] + np.uint64(1 << 32))
    bits = np.uint64(64 - BUCKETS.bit_length() + 1)
    bucket = (np.concatenate((T.mix(h), T.mix(pair), form)) >> bits).astype(np.int64)
    second = owner[1:][same_text]
    return bucket, np.concatenate((owner, second, second))


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts, chosen = T.texts_of(batch["text"]), np.asarray(batch["target"].to_pylist(), bool)
        for a, b in T.groups(texts):
            bucket, owner = features(texts[a:b])
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[chosen[a:b][owner]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of every bucket; counts cover all rows. labels: doc_id, target (boolean)."""
    chosen = labels.where("target").select("doc_id", F.lit(True).alias("target"))
    rows = lookup(docs.select("doc_id", "text"), chosen, "doc_id", "quality-target")
    rows = rows.select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counted = rows.mapInArrow(_count_partition, "bucket long, raw long, target long")
    got = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # BUCKETS rows at most
    raw, target = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    at = np.asarray(got["bucket"])
    raw[at] += np.asarray(got["raw"])
    target[at] += np.asarray(got["target"])
    if target.sum() == SMOOTH * BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_features, log_weight, text_hash of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS doubles

    def run(batches):
        table = shared.value
        for batch in batches:
            texts = T.texts_of(batch["text"])
            for a, b in T.groups(texts):
                bucket, owner = features(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array(np.bincount(owner, minlength=b - a)),
                     pa.array(np.bincount(owner, weights=table[bucket], minlength=b - a).astype(np.float64)), batch["text_hash"].slice(a, b - a)],
                    ["doc_id", "n_features", "log_weight", "text_hash"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, n_features long, log_weight double, text_hash long")


def target_rows(labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id, target: one row for each labelled document."""
    return labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.avg(F.col(column).cast("double")) >= 0.5).alias("target"))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED) -> DataFrame:
    """The sampled documents: doc_id, n_features, log_weight, gumbel_key, rank (from 0). labels: doc_id, target."""
    if share is None:
        share = labels.agg(F.avg(F.col("target").cast("double"))).first()[0]
        share = 1.0 if not share else share
    rows = weigh(docs, log_ratios(docs, labels))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10)
    uniform = (bits.cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = rows.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    order = [F.col("gumbel_key").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash").desc()]
    rows = ranked(rows, order, "rank", "quality-ranked")
    total = docs.count()
    return rows.where(F.col("rank") < round(share * total)).select("doc_id", "n_features", "log_weight", "gumbel_key", "rank")


def op6_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), target_rows(read_table(spark, sf_dir, "labels")))
