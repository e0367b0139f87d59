"""SimHash fingerprints, likeness, and search by permuted block tables.

A document's terms are its windows of TERM words (a shorter document: all its
words as one), each weighted by its number of occurrences; a word is a run of
[^\\x20\\x09-\\x0D], A-Z folded. The hash of a term votes, with its weight, on
every signed bit; the fingerprint has a 1 where the sum is positive. A text
without words has all bits 0.

Likeness of fingerprints that differ in d of b bits is cos(pi d / b), 0 at least:
the share of differing bits estimates the angle between the term vectors, so
this estimates their cosine; unrelated texts come out near 0, equal ones at 1.

Search: the bits are cut into blocks; for a radius r and any choice of `blocks -
r` blocks, two fingerprints within r agree on all bits of one choice at least.
Each choice is a table whose key is the fingerprint permuted to have these
blocks in front, cut behind them. Rows that meet under a table's key are then
compared on all bits. So every pair within the radius is found.

Edge cases: a null text is empty. `with_next` orders by doc_id (nulls first),
then text; the row behind the last is the first. In a table of one row the
next document is that row. Rows that are equal in all read columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilake.llm import text as T
from epilake.llm.tables import partitions, range_bucket, read_table, split_points

BITS = 128
TERM = 3


def _sums(h: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """Signed votes of each text's terms: 2 * (ones) - (terms) for each bit.

    Hash bytes are counted by value, then each value's count is added to the bits
    that it sets: one count for a byte instead of eight additions.
    """
    ones = np.zeros((len(counts), bits), np.int64)
    if not len(h):
        return ones
    with np.errstate(over="ignore"):
        lanes = np.stack([T.mix(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
                          for k in range(bits // 64)], axis=1)
    raw = lanes.view(np.uint8).reshape(len(h), bits // 8)
    table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
    at = np.cumsum(counts) - counts
    lane = (np.arange(bits // 8) * 256).astype(np.int32)
    for i, (a, n) in enumerate(zip(at, counts)):
        if n == 0:
            continue
        if n <= 256:
            ones[i] = np.unpackbits(raw[a:a + n], axis=1).sum(axis=0, dtype=np.int64)
        else:
            seen = np.zeros(bits // 8 * 256, np.int64)
            for b in range(a, a + n, 1 << 16):
                seen += np.bincount((raw[b:min(b + (1 << 16), a + n)] + lane).ravel(), minlength=len(seen))
            ones[i] = (seen.reshape(bits // 8, 256) @ table).ravel()
    return 2 * ones - counts[:, None]


def fingerprints(texts: list[bytes], bits: int = BITS, term: int = TERM) -> np.ndarray:
    """Packed fingerprints: len(texts) x bits / 8 bytes."""
    out = np.zeros((len(texts), bits // 8), np.uint8)
    for a, b in T.groups(texts):
        h, counts, _ = T.words(texts[a:b])
        g, many = T.grams(h, counts, term, whole=True)
        out[a:b] = np.packbits(_sums(g, many, bits) > 0, axis=1)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of packed fingerprints, row by row."""
    bits = x.shape[1] * 8
    d = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return np.where(d == 0, 1.0, np.maximum(0.0, np.cos(np.pi * d / bits)))


def _hex(prints: np.ndarray) -> list[str]:
    return [p.tobytes().hex() for p in prints]


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text, bucket, real: ranges of doc_id, one a partition and sorted; each range also holds the
    first rows of the next one (real = false), so that every row's successor stands behind it."""
    parts = parts or partitions(docs.sparkSession)
    points = split_points(docs, "doc_id", parts)
    first = docs.agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))).first()[0]
    last = len(points)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = base.withColumn("bucket", range_bucket("doc_id", points))
    if first is None:
        return rows.withColumns({"real": F.lit(True), "wrap": F.lit(0)})
    begins = F.col("doc_id").eqNullSafe(F.lit(first[1]).cast("long"))
    # a range begins with the rows of its split point, which is a value of the column
    follow = F.array_compact(F.array(
        F.when(F.col("doc_id").isin(points), F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(False).alias("real"), F.lit(0).alias("wrap")))
        if points else F.lit(None).cast("struct<bucket:int,real:boolean,wrap:int>"),
        F.when(begins, F.struct(F.lit(last).alias("bucket"), F.lit(False).alias("real"), F.lit(1).alias("wrap"))),
        F.struct("bucket", F.lit(True).alias("real"), F.lit(0).alias("wrap"))))
    rows = rows.select("doc_id", "text", F.explode(follow).alias("_f")).select("doc_id", "text", "_f.*")
    return (rows.repartitionById(last + 1, "bucket")
            .sortWithinPartitions("wrap", "doc_id", F.col("real").desc(), "text"))


def _edit_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with their successor; a row is ready when the next one is seen."""
    held = None  # doc_id, text and fingerprint of the row that waits for the next one

    def ready(pairs):
        mine, after = [x[1] for x, _ in pairs], [y[1] for _, y in pairs]
        chars, edited = [], []
        for t, nxt in zip(mine, after):
            s = t.decode()
            k = len(s) // 2
            chars.append(len(s))
            # the first k characters of the next text take 4 k bytes at most
            edited.append((s[:len(s) - k] + nxt[:4 * k].decode(errors="ignore")[:k]).encode() if k else t)
        own, nxt = np.stack([x[2] for x, _ in pairs]), np.stack([y[2] for _, y in pairs])
        new = fingerprints(edited)
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x, _ in pairs], pa.int64()), pa.array(chars, pa.int64()),
             pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(_hex(own)), pa.array(_hex(new)),
             pa.array(likeness(own, new)), pa.array(likeness(own, nxt))], EDIT_NAMES)

    for batch in batches:
        texts = T.texts_of(batch["text"])
        ids, real = batch["doc_id"].to_pylist(), batch["real"].to_pylist()
        for a, b in T.groups(texts):
            pairs = []
            for row in zip(ids[a:b], texts[a:b], fingerprints(texts[a:b]), real[a:b]):
                if held is not None:
                    pairs.append((held, row))
                held = row if row[3] else None
            if pairs:
                yield ready(pairs)


EDIT_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
EDIT_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")


def edited_likeness(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document."""
    return with_next(docs, parts).mapInArrow(_edit_partition, EDIT_SCHEMA)


def _print_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = fingerprints(T.texts_of(batch["text"]))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(_hex(prints))], ["doc_id", "fingerprint"])


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) of every text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_print_partition, "doc_id long, fingerprint string")


def _table_keys(blocks: int, radius: int, bits: int):
    """Explodes fingerprints into the keys of the permuted tables: one for each choice of blocks - radius blocks."""
    cuts = [bits * k // blocks for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = np.zeros(bits, np.uint8)
        for c in chosen:
            m[cuts[c]:cuts[c + 1]] = 1
        masks.append(np.packbits(m))

    def run(batches):
        for batch in batches:
            prints = np.frombuffer(bytes.fromhex("".join(batch["fingerprint"].to_pylist())), np.uint8).reshape(-1, bits // 8)
            for t, m in enumerate(masks):
                lanes = (prints & m).view(np.uint64)
                key = T.mix(np.full(len(prints), t + 1, np.uint64))
                for k in range(lanes.shape[1]):
                    key = T.mix(key ^ lanes[:, k])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch["fingerprint"]], ["key", "fingerprint"])

    return run


def hamming(x: Column, y: Column, bits: int = BITS) -> Column:
    """Differing bits of two hexadecimal fingerprints."""
    out = F.lit(0)
    for k in range(0, bits // 4, 8):
        part = lambda c, k=k: F.conv(F.substring(c, k + 1, 8), 16, 10).cast("long")
        out = out + F.bit_count(part(x).bitwiseXOR(part(y)))
    return out


def search(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 5, bits: int = BITS) -> DataFrame:
    """query_id, doc_id, distance of all fingerprints within `radius` of a query's.

    Both sides are reduced to distinct fingerprints before the tables are joined,
    and widened to documents after the compare; so a group of equal texts costs
    one row in each table.
    """
    values = prints.select("fingerprint").distinct()
    asked = queries.select("fingerprint").distinct()
    keys = "key long, fingerprint string"
    left = asked.mapInArrow(_table_keys(blocks, radius, bits), keys).withColumnRenamed("fingerprint", "_q")
    right = values.mapInArrow(_table_keys(blocks, radius, bits), keys)
    near = left.join(right, "key").where(hamming(F.col("_q"), F.col("fingerprint"), bits) <= radius)
    near = near.select("_q", "fingerprint").distinct()
    near = near.withColumn("distance", hamming(F.col("_q"), F.col("fingerprint"), bits))
    ids = queries.select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("_q"))
    return (near.join(ids, "_q").join(prints.select("doc_id", "fingerprint"), "fingerprint")
            .select("query_id", "doc_id", "distance"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(read_table(spark, sf_dir, "documents"))
