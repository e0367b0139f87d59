"""Removal of repeated passages by compaction of a de Bruijn graph of words.

A window of WINDOW words is an edge between its first and its last WINDOW - 1 words.
A word that an edge covers goes if the edge also starts in a document with a smaller
doc_id. Edges are neither shipped nor joined one by one:

1. `super_edges`: a run of consecutive edges of a document whose smallest SEED-word
   hash is the same is one row, keyed by that hash (its bucket) and a hash of all its
   words. Equal edges fall into the same bucket wherever they are. Only buckets that
   occur in two documents live on.
2. Super edges of equal key are one, with its first occurrence (by doc_id) as source.
   `links` joins each with its only successor over all occurrences, where that has it as its only
   predecessor; linked ones are compacted into non-branching paths. The end of a
   document or of the live part ends a path, so a path occurs as a whole or not at all.
3. Where a bucket holds several super edges (a branch), parts of them may be equal. The
   edges of each are hashed at its source and meet in the bucket, sorted by source, in a
   stream; each takes the source of the first equal one. Runs of edges whose sources
   follow one another are the pieces of a super edge. Buckets of more than HOT_BUCKET
   super edges are resolved edge by edge in an aggregate instead, which combines before
   the shuffle.
4. Occurrences of a path's head are joined with its pieces. At the document's text each
   occurrence is verified against the words at the source's coordinates (a 160-bit
   digest taken there); then the words of pieces with a smaller source go.

Edge cases: a null text has no words. Rows with a null doc_id keep all words and take
none from others. Rows that share a doc_id are judged one by one, against smaller
doc_ids only, so repeated rows keep or lose the same words. A document of fewer than
WINDOW words has no edge. Very long texts are rows like others; a text that repeats one
word is one super edge. An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epilake.llm import text as T
from epilake.llm.tables import BROADCAST_BYTES, lookup, partitions, read_table, written

WINDOW = 50
SEED = 12
#: Super edges of a bucket that are resolved in one stream.
HOT_BUCKET = 20_000
_BASE, _INVERSE = T._BASE, T._INVERSE

EDGE_SCHEMA = "doc_id long, at long, n long, key binary"


def text_key(text: bytes) -> int:
    """31 bits that tell rows of one doc_id apart; in front of a word number they make a coordinate (`at`)."""
    return zlib.crc32(text) >> 1


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if width > have else x


def _spans(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words begin .. end - 1 of the word hashes h."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * T._powers(_BASE, len(h))[:len(h)], out=sums[1:])
        return T.mix((sums[end] - sums[begin]) * T._powers(_INVERSE, len(sums))[begin] + (end - begin).astype(np.uint64))


def _runs_of(h: np.ndarray, counts: np.ndarray, window: int, seed: int):
    """Super edges of a group of texts: text, first word, number of edges, bucket, hash of the words."""
    seeds, many = T.grams(h, counts, seed, whole=False)
    edges = np.maximum(counts - window + 1, 0)
    total = int(edges.sum())
    if not total:
        return None
    owner = np.repeat(np.arange(len(counts)), edges)
    first = np.arange(total) - np.repeat(np.cumsum(edges) - edges, edges)  # word of the text
    least = _least(seeds, window - seed + 1)[(np.cumsum(many) - many)[owner] + first]
    new = np.ones(total, bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, total))
    words = (np.cumsum(counts) - counts)[owner[at]] + first[at]
    return owner[at], first[at], n, least[at], _spans(h, words, words + n + window - 1)


def _edge_partition(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = T.texts_of(batch["text"]), np.asarray(batch["doc_id"])
            for a, b in T.groups(texts):
                h, counts, _ = T.words(texts[a:b], fold=False)
                got = _runs_of(h, counts, window, seed)
                if got is None:
                    continue
                owner, first, n, bucket, words = got
                keys = np.array([text_key(t) for t in texts[a:b]], np.int64)
                raw = np.stack([bucket, words], axis=1).astype("<u8").tobytes()
                key = pa.Array.from_buffers(pa.binary(16), len(n), [None, pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][owner]), pa.array(keys[owner] << 32 | first), pa.array(n), key],
                                                 ["doc_id", "at", "n", "key"])

    return run


def super_edges(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, at (text key and first word), n (edges), key (bucket and hash of the words)."""
    return docs.where("doc_id is not null and text is not null").mapInArrow(_edge_partition(window, seed), EDGE_SCHEMA)


def bucket() -> Column:
    return F.substring("key", 1, 8)


def live_edges(edges: DataFrame) -> DataFrame:
    """Super edges of buckets that occur in two documents, with the key of the next and the last one of their
    document (null: none there that lives)."""
    edges = edges.withColumn("bucket", bucket())
    shared = edges.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("bucket")
    live = lookup(edges, shared, "bucket", "substrings-buckets", how="left_semi")
    order = Window.partitionBy("doc_id", F.shiftright("at", 32)).orderBy("at")
    # repeated rows of a document repeat its super edges
    live = live.groupBy("doc_id", "at", "n", "key", "bucket").count().drop("count")
    end, begin = F.col("at") + F.col("n"), F.lag(F.col("at") + F.col("n")).over(order)
    return live.withColumns({"next": F.when(F.lead("at").over(order) == end, F.lead("key").over(order)),
                             "last": F.when(begin == F.col("at"), F.lag("key").over(order))})


def distinct_edges(live: DataFrame) -> DataFrame:
    """key, n, source (src_doc, src_at), only successor and predecessor (null: none, or several), bucket, m
    (distinct super edges of the bucket)."""
    def only(c):
        return F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c))

    got = live.groupBy("key").agg(F.min(F.struct("doc_id", "at")).alias("src"), F.min("n").alias("n"), only("next").alias("next"), only("last").alias("last"))
    got = got.select("key", F.col("src.doc_id").alias("src_doc"), F.col("src.at").alias("src_at"), "n", "next", "last", bucket().alias("bucket"))
    got = written(got, "substrings-distinct")
    several = got.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    got = lookup(got, several.withColumn("w", F.col("m")), "bucket", "substrings-branches", weight="w")
    return written(got.withColumn("m", F.coalesce("m", F.lit(1))), "substrings-nodes")


def links(nodes: DataFrame) -> DataFrame:
    """Keys whose only predecessor has them as its only successor."""
    after = nodes.where("next is not null").select(F.col("key").alias("last"), F.col("next").alias("key"))
    return nodes.where("last is not null").select("key", "last").join(after, ["key", "last"], "left_semi").select("key")


def paths(nodes: DataFrame) -> DataFrame:
    """nodes with `path` (the key of its first super edge) and `off` (edges of the path before it).

    A path's super edges follow each other at their sources too, as they all occur together.
    """
    linked = links(nodes).withColumn("linked", F.lit(True))
    order = Window.partitionBy("src_doc", F.shiftright("src_at", 32)).orderBy("src_at")
    rows = nodes.join(linked, "key", "left").withColumn("head", F.when(F.col("linked").isNull(), F.struct("key", "src_at")))
    rows = rows.withColumn("head", F.last("head", ignorenulls=True).over(order))
    return rows.select(*nodes.columns, F.col("head.key").alias("path"), (F.col("src_at") - F.col("head.src_at")).alias("off"))


WINDOW_SCHEMA = "path binary, digest binary, size long, key binary, bucket binary, m long, src_doc long, src_at long, edges array<bigint>"


def _source_partition(window: int):
    """Digests of paths and edge hashes of the branching super edges, from the texts of their sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, asked in zip(batch["doc_id"], T.texts_of(batch["text"]), batch["asked"]):
                mine = text_key(text)
                asked = [r for r in asked.as_py() if r["at"] >> 32 == mine]
                if not asked:
                    continue
                words = text.split()
                h, counts, _ = T.words([text], fold=False)
                edges, _ = T.grams(h, counts, window, whole=False)
                edges = edges.view(np.int64)
                rows = []
                for r in asked:
                    begin = r["at"] & 0xFFFFFFFF
                    rows.append((r["path"], _digest(words[begin:begin + r["size"] + window - 1]), r["size"], None, None, None, None, None, None))
                    for e in r["branches"]:
                        at = e["at"] & 0xFFFFFFFF
                        rows.append((r["path"], None, None, e["key"], e["bucket"], e["m"], doc_id.as_py(), e["at"], edges[at:at + e["n"]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(),
                                                                 pa.int64(), pa.list_(pa.int64())))],
                    ["path", "digest", "size", "key", "bucket", "m", "src_doc", "src_at", "edges"])

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=20).digest()


def sources(nodes: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """What `_source_partition` finds, written; a text is read once for all that it is the source of."""
    branch = F.when(F.col("m") > 1, F.struct("key", "bucket", "m", F.col("src_at").alias("at"), "n"))
    asked = nodes.groupBy("src_doc", "path").agg(F.min("src_at").alias("at"), F.sum("n").alias("size"), F.collect_list(branch).alias("branches"))
    asked = asked.groupBy(F.col("src_doc").alias("doc_id")).agg(F.collect_list(F.struct("path", "at", "size", "branches")).alias("asked"))
    rows = _with_texts(docs, asked, "substrings-asked", "inner")
    return written(rows.select("doc_id", "text", "asked").mapInArrow(_source_partition(window), WINDOW_SCHEMA), "substrings-sources")


def _with_texts(docs: DataFrame, rows: DataFrame, name: str, how: str) -> DataFrame:
    """Documents joined with `rows` (one for each doc_id that it has). If the ids of `rows` fit a broadcast, texts
    of other documents are not shuffled."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(rows, name)
    ids = rows.select("doc_id")
    if ids.count() * 24 > BROADCAST_BYTES:
        return docs.join(rows, "doc_id", how)
    hit = docs.join(F.broadcast(ids), "doc_id", "left_semi").join(rows, "doc_id")
    if how == "inner":
        return hit
    rest = docs.join(F.broadcast(ids), "doc_id", "left_anti")
    missing = {c: F.lit(None).cast(rows.schema[c].dataType) for c in rows.columns if c != "doc_id"}
    return hit.unionByName(rest.withColumns(missing))


PIECES = "array<struct<off:bigint,n:bigint,doc:bigint,at:bigint>>"
_PIECES = pa.list_(pa.struct([(c, pa.int64()) for c in ("off", "n", "doc", "at")]))


def _pieces(docs: np.ndarray, ats: np.ndarray) -> list[dict]:
    """Runs of edges whose sources follow one another."""
    cut = np.ones(len(docs), bool)
    cut[1:] = (docs[1:] != docs[:-1]) | (ats[1:] != ats[:-1] + 1)
    begin = np.flatnonzero(cut)
    size = np.diff(np.append(begin, len(docs)))
    return [dict(off=int(o), n=int(n), doc=int(docs[o]), at=int(ats[o])) for o, n in zip(begin, size)]


def _bucket_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Super edges in order of bucket and source: the first row with an edge is its source."""
    now, seen, before = None, {}, None
    for batch in batches:
        keys, out = [], []
        for bucket, key, doc, at, edges in zip(*(batch[c] for c in ("bucket", "key", "src_doc", "src_at", "edges"))):
            bucket, key, doc, at = bucket.as_py(), key.as_py(), doc.as_py(), at.as_py()
            if bucket != now:
                now, seen = bucket, {}
            if key == before:  # a repeated row of the source
                continue
            before = key
            own = edges.values.to_numpy().tolist()
            got = [seen.setdefault(e, (doc, at + i)) for i, e in enumerate(own)]
            keys.append(key)
            found = np.array(got, np.int64)
            out.append(_pieces(found[:, 0], found[:, 1]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, _PIECES)], ["key", "pieces"])


def _run_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for found in batch["found"]:
            rows = sorted((r["i"], r["doc"], r["at"]) for r in found.as_py())
            got = np.array(rows, np.int64)
            out.append(_pieces(got[:, 1], got[:, 2]))
        yield pa.RecordBatch.from_arrays([batch["key"], pa.array(out, _PIECES)], ["key", "pieces"])


def branch_pieces(branches: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """key, pieces of the super edges of branching buckets."""
    spark = branches.sparkSession
    some = branches.where(F.col("m") <= hot).repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "src_doc", "src_at", "key")
    some = some.select("bucket", "key", "src_doc", "src_at", "edges").mapInArrow(_bucket_partition, f"key binary, pieces {PIECES}")
    many = branches.where(F.col("m") > hot)
    if not many.head(1):
        return some
    many = many.select("key", "src_doc", "src_at", F.posexplode("edges").alias("i", "e")).distinct()
    many = written(many.select("key", "i", F.struct(F.col("src_doc").alias("doc"), (F.col("src_at") + F.col("i")).alias("at")).alias("src"),
                               F.struct(F.substring("key", 1, 8).alias("b"), "e").alias("edge")), "substrings-hot")
    first = many.groupBy("edge").agg(F.min("src").alias("first"), F.count(F.lit(1)).alias("n"))
    found = lookup(many.select("key", "i", "edge"), first, "edge", "substrings-hot-first", how="inner", weight="n")
    found = found.groupBy("key").agg(F.collect_list(F.struct("i", "first.doc", "first.at")).alias("found"))
    return some.unionByName(found.mapInArrow(_run_partition, f"key binary, pieces {PIECES}"))


def occurrences(live: DataFrame, nodes: DataFrame, found: DataFrame, hot: int) -> DataFrame:
    """doc_id, spans: the path occurrences of a document that have a piece with a smaller source."""
    digests = found.where("digest is not null").groupBy("path").agg(F.min("digest").alias("digest"), F.min("size").alias("size"))
    some = branch_pieces(found.where("key is not null"), hot)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("off"), "n", F.col("src_doc").alias("doc"), F.col("src_at").alias("at")))
    pieces = nodes.where("m = 1").select("key", "path", "off", whole.alias("pieces")).unionByName(
        nodes.where("m > 1").select("key", "path", "off").join(some, "key"))
    # a path is part of one document, its source, so its pieces fit a row
    shifted = F.transform("pieces", lambda p: F.struct((p["off"] + F.col("off")).alias("off"), p["n"].alias("n"), p["doc"].alias("doc"), p["at"].alias("at")))
    by_path = pieces.groupBy("path").agg(F.flatten(F.collect_list(shifted)).alias("pieces"))
    by_path = by_path.join(digests, "path")
    heads = live.select("doc_id", "at", F.col("key").alias("path"))
    uses = heads.groupBy("path").agg(F.count(F.lit(1)).alias("uses"))
    got = lookup(heads, by_path.join(uses, "path"), "path", "substrings-paths", how="inner", weight="uses", limit=0)
    got = got.withColumn("pieces", F.filter("pieces", lambda p: p["doc"] < F.col("doc_id"))).where(F.size("pieces") > 0)
    cut = F.transform("pieces", lambda p: F.struct(p["off"].alias("off"), p["n"].alias("n")))
    return got.groupBy("doc_id").agg(F.collect_list(F.struct("at", "size", "digest", cut.alias("pieces"))).alias("spans"))


OUT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _remove_partition(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(T.texts_of(batch["text"]), batch["spans"]):
                words = text.split()
                gone = 0
                if spans.is_valid:
                    mine, keep = text_key(text), np.ones(len(words), bool)
                    for span in spans.as_py():
                        if span["at"] >> 32 != mine:
                            continue
                        begin = span["at"] & 0xFFFFFFFF
                        if _digest(words[begin:begin + span["size"] + window - 1]) != span["digest"]:
                            continue  # not the words of the source
                        for p in span["pieces"]:
                            keep[begin + p["off"]:begin + p["off"] + p["n"] + window - 1] = False
                    kept = [words[i] for i in np.flatnonzero(keep)]
                    gone = len(words) - len(kept)
                else:
                    kept = words
                rows.append((len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, gone, sha = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot: int = HOT_BUCKET) -> DataFrame:
    """doc_id, spans (at, size, digest, pieces of off and n): what repeats smaller documents."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    edges = written(super_edges(docs, window, seed), "substrings-edges")
    live = written(live_edges(edges), "substrings-live")
    nodes = written(paths(distinct_edges(live)), "substrings-paths-of")
    return occurrences(live, nodes, sources(nodes, docs, window), hot)


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot: int = HOT_BUCKET) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows = _with_texts(docs, repeated_spans(docs, window, seed, hot), "substrings-spans", "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(_remove_partition(window), OUT_SCHEMA)


def op11_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
