"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters on doc_id.

`write_tokens` lays documents out in ascending doc_id order: split points of
doc_id give each task one range, sorted inside it, so that file k holds smaller
ids than file k + 1. Inside a file the ids of a document are one array<int>
value, which ORC stores run-length encoded in stripes. The stripe and row-index
minima and maxima and the Bloom filters of `doc_id` let a filtered read skip
stripes and row groups. A manifest keeps, for each file, the number of ids
before it; so positions in the whole stream need no second pass over the ids.

Edge cases: a null or empty text has the end id only. Equal doc_ids (and null
ones, which come first) are ordered by text, null first; rows that are equal in
both are all written. An empty table writes no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilake.llm.tables import fresh_path, partitions, prefix_sums, range_bucket, read_table, split_points

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Runs of letters whose ids a worker remembers; the older half is forgotten beyond it.
MEMO = 800_000
#: Bytes of texts that are encoded at once; a longer text is a group of its own.
GROUP = 1 << 23
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
               "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Memo(dict):
    """A dict of bounded size: when it is full, the older half of its entries is dropped."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def put(self, key, value):
        if len(self) >= self.limit:
            for k in list(islice(self, self.limit // 2 + 1)):
                del self[k]
        self[key] = value


class WordEncoder:
    """Ids of whole texts with the tokenizers library, a column at a time.

    For a tokenizer that drops white space and normalises inside pieces only (as
    this one: NFC, lower case, a split that never spans white space), the ids of a
    text are those of its pieces between ASCII white space, one after another.
    The distinct pieces of a column are coded once. A piece of Latin letters and
    ASCII punctuation behind them is split as the tokenizer's pattern does into two
    segments, so that its letters are encoded once for all spellings; any other piece
    is one segment that goes through the whole tokenizer. The ids of all pieces are then gathered
    from those of the distinct segments.
    """

    PLAIN = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\\[-`{-~]*)$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.whole = Tokenizer.from_file(path)
        self.letters = Memo(MEMO)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        chars = [chr(c) for c in [*range(33, 127), *range(0xC0, 0x100)]]
        self.bytes_of = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in chars})

    @staticmethod
    def pack(ids) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def runs(self, words: list[str]) -> list[bytes]:
        """Pre-tokenised words: merges of the model alone."""
        got = list(map(self.letters.get, words))
        for i, ids in enumerate(got):
            if ids is None:
                got[i] = self.pack([t.id for t in self.whole.model.tokenize(words[i].translate(self.bytes_of))])
                self.letters.put(words[i], got[i])
        return got

    def _segments(self, pieces: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """For each piece the numbers of its two segments, and the ids of all segments (0: none)."""
        split = pc.extract_regex(pieces, self.PLAIN)
        two = np.zeros((len(pieces), 2), np.int64)
        ids = [b""]
        plain = split.is_valid().to_numpy(zero_copy_only=False)
        for k, part in enumerate((pc.utf8_lower(pc.struct_field(split, "letters")), pc.struct_field(split, "marks"))):
            code = part.dictionary_encode()
            two[plain, k] = code.indices.drop_null().to_numpy() + len(ids)
            ids += self.runs(code.dictionary.to_pylist())
        other = pieces.filter(pa.array(~plain)).to_pylist()
        two[~plain, 0] = np.arange(len(other)) + len(ids)
        ids += [self.pack(self.whole.encode(p, add_special_tokens=False).ids) if p else b"" for p in other]
        return two, ids

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none null), each followed by `end` (packed ids), and their number for each text."""
        pieces = pc.ascii_split_whitespace(texts)
        code = pieces.flatten().dictionary_encode()
        two, ids = self._segments(code.dictionary)
        many = np.diff(np.asarray(pieces.offsets).astype(np.int64))
        # segments in order: two for each piece, and the end behind each text
        ids.append(end)
        at = 2 * np.cumsum(many)
        order = np.insert(two[code.indices.to_numpy()].ravel(), at, len(ids) - 1)
        sizes = np.array(list(map(len, ids)), np.int64) >> 2
        flat = np.frombuffer(b"".join(ids), "<u4")
        begin = np.cumsum(sizes) - sizes
        order = order[sizes[order] > 0]
        n = sizes[order]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = flat[np.repeat(begin[order] - (ends - n), n) + np.arange(total)] if total else np.empty(0, "<u4")
        sums = np.zeros(len(code.indices) + 1, np.int64)
        np.cumsum(sizes[two].sum(axis=1)[code.indices.to_numpy()], out=sums[1:])
        bounds = np.concatenate(([0], np.cumsum(many)))
        return out, sums[bounds[1:]] - sums[bounds[:-1]] + (len(end) >> 2)

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_column(pa.array([text.decode()]))[0].astype("<u4").tobytes()


def _text_groups(texts: pa.Array):
    """Ranges of consecutive texts of at most GROUP bytes, one text at least."""
    sizes = pc.binary_length(texts).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > GROUP:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _encode_partition(path: str, end_id: int):
    end = WordEncoder.pack([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(path), 0
        for batch in batches:
            texts = pc.fill_null(batch["text"].cast(pa.string()), "")
            for a, b in _text_groups(texts):
                flat, n = enc.encode_column(texts.slice(a, b - a), end)
                flat = flat.view("<i4")
                offsets = np.concatenate(([0], np.cumsum(n)))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["bucket"].slice(a, b - a), pa.array(before + offsets[:-1]),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))],
                    ["doc_id", "bucket", "offset", "ids"])
                before += int(offsets[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                 parts: int | None = None) -> None:
    """Writes `path`/ids (doc_id, bucket, offset, ids) and `path`/manifest."""
    spark = docs.sparkSession
    parts = parts or partitions(spark)
    points = split_points(docs, "doc_id", parts)
    laid = docs.select(F.col("doc_id").cast("long"), "text", range_bucket("doc_id", points).alias("bucket"))
    laid = laid.repartitionById(len(points) + 1, "bucket").sortWithinPartitions("doc_id", "text")
    ids = laid.mapInArrow(_encode_partition(tokenizer or tokenizer_path(), end_id),
                          "doc_id long, bucket int, offset long, ids array<int>")
    ids.write.options(**ORC_OPTIONS).orc(f"{path}/ids")
    sizes = spark.read.orc(f"{path}/ids").select("bucket", "doc_id", (F.col("offset") + F.size("ids")).alias("end"))
    per = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_docs"), F.max("end").alias("n_ids"),
                                      F.min("doc_id").alias("min_doc_id"), F.max("doc_id").alias("max_doc_id"))
    prefix_sums(per, "bucket", "n_ids", "ids_before").coalesce(1).write.options(**ORC_OPTIONS | {
        "orc.bloom.filter.columns": ""}).orc(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document in the whole stream), ids. A filter on doc_id reaches the
    stripe statistics and Bloom filters."""
    files = spark.read.schema("bucket int, ids_before long").orc(f"{path}/manifest")  # one row for each file
    ids = spark.read.schema("doc_id long, bucket int, offset long, ids array<int>").orc(f"{path}/ids")
    got = ids.join(F.broadcast(files), "bucket")
    return got.select("doc_id", (F.col("ids_before") + F.col("offset")).alias("start"), "ids")


def _crc_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"]
        flat, at = np.asarray(ids.values, "<i4"), np.asarray(ids.offsets)
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["start"], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows of `read_tokens`."""
    return tokens.mapInArrow(_crc_partition, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_and_digest(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path)
    return digests(read_tokens(spark, path))


def op1_token_orc(spark, sf_dir: str) -> DataFrame:
    return tokenize_and_digest(read_table(spark, sf_dir, "documents"))
