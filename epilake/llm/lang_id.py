"""Language identification with interpolated Kneser-Ney character models.

One model of ORDER characters per language. Counts of the highest order cover
every training text whole; lower orders use continuation counts (the number of
different characters seen in front), as Kneser-Ney does, and follow from the
distinct higher ones. With discount D_k of order k,

    p(c | ctx) = max(n(ctx c) - D_k, 0) / n(ctx .) + D_k N(ctx .) / n(ctx .) p(c | shorter ctx)

down to a uniform distribution over the characters seen. Characters are
case-folded letters; a run of anything else is one space, and a text is scored
between two spaces. An n-gram is packed into 12 bits a character (code points
from 3,840 on share 256 codes), so suffix and prefix are shifts.

Storage: for each order the packed n-grams, hashed by a bijection and sorted, with
one row of log probabilities for all languages; and the contexts with their log
back-off weights. A lookup is an index by the leading bits and a short scan. The
arrays are collected only within MODEL_ROWS rows (about 24 bytes and 4 for each
language a row), which bounds the broadcast. A larger model is cut into blocks by the
two characters in front of the last, so that what an n-gram needs of the orders from
3 on lies in its block; counts of the orders 1 and 2 and the discounts of all orders
are aggregated over the whole count table and go with every block. Each block scores
its own n-grams of all texts, and the sums are added. No n-gram or language is cut.

Decision: the language of the lowest cross-entropy per character. A calibration
slice (1 in CALIBRATE of the training texts, left out of the counts) fits a
temperature that turns cross-entropies into a probability, and for each language
the median of the uncapped cross-entropy, its variance within and between texts, and an
upper bound in deviations at the text's length. These are medians and a 0.9 quantile over
all calibration texts, so a few odd or wrongly labelled ones don't move them. A text
above the bound in its best language is rejected, as is one without letters.

Edge cases: null, empty and letterless texts get `und`, score 0 and are rejected.
A tie goes to the language first in order. Repeated rows count as often as they
occur. Without training text every prediction is `und`. A language whose texts all
fall into the calibration slice is learned from them. A language with fewer
than LEAST_TEXTS calibration texts has the widest bound of all. Rows without lang are not
learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilake.llm import text as T
from epilake.llm.tables import read_table, written

ORDER = 5
BITS = 12
MODEL_ROWS = 8_000_000
CALIBRATE = 16
#: A rejected text lies so many robust deviations above the median of its language.
REACH = 6.0
#: Calibration texts that a language's own bound takes.
LEAST_TEXTS = 20
#: Median of the square, and 0.9 quantile, of a normal variable.
SQUARE_MEDIAN, NORMAL_90 = 0.4549, 1.2816
TEMPERATURES = np.exp(np.linspace(np.log(0.02), np.log(20), 60))
#: Most that one character adds to a text's cross-entropy, so that a short foreign passage doesn't decide a text; rejection sees all.
LOSS_CAP = 5.0
UND = "und"
_MASK = (1 << BITS) - 1


def _code_table() -> np.ndarray:
    """Code of each code point: folded letters below 3,840 themselves, others in 256 shared codes, non-letters 32."""
    out = np.full(0x110000, 32, np.uint16)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            v = ord(low) if len(low) == 1 else c
            out[c] = v if v < 3840 else 3840 + (v * 2654435761 >> 7) % 256
    return out


_CODES: list[np.ndarray] = []


def codes_of(text: str) -> np.ndarray:
    """Codes of a text between two spaces, runs of non-letters as one space; empty if it has no letter."""
    if not _CODES:
        _CODES.append(_code_table())
    c = _CODES[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    space = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    c = c[keep]
    if not len(c) or (len(c) == 1 and c[0] == 32):
        return np.empty(0, np.uint64)
    return np.concatenate(([32] if c[0] != 32 else [], c, [32] if c[-1] != 32 else [])).astype(np.uint64)


def ngrams(c: np.ndarray, order: int = ORDER) -> np.ndarray:
    """One packed n-gram for each character behind the first, which is padded in front by spaces."""
    c = np.concatenate((np.full(order - 2, 32, np.uint64), c))
    n = len(c) - order + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(order):
        out = (out << np.uint64(BITS)) | c[k:k + n]
    return out


def _count_partition(order: int):
    """(lang, gram, n): counts of a partition, combined before they leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        loose: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def pack(lang):
            if loose.get(lang):
                held.setdefault(lang, []).append(np.unique(np.concatenate(loose.pop(lang)), return_counts=True))
                sizes[lang] = 0
            if len(held.get(lang, ())) > 8:
                merge(lang)

        def merge(lang):
            keys, n = (np.concatenate(x) for x in zip(*held[lang]))
            uniq, at = np.unique(keys, return_inverse=True)
            held[lang] = [(uniq, np.bincount(at, weights=n).astype(np.int64))]

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                c = codes_of(text or "")
                if len(c):
                    loose.setdefault(lang, []).append(ngrams(c, order))
                    sizes[lang] = sizes.get(lang, 0) + len(c)
                    if sizes[lang] > 1 << 20:
                        pack(lang)
        for lang in sorted({*held, *loose}):
            pack(lang)
            merge(lang)
            keys, n = held[lang][0]
            for a in range(0, len(keys), 1 << 16):
                k = keys[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(n[a:a + (1 << 16)], pa.int64())],
                                                 ["lang", "gram", "n"])

    return run


def counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all rows (lang, text)."""
    part = labelled.select("lang", "text").mapInArrow(_count_partition(order), "lang string, gram long, n long")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Table:
    """Rows by packed n-gram: sorted hashes, an index of their leading bits, and values; a row of zeros at the end."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        h = T.mix(grams.astype(np.uint64))
        order = np.argsort(h)
        self.hashes = np.append(h[order], np.uint64(0))
        self.values = np.concatenate((values[order], np.zeros((1, values.shape[1]), values.dtype)))
        self.shift = np.uint64(64 - max(1, int(np.ceil(np.log2(max(2, len(h))))) + 1))
        lead = (h[order] >> self.shift).astype(np.int64)
        self.first = np.searchsorted(lead, np.arange((1 << 64 - int(self.shift)) + 1)).astype(np.int32)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Row of each n-gram; that of the zeros if it is not there."""
        h = T.mix(grams)
        lead = (h >> self.shift).astype(np.int32)
        row = self.first[lead]
        open_ = np.flatnonzero(self.hashes[row] != h)
        end = self.first[lead[open_] + 1]
        while len(open_):
            row[open_] += 1
            more = row[open_] < end
            row[open_[~more]] = len(self.hashes) - 1
            open_, end = open_[more], end[more]
            miss = self.hashes[row[open_]] != h[open_]
            open_, end = open_[miss], end[miss]
        return row


@dataclass
class Model:
    langs: list[str]
    grams: list[Table]       # by order, from 1: log probabilities
    contexts: list[Table]    # by length of the context, from 0: log back-off weights
    floor: float             # log of the uniform distribution
    temperature: float = 1.0
    bounds: dict = field(default_factory=dict)  # lang: (median, variance between texts, variance of a character, deviations)

    def losses(self, g: np.ndarray) -> np.ndarray:
        """Negative log probabilities of highest-order n-grams, by n-gram and language."""
        top = self.grams[-1]
        row = top.find(g)
        out = -top.values[row]
        rest = np.flatnonzero(row == len(top.values) - 1)
        grams = g[rest]
        for k in range(len(self.grams), 0, -1):
            if not len(rest):
                return out
            if k < len(self.grams):
                table = self.grams[k - 1]
                grams = grams & np.uint64((1 << BITS * k) - 1)
                row = table.find(grams)
                out[rest] -= table.values[row]
                missed = row == len(table.values) - 1
                rest, grams = rest[missed], grams[missed]
            back = self.contexts[k - 1]
            out[rest] -= back.values[back.find(grams >> np.uint64(BITS))]
        out[rest] -= np.float32(self.floor)
        return out


def _lookup_rows(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of each wanted key in sorted keys, -1 if it is not there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


def _discount(n: np.ndarray) -> float:
    return _discount_of(int((n == 1).sum()), int((n == 2).sum()))


def _discount_of(ones: int, twos: int) -> float:
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5


def build_model(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int = ORDER,
                low: dict | None = None, discounts: dict | None = None) -> Model:
    """Kneser-Ney tables of all languages from highest-order counts; gram is packed, lang a number.

    For a block of a model: `low` has (lang, gram, n) of the orders that the block holds in part, `discounts` those by (order, lang).
    """
    per = {k: {} for k in range(1, order + 1)}  # order: language: (sorted grams, counts)
    for j in range(len(langs)):
        g, m = gram[lang == j].astype(np.uint64), n[lang == j].astype(np.float64)
        by = np.argsort(g)
        g, m = g[by], m[by]
        per[order][j] = (g, m)
        for k in range(order - 1, 0, -1):
            g, m = np.unique(g & np.uint64((1 << BITS * k) - 1), return_counts=True)
            per[k][j] = (g, m.astype(np.float64))
    for k, (low_lang, low_gram, low_n) in (low or {}).items():
        for j in range(len(langs)):
            own = np.flatnonzero(low_lang == j)
            own = own[np.argsort(low_gram[own])]
            per[k][j] = (low_gram[own].astype(np.uint64), low_n[own].astype(np.float64))
    vocabulary = np.unique(np.concatenate([per[1][j][0] for j in per[1]]))
    floor = -np.log(len(vocabulary) + 1)
    tables, contexts = [], []
    below, below_logp = None, None  # union of the order below and its probabilities
    for k in range(1, order + 1):
        union = np.unique(np.concatenate([per[k][j][0] for j in per[k]]))
        ctx = np.unique(union >> np.uint64(BITS))
        probs = np.empty((len(union), len(langs)))
        back = np.zeros((len(ctx), len(langs)))
        which = np.searchsorted(ctx, union >> np.uint64(BITS))
        if k == 1:
            lower = np.full(probs.shape, np.exp(floor))
        else:
            # a suffix of a highest-order n-gram is in the order below by construction
            lower = np.exp(below_logp[_lookup_rows(below, union & np.uint64((1 << BITS * (k - 1)) - 1))])
        for j in range(len(langs)):
            g, m = per[k][j]
            d = _discount(m) if discounts is None else discounts[k, j]
            c = np.searchsorted(ctx, g >> np.uint64(BITS))
            total = np.bincount(c, weights=m, minlength=len(ctx))
            kinds = np.bincount(c, minlength=len(ctx))
            weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            own = np.zeros(len(union))
            own[np.searchsorted(union, g)] = np.maximum(m - d, 0) / total[c]
            probs[:, j] = own + weight[which] * lower[:, j]
            back[:, j] = np.log(weight)
        logp = np.log(probs)
        tables.append(Table(union, logp.astype(np.float32)))
        contexts.append(Table(ctx, back.astype(np.float32)))
        below, below_logp = union, logp
    return Model(langs, tables, contexts, floor)


def _pair(gram):
    """The two characters in front of the last, of numpy n-grams."""
    return (gram >> np.uint64(BITS)) & np.uint64((1 << 2 * BITS) - 1)


@dataclass
class Blocks:
    """A model beyond the broadcast bound: counts in a written table, of which one block at a time is collected and built."""

    langs: list[str]
    table: DataFrame         # lang (number), gram, n
    cuts: list[int]          # first pair of each block but the first
    low: dict                # order: (lang, gram, n) of the orders 1 and 2, whole
    discounts: dict          # (order, lang): discount
    order: int
    temperature: float = 1.0
    bounds: dict = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.cuts) + 1

    def block(self, b: int) -> Model:
        pair = F.shiftrightunsigned("gram", BITS).bitwiseAND(F.lit((1 << 2 * BITS) - 1))
        rows = self.table
        if b:
            rows = rows.where(pair >= self.cuts[b - 1])
        if b < len(self.cuts):
            rows = rows.where(pair < self.cuts[b])
        return build_model(self.langs, *_arrays(rows), order=self.order, low=self.low, discounts=self.discounts)

    @property
    def grams(self) -> list[Table]:
        """Tables of the first block."""
        return self.block(0).grams


def _arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = rows.select("lang", "gram", "n").toArrow()
    return np.asarray(got["lang"]), np.asarray(got["gram"]).view(np.uint64), np.asarray(got["n"])


def _cut(table: DataFrame, langs: list[str], order: int, model_rows: int) -> Blocks:
    """Blocks of at most model_rows rows, or one pair; continuation counts and discounts of every order over the whole table."""
    low, discounts, level = {}, {}, table
    for k in range(order, 0, -1):
        if k < order:
            level = level.select("lang", F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("gram"))
            level = written(level.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), f"lang-order{k}")
        seen = {r.lang: (r.ones, r.twos) for r in level.groupBy("lang").agg(
            F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()}
        discounts |= {(k, j): _discount_of(*seen[j]) for j in range(len(langs))}
        if k <= 2:
            low[k] = _arrays(level)
    pair = F.shiftrightunsigned("gram", BITS).bitwiseAND(F.lit((1 << 2 * BITS) - 1))
    sizes = table.groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("k")).toArrow().sort_by("pair")
    cuts, held = [], 0
    for p, k in zip(sizes["pair"].to_pylist(), sizes["k"].to_pylist()):
        if held and held + k > model_rows:
            cuts.append(p)
            held = 0
        held += k
    return Blocks(langs, table, cuts, low, discounts, order)


def _block_sums(rows: DataFrame, model: Blocks) -> DataFrame:
    """(_at, sums, raws, squares, size): losses of every text of rows (_at, _text), added over the blocks in their order."""
    spark, cuts, order = rows.sparkSession, np.asarray(model.cuts, np.uint64), model.order
    schema = "_at long, block int, sums array<double>, raws array<double>, squares array<double>, size long"
    parts = None
    for b in range(len(model)):
        shared = spark.sparkContext.broadcast(model.block(b))

        def run(batches, shared=shared, b=b):
            mine = lambda g: np.searchsorted(cuts, _pair(g), "right") == b
            for batch in batches:
                mean, raw, square, size = cross_entropies(shared.value, batch["_text"].to_pylist(), squared=True, mine=mine)
                n = np.maximum(size, 1)[:, None]
                wide = [pa.array(list(x * n), pa.list_(pa.float64())) for x in (mean, raw, square)]
                yield pa.RecordBatch.from_arrays([batch["_at"], pa.array([b] * len(size), pa.int32()), *wide, pa.array(size)],
                                                 ["_at", "block", "sums", "raws", "squares", "size"])

        part = rows.select("_at", "_text").mapInArrow(run, schema)
        parts = part if parts is None else parts.unionByName(part)
    got = parts.groupBy("_at").agg(F.sort_array(F.collect_list(F.struct("block", "sums", "raws", "squares"))).alias("p"), F.max("size").alias("size"))
    places = F.sequence(F.lit(0), F.lit(len(model.langs) - 1))

    def total(name):
        return F.transform(places, lambda j: F.aggregate("p", F.lit(0.0), lambda acc, x: acc + F.get(x[name], j))).alias(name)

    return got.select("_at", total("sums"), total("raws"), total("squares"), "size")


def _wide(column) -> np.ndarray:
    return np.stack(column.to_pylist()) if len(column) else np.empty((0, 0))


def cross_entropies(model: Model, texts: list[str | None], squared: bool = False, mine=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean capped loss, mean loss and mean squared loss of a character, by text and language, and numbers of characters.

    Long texts are scored in pieces of n-grams, so memory does not follow their scores. With `mine`, only the n-grams
    that it chooses add to the sums; the numbers are still those of all characters.
    """
    sums = np.zeros((len(texts), len(model.langs)))
    raws = np.zeros((len(texts), len(model.langs)))
    squares = np.zeros((len(texts), len(model.langs)))
    size = np.zeros(len(texts), np.int64)
    parts: list[np.ndarray] = []
    owner: list[int] = []

    def flush():
        at = np.cumsum([0] + [len(p) for p in parts[:-1]])
        loss = model.losses(np.concatenate(parts))
        np.add.at(sums, owner, np.add.reduceat(np.minimum(loss, np.float32(LOSS_CAP)), at, axis=0, dtype=np.float64))
        np.add.at(raws, owner, np.add.reduceat(loss, at, axis=0, dtype=np.float64))
        if squared:
            np.add.at(squares, owner, np.add.reduceat(loss ** 2, at, axis=0, dtype=np.float64))
        parts.clear()
        owner.clear()

    held = 0
    for i, text in enumerate(texts):
        c = codes_of(text or "")
        g = ngrams(c, len(model.grams)) if len(c) else c
        size[i] = len(g)
        for a in range(0, len(g), 1 << 16):
            piece = g[a:a + (1 << 16)]
            if mine is not None:
                piece = piece[mine(piece)]
                if not len(piece):
                    continue
            parts.append(piece)
            owner.append(i)
            held += len(piece)
            if held >= 1 << 16:
                flush()
                held = 0
    if parts:
        flush()
    n = np.maximum(size, 1)[:, None]
    return sums / n, raws / n, squares / n, size


def decide(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy and whether the text is rejected."""
    if model is None:
        n = len(texts)
        return [UND] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
    mean, raw, _, size = cross_entropies(model, texts)
    return judge(model, mean, raw, size)


def judge(model: Model | Blocks, mean: np.ndarray, raw: np.ndarray, size: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """decide() from mean capped and uncapped losses by text and language."""
    if not len(size):
        return [], np.zeros(0), np.zeros(0), np.zeros(0, bool)
    best = mean.argmin(axis=1)
    z = -mean * np.sqrt(size)[:, None] / model.temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    score = z[np.arange(len(z)), best] / z.sum(axis=1)
    lowest = mean[np.arange(len(mean)), best]
    langs, reject = [], np.zeros(len(size), bool)
    for i, b in enumerate(best):
        if not size[i]:
            langs.append(UND)
            score[i], reject[i] = 0.0, True
            continue
        lang = model.langs[b]
        langs.append(lang)
        if lang in model.bounds:
            centre, between, spread, limit = model.bounds[lang]
            reject[i] = raw[i, b] > centre + limit * np.sqrt(between + spread / size[i])
    return langs, score, lowest, reject


def train(labelled: DataFrame, order: int = ORDER, calibrate: int = CALIBRATE, model_rows: int = MODEL_ROWS) -> Model | Blocks | None:
    """Model of rows (doc_id, text, lang) with non-null lang."""
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null").select("doc_id", "text", "lang")
    slice_ = F.coalesce(F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(calibrate)) == 0, F.lit(False))
    lonely = [r.lang for r in rows.groupBy("lang").agg(F.bool_and(slice_).alias("all")).where("all").collect()]
    if lonely:  # languages that would not be learned
        slice_ = slice_ & ~F.col("lang").isin(lonely)
    table = written(counts(rows.where(~slice_), order), "lang-counts")
    langs = [r.lang for r in table.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    number = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int") - 1
    numbered = table.select(number.alias("lang"), "gram", "n")
    if table.count() > model_rows and order > 2:
        model = _cut(numbered, langs, order, model_rows)
    else:
        model = build_model(langs, *_arrays(numbered), order=order)
    _calibrate(spark, model, rows.where(slice_))
    return model


CALIBRATION_SCHEMA = "true long, loss double, square double, size long, grid array<double>"


def _calibration_batch(true: np.ndarray, mean: np.ndarray, raw: np.ndarray, square: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Losses of each text in its own language, and a row (true = -1) of the log losses at all temperatures."""
    at = np.arange(len(true))
    scores = -mean * np.sqrt(size)[:, None]
    scores -= scores.max(axis=1, keepdims=True)
    grid = [float((np.log(np.exp(scores / t).sum(axis=1)) - scores[at, true] / t).sum()) for t in TEMPERATURES]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.append(true, -1)), pa.array(np.append(raw[at, true], 0.0)), pa.array(np.append(square[at, true], 0.0)),
         pa.array(np.append(size, 0)), pa.array([None] * len(true) + [grid], pa.list_(pa.float64()))], ["true", "loss", "square", "size", "grid"])


def _calibrate(spark: SparkSession, model: Model | Blocks, rows: DataFrame) -> None:
    """Fits temperature and bounds on all calibration texts.

    Tasks score their own texts; a few numbers for each language reach the driver.
    """
    if isinstance(model, Blocks):
        number = F.array_position(F.array(*[F.lit(x) for x in model.langs]), F.col("lang")) - 1
        texts = written(rows.select(number.alias("true"), F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_at")), "lang-calibration")

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    size = np.asarray(batch["size"])
                    yield _calibration_batch(np.asarray(batch["true"]), *(_wide(batch[c]) / size[:, None] for c in ("sums", "raws", "squares")), size)

        scored = texts.select("_at", "true").join(_block_sums(texts, model), "_at").where((F.col("size") > 0) & (F.col("true") >= 0))
        scored = scored.mapInArrow(run, CALIBRATION_SCHEMA)
    else:
        shared = spark.sparkContext.broadcast(model)

        def run(batches):
            m = shared.value
            place = {x: i for i, x in enumerate(m.langs)}
            for batch in batches:
                mean, raw, square, size = cross_entropies(m, batch["text"].to_pylist(), squared=True)
                true = np.array([place.get(x, -1) for x in batch["lang"].to_pylist()], np.int64)
                ok = (size > 0) & (true >= 0)
                if ok.any():
                    yield _calibration_batch(true[ok], mean[ok], raw[ok], square[ok], size[ok])

        scored = rows.select("lang", "text").mapInArrow(run, CALIBRATION_SCHEMA)
    scored = written(scored, "lang-calibration-scores")
    grid = scored.where(F.col("true") < 0).select(F.posexplode("grid")).groupBy("pos").agg(F.sum("col").alias("x")).collect()
    if not grid:
        return
    model.temperature = float(TEMPERATURES[min(grid, key=lambda r: (r.x, r.pos)).pos])
    _fit_bounds(model, scored.where(F.col("true") >= 0))


def _fit_bounds(model: Model | Blocks, scored: DataFrame) -> None:
    """Bounds from (true, loss, square, size) by medians and quantiles over all rows of a language."""
    j = F.col("true").cast("int") + 1

    def of(stats: dict, k: int) -> Column:
        return F.element_at(F.array(*[F.lit(float(stats[i][k]) if i in stats else 0.0) for i in range(len(model.langs))]), j)

    within = F.greatest(F.col("square") - F.col("loss") ** 2, F.lit(1e-9))
    stats = {r.true: (r.centre, r.spread, r.n) for r in scored.groupBy("true").agg(
        F.percentile_approx("loss", 0.5).alias("centre"), F.percentile_approx(within, 0.5).alias("spread"), F.count(F.lit(1)).alias("n")).collect()}
    above, chance = F.col("loss") - of(stats, 0), of(stats, 1) / F.col("size")
    between = {r.true: (max(0.0, r.b),) for r in scored.groupBy("true").agg(
        F.percentile_approx(above ** 2 / SQUARE_MEDIAN - chance, 0.5).alias("b")).collect()}
    z = above / F.sqrt(of(between, 0) + chance)
    bounds = {}
    for r in scored.groupBy("true").agg(F.percentile_approx(z, [0.5, 0.9]).alias("q")).collect():
        limit = r.q[0] + REACH * max(1.0, (r.q[1] - r.q[0]) / NORMAL_90)
        bounds[r.true] = (stats[r.true][0], between[r.true][0], stats[r.true][1], limit)
    widest = tuple(max(b[k] for b in bounds.values()) for k in range(4))
    for i, lang in enumerate(model.langs):
        model.bounds[lang] = bounds[i] if i in bounds and stats[i][2] >= LEAST_TEXTS else widest


PREDICT_SCHEMA = "lang_pred string, score double, cross_entropy double, rejected boolean"


def _judge_sums(keep: tuple[str, ...], langs: list[str], temperature: float, bounds: dict):
    model = Blocks(langs, None, [], {}, {}, 0, temperature, bounds)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                size = np.asarray(batch["size"])
                n = np.maximum(size, 1)[:, None]
                out = judge(model, _wide(batch["sums"]) / n, _wide(batch["raws"]) / n, size)
                yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), pa.array(out[0], pa.string()), *map(pa.array, out[1:])],
                                                 [*keep, "lang_pred", "score", "cross_entropy", "rejected"])

    return run


def predict(docs: DataFrame, model: Model | Blocks | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """lang_pred, score, cross_entropy and rejected of every text, beside the columns named in `keep` (a kept text
    goes to the tasks once)."""
    spark = docs.sparkSession
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    if isinstance(model, Blocks):
        # row numbers are only stable once written
        rest = [k for k in keep if k != "text"]
        rows = written(docs.select(*rest, F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_at")), "lang-texts")
        scored = rows.select("_at", *rest, *([F.col("_text").alias("text")] if "text" in keep else []))
        scored = scored.join(_block_sums(rows, model), "_at").drop("_at")
        return scored.mapInArrow(_judge_sums(keep, model.langs, model.temperature, model.bounds), f"{kept}, {PREDICT_SCHEMA}")
    shared = spark.sparkContext.broadcast(model)  # within MODEL_ROWS rows
    own = "text" if "text" in keep else "_text"

    def run(batches):
        m = shared.value
        for batch in batches:
            langs, score, lowest, reject = decide(m, batch[own].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch[k] for k in keep), pa.array(langs, pa.string()), pa.array(score, pa.float64()),
                 pa.array(lowest, pa.float64()), pa.array(reject, pa.bool_())],
                [*keep, "lang_pred", "score", "cross_entropy", "rejected"])

    rows = docs.select(*keep) if own in keep else docs.select(*keep, F.col("text").alias(own))
    return rows.mapInArrow(run, f"{kept}, {PREDICT_SCHEMA}")


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_lang_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where(~F.col("held_out")))
    return predict(docs, model, keep=("doc_id", "held_out"))
