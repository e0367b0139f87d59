"""Mixing sources to target weights, with DataFrame operations only.

Tokens are aggregated per source; each source's target share gives a repetition
rate; every document is emitted floor(rate) times, and once more if a uniform
hash of its id and the seed is below the fraction.

Edge cases: a null source is a source of its own, last in order. Null or empty
texts have size 0 and are emitted like the others, taking no words. Rows that
repeat a doc_id (or a null one) share one draw. Empty tables give empty results.
Columns of the input are never joined by name, so extra ones may have any name
but those that the result adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilake.llm.tables import lookup, ranked, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 17


def _key(source: Column) -> Column:
    """A join key without nulls."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """Uniform in [0, 1): the first 52 bits of md5("seed:doc_id")."""
    bits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return F.conv(bits, 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(key, source_size, n_docs, target) of (key, size) rows; key "n" is the null source.

    Water filling: with the sources above their cap held at it, the rest share
    what remains by weight; repeated until none is above. Each round is one
    aggregate over the written table of sources.
    """
    per = sizes.groupBy("_key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = ranked(per, [F.col("source").asc_nulls_last()], "_rank", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    per = per.select("_key", "source_size", "n_docs", weight.cast("long").alias("_w"),
                     (F.col("source_size") * max_repeat).alias("_cap"))
    total, all_w = per.agg(F.sum("source_size"), F.sum("_w")).first()
    total, level, held = total or 0, 0.0, -1
    if total:
        level = total / all_w
        while True:  # a round that holds no further source ends it
            above = F.col("_cap") < F.lit(level) * F.col("_w")
            n, caps, w = per.where(above).agg(F.count(F.lit(1)), F.sum("_cap"), F.sum("_w")).first()
            if n == held or n == 0:
                break
            held, level = n, (total - caps) / (all_w - w)
    share = F.lit(level) * F.col("_w")
    return per.select("_key", "source_size", "n_docs",
                      F.when(F.col("_cap") < share, F.col("_cap").cast("double")).otherwise(share).alias("target"))


def with_copies(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies and the columns named in `keep`."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _key(F.col("source")).alias("_key"), *keep)
    small = written(sized.select("doc_id", "source", "size", "_key"), "mix-sizes")
    targets = source_targets(small, weights, max_repeat)
    out = lookup(sized if keep else small, targets, "_key", "mix-targets", how="inner", weight="n_docs")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = draw(F.col("doc_id"), seed) < rate - F.floor(rate)
    copies = F.floor(rate).cast("int") + F.when(extra, 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), *keep)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every row of `docs` as often as its copies say, all its columns kept."""
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))
    got = with_copies(packed, keep=("_row",), **how)
    return got.where("copies > 0").select(F.explode(F.array_repeat("_row", F.col("copies"))).alias("_row")).select("_row.*")


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    from epilake.llm.tables import read_table
    got = with_copies(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                      "copies")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s),
p AS (
  SELECT a.source, (SELECT sum(source_size) FROM w) AS total,
         coalesce(sum(b.cap) FILTER (WHERE b.cap * a.weight < a.cap * b.weight), 0) AS held,
         sum(b.weight) FILTER (WHERE b.cap * a.weight >= a.cap * b.weight) AS free
  FROM w a, w b GROUP BY a.source),
l AS (SELECT max((total - held)::DOUBLE / free::DOUBLE) AS level FROM p),
t AS (
  SELECT source, source_size,
         CASE WHEN cap < level * weight THEN cap::DOUBLE ELSE level * weight END AS target
  FROM w, l),
r AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::INTEGER + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken,
       (floor(rate)::INTEGER + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies
FROM r
"""
