"""Generic table operators taking column names.

Shape rules kept throughout:
* no unpartitioned window over a table that grows with the data --
  totals come from a scalar subquery, sequence numbers from per-partition
  counts plus offsets;
* "first row per key" is an aggregate (min of a struct), so a key holding
  a third of all rows is collapsed map-side before the shuffle;
* repetition and spines are generators (`explode(sequence(...))`), not
  cross joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ---------------------------------------------------------------- date spine
def date_spine(start: Column, end: Column, name: str = "date") -> Column:
    """Generator column: every day from start to end inclusive (empty if end < start)."""
    return F.explode(F.when(end >= start, F.sequence(start, end, F.expr("INTERVAL 1 DAY")))
                     .otherwise(F.array().cast("array<date>"))).alias(name)


# ------------------------------------------------------------ repeat rows
def repeat_rows(df: DataFrame, n_col: str, index_name: str = "slot") -> DataFrame:
    """Each row n times with index 1..n; n <= 0 or null gives no row
    (`sequence(1, 0)` would be [1, 0], hence the guard)."""
    n = F.col(n_col)
    seq = F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return df.select("*", F.explode(seq).alias(index_name))


def spread(df: DataFrame, key: str, n_rows: int, rows_per_task: int) -> DataFrame:
    """`df` dealt by `key` to as many tasks as its `n_rows` need, for rows that a generator or a join
    with a broadcast table multiplies: a small file is one task, however many rows it becomes. The number
    is explicit, so that AQE does not merge the tasks again by the size that the rows have here."""
    return df.repartition(max(1, -(-n_rows // rows_per_task)), key)


def spread_by_month(df: DataFrame, day: str, key: str, n_rows: int, days: DataFrame, rows_per_task: int) -> DataFrame:
    """`df` (of `n_rows` rows) dealt to tasks by the month of `day`, for a write by month: a month with more than
    `rows_per_task` rows goes to several tasks by the hash of `key`, short months that follow each other to one.

    days: a table whose rows fall into months as those of `df` do (its largest month sets the parts). The number of a
    task is found from month and key, so that no two large months meet in one by chance.
    """
    month = F.year(day) * 12 + F.month(day)
    counts = days.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    most, total, n_months = counts.agg(F.max("n"), F.sum("n"), F.count(F.lit(1))).first()
    if not most:
        return df
    most = max(1, -(-n_rows * most // total))
    parts = -(-most // rows_per_task)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    months = max(1, min(rows_per_task // most, n_months // tasks))
    n = -(-n_months // months) * parts
    at = F.floor(month / months) * parts + F.pmod(F.xxhash64(key), F.lit(parts))
    return df.repartitionById(n, F.coalesce(F.pmod(at, F.lit(n)), F.lit(0)).cast("int"))


# ------------------------------------------------------ trailing day windows
def day_range_window(partition: Sequence[str], date_col: str, lo: int, hi: int):
    """Range frame over whole days [d+lo, d+hi] within `partition`."""
    return (Window.partitionBy(*partition).orderBy(F.unix_date(F.col(date_col)))
            .rangeBetween(lo, hi))


# -------------------------------------------------------- first per key
def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the smallest by `order`, ties broken by the other columns.

    Aggregate form (min of a struct): partial aggregation collapses hot keys
    map-side, so no task receives all copies of one key.
    """
    order = list(order or [])
    rest = [c for c in df.columns if c not in keys and c not in order]
    fields = order + rest
    packed = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])
    agg = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return agg.select(*keys, *[F.col(f"_first.f{i}").alias(c) for i, c in enumerate(fields)]) \
        .select(*df.columns)


# ---------------------------------------------------------- sequence ids
def sequence_id(df: DataFrame, order: Sequence[str], name: str = "seq",
                num_partitions: int | None = None) -> DataFrame:
    """Dense 1..n numbering in `order` without a single-task window.

    Range-partition and sort by `order` (sampled bounds keep partitions even
    even when one value dominates, since `order` should be a total order),
    take the in-partition position from `monotonically_increasing_id`, then
    cut the lineage with a reliable checkpoint in the shared folder: range
    bounds are sampled, so two evaluations of an input whose row order is not
    fixed could place rows differently. Both the per-partition counts (one
    row per partition, broadcast as running offsets) and the numbered rows
    read that one checkpoint, so they always agree, and a lost executor
    re-reads it instead of re-sampling.
    """
    from epilake.session import ensure_work_dir
    ensure_work_dir(df.sparkSession)
    n = num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    n = int(n)
    s = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    s = (s.withColumn("_mid", mid)
         .withColumn("_pid", F.shiftright(F.col("_mid"), 33))
         .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
         .checkpoint(eager=True))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # offsets: one row per partition (n rows by construction)
    out = s.join(F.broadcast(offsets), "_pid", "inner")
    return out.select(*df.columns, (F.col("_off") + F.col("_pos") + 1).alias(name))


# -------------------------------------------------------------- sampling (K1)
def sample_key(key_cols: Sequence[str], seed: int) -> Column:
    """Deterministic pseudo-random sort key: md5 of 'k1:k2:...:seed'."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed))))


def sample_n(df: DataFrame, n: int, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """Fixed-size sample without replacement: the n rows with the smallest hash
    (top-k: each task keeps n rows, the merge keeps n). The hash is a column, found once a row; as a sort
    expression it would be found anew in every comparison."""
    hashed = df.withColumn("_sample_key", sample_key(key_cols, seed))
    return hashed.orderBy("_sample_key", *key_cols).limit(n).select(*df.columns)


# ---------------------------------------------------------- first rows of an order (K2)
#: Values of a column that the driver sees at once, and ranges that one pass counts.
CUT_VALUES, CUT_RANGES = 256, 32


def _before(c: str, value) -> Column:
    """col < value with nulls first."""
    return F.lit(False) if value is None else F.col(c).isNull() | (F.col(c) < F.lit(value))


def _value_at(counts: DataFrame, c: str, n: int, values: int):
    """The value of `c` at which the n-th row stands, its rows, and n within them; None if there are fewer rows.

    counts: the values with their rows `n`. While there are more than `values` of them, the ranges between some that
    are drawn by hash are counted, and the range that holds the n-th row is taken.
    """
    while len(found := counts.orderBy(F.asc_nulls_first(c)).limit(values + 1).collect()) > values:
        drawn = counts.where(F.col(c).isNotNull()).orderBy(F.md5(F.concat(F.col(c).cast("string"), F.lit(str(n)))), c).limit(min(values, CUT_RANGES))
        points = sorted(r[c] for r in drawn.collect())
        at = sum((F.when(F.col(c) > F.lit(p), 1).otherwise(0) for p in points), F.lit(0))
        for r in counts.groupBy(at.alias("at")).agg(F.sum("n").alias("n")).orderBy("at").collect():
            if n <= r["n"]:
                low = F.lit(True) if r["at"] == 0 else F.col(c) > F.lit(points[r["at"] - 1])
                high = F.lit(True) if r["at"] == len(points) else F.col(c).isNull() | (F.col(c) <= F.lit(points[r["at"]]))
                counts = counts.where(low & high)
                break
            n -= r["n"]
        else:
            return None
    for r in found:
        if n <= r["n"]:
            return r[c], r["n"], n
        n -= r["n"]
    return None


def first_rows(df: DataFrame, n: int, order: Sequence[str], ranges: int = CUT_VALUES) -> DataFrame:
    """The first n rows in `order` (nulls first), without sorting the table.

    The value at which the n-th row stands is found column by column. For each column the table is read once: the
    rows that are still in question are counted by value (a partial aggregate, checkpointed in the shared folder), and
    the cut is looked for in these counts, of which the driver sees at most `ranges` + 1 at a time. Then one filter
    keeps the rows in front of the cut. Rows that are equal in all of `order` at the cut are alike; as many of them as
    belong to the first n are kept.
    """
    from epilake.session import ensure_work_dir
    if n <= 0:
        return df.limit(0)
    ensure_work_dir(df.sparkSession)
    same, keep, left = F.lit(True), F.lit(False), n
    for c in order:
        counts = df.where(same).groupBy(c).agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
        cut = _value_at(counts, c, left, ranges)
        if cut is None:
            return df  # fewer than n rows
        value, count, left = cut
        keep = keep | (same & _before(c, value))
        same = same & F.col(c).eqNullSafe(F.lit(value))
        if left == count:
            return df.where(keep | same)
    return df.where(keep).unionByName(df.where(same).limit(left))


# ---------------------------------------------------------------- shares
def share_of_total(df: DataFrame, col: str, name: str = "share") -> DataFrame:
    """col / sum(col) over the whole table, the total as a scalar subquery."""
    total = df.select(F.sum(col)).scalar()
    return df.withColumn(name, F.col(col) / total)


def share_within(df: DataFrame, group: Sequence[str], col: str, name: str = "share") -> DataFrame:
    """col / sum(col) within `group`: aggregate and join back (no window, so a
    hot group is summed map-side)."""
    tot = df.groupBy(*group).agg(F.sum(col).alias("_tot"))
    return df.join(tot, list(group), "inner").withColumn(name, F.col(col) / F.col("_tot")).drop("_tot")


# ------------------------------------------------------- missing pairs
def missing_days(keys: DataFrame, key: str, observed: DataFrame, date_col: str,
                 start: Column, end: Column) -> DataFrame:
    """(key, day) pairs of the full daily panel absent from `observed`."""
    panel = keys.select(key, date_spine(start, end, date_col))
    return panel.join(observed.select(key, date_col), [key, date_col], "left_anti")
