"""Operators on ordered rows of a key that may hold any share of the table.

`laid_out` range-partitions rows by (key, time, ...) and writes them once with the number
of their range, so a hot key spans as many ranges as its rows need and the layout is a fact,
not a sample that a second evaluation could draw differently. Windows then run inside a range;
what a range needs from others is one row for each range (its last or first row), which is
carried over in a small table and joined by broadcast (as many rows as ranges).

* `asof_join`: each fact with the version of its key that is valid at its time.
* `gaps`: one row for each run of missing days of a key (gaps and islands by the next day).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epilake.session import work_path

PART, AT = "_range", "_at"


def laid_out(df: DataFrame, order: list, name: str) -> DataFrame:
    """`df` range-partitioned and sorted by `order`, written to the shared folder with `_range` and the row's
    place in it (`_at`)."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.withColumns({PART: F.spark_partition_id(), AT: F.monotonically_increasing_id()})
    path = work_path(spark, "out", "ordered", f"{name}-{uuid.uuid4().hex[:12]}")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _in_range():
    return Window.partitionBy(PART).orderBy(AT)


def asof_join(facts: DataFrame, versions: DataFrame, key: str, time: str, valid_from: str = "valid_from",
              valid_to: str = "valid_to", payload: list[str] | None = None) -> DataFrame:
    """Left as-of join: the columns `payload` of the version of `key` with valid_from <= time < valid_to
    (null valid_to: open), null where there is none.

    Versions of a key do not overlap. Both sides go through one range shuffle by (key, time); a version stands
    before the facts of its first day and is carried forward to them, also into later ranges. A fact with a null
    key or time has no version. Of versions with equal key and start the last in order of all columns counts.
    """
    payload = payload or [c for c in versions.columns if c not in (key, valid_to)]
    version = F.struct(key, F.col(valid_from).alias("_from"), F.col(valid_to).alias("_to"), *[F.col(c).alias(f"_p{i}") for i, c in enumerate(payload)])
    old = versions.where(F.col(key).isNotNull() & F.col(valid_from).isNotNull()).select(
        F.col(key).alias("_key"), F.col(valid_from).alias("_time"), F.lit(0).alias("_kind"), version.alias("_version"))
    new = facts.select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(1).alias("_kind"), F.struct(*facts.columns).alias("_fact"))
    rows = laid_out(old.unionByName(new, allowMissingColumns=True), ["_key", "_time", "_kind", "_version"], "asof")
    # the last version of each range, carried to the ranges behind it
    ends = rows.where("_kind = 0").groupBy(PART).agg(F.max_by("_version", AT).alias("_end"))
    ranges = rows.select(PART).distinct().join(ends, PART, "left")
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = ranges.select(PART, F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    rows = rows.join(F.broadcast(carried), PART)
    here = F.last("_version", ignorenulls=True).over(_in_range())
    rows = rows.withColumn("_found", F.coalesce(here, "_carry")).where("_kind = 1")
    found = F.col("_found")
    valid = (found[key] == F.col("_key")) & (found["_from"] <= F.col("_time")) & (found["_to"].isNull() | (F.col("_time") < found["_to"]))
    return rows.select("_fact.*", *[F.when(valid, found[f"_p{i}"]).alias(c) for i, c in enumerate(payload)])


def gaps(keys: DataFrame, key: str, observed: DataFrame, date_col: str, first_day, last_day) -> DataFrame:
    """key, gap_start, gap_end, n_days: the runs of days from first_day to last_day (Columns, or dates) without a
    row of `observed`, one row each.

    keys: the keys that should be observed, unique. Marks at the day before the first and behind the last bound each
    key, so a key without any row is one gap. Observations outside of the days, of other keys or null are ignored.
    """
    lo, hi = (F.lit(d) if not hasattr(d, "alias") else d for d in (first_day, last_day))
    seen = observed.select(F.col(key).alias("_key"), F.col(date_col).alias("_day")).where(F.col("_day").between(lo, hi))
    seen = seen.distinct().withColumn("_mark", F.lit(0))
    marks = keys.select(F.col(key).alias("_key"), F.explode(F.array(
        F.struct(F.date_sub(lo, 1).alias("_day"), F.lit(1).alias("_mark")), F.struct(F.date_add(hi, 1).alias("_day"), F.lit(1).alias("_mark")))).alias("m"))
    marks = marks.select("_key", "m.*").where(lo <= hi)
    rows = laid_out(seen.unionByName(marks), ["_key", "_day"], "gaps")
    # the first row of the next range that has rows
    firsts = rows.groupBy(PART).agg(F.min_by(F.struct("_key", "_day"), AT).alias("_first"))
    after = firsts.select(PART, F.lead("_first").over(Window.orderBy(PART)).alias("_after"))  # one row a range
    rows = rows.join(F.broadcast(after), PART)
    nxt = F.coalesce(F.lead(F.struct("_key", "_day")).over(_in_range()), "_after")
    rows = rows.withColumn("_next", nxt).where((F.col("_next._key") == F.col("_key")) & (F.datediff("_next._day", "_day") > 1))
    # observations of keys that are not asked for have no marks around them
    asked = keys.select(F.col(key).alias("_key"))
    rows = rows.join(asked, "_key", "left_semi")
    start, end = F.date_add("_day", 1), F.date_sub("_next._day", 1)
    return rows.select(F.col("_key").alias(key), start.alias("gap_start"), end.alias("gap_end"), (F.datediff(end, start) + 1).alias("n_days"))
