"""Sinks and round trips: partitioned Parquet tables (L1, L2) and CSV with
header, optionally gzip (S1-S6).

Writes go under the shared work folder (`spark.checkpoint.dir`). The
`rebalance` hint lets AQE cut the written data into evenly sized tasks
and split a partition value that holds a large share of the rows, so
neither one hot region nor tiny files dominate the write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epilake.session import work_path

# Read schemas: counts that the reference writes as floats (NaN made them
# float) are read as DOUBLE and cast after reading.
# The reference's geography file layout (its CSV header order).
REFERENCE_GEOGRAPHY_READ = T.StructType([
    T.StructField("geography_id", T.StringType()), T.StructField("country_code", T.StringType()),
    T.StructField("country_name", T.StringType()), T.StructField("region_name", T.StringType()),
    T.StructField("district_name", T.StringType()), T.StructField("sub_district_name", T.StringType()),
    T.StructField("population", T.DoubleType()), T.StructField("urban_rural", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("population_density", T.DoubleType()),
])
CASE_READ = T.StructType([
    T.StructField("case_id", T.StringType()), T.StructField("report_date", T.DateType()),
    T.StructField("case_date", T.DateType()), T.StructField("facility_id", T.StringType()),
    T.StructField("geography_id", T.StringType()), T.StructField("disease", T.StringType()),
    T.StructField("new_cases", T.DoubleType()), T.StructField("deaths", T.DoubleType()),
    T.StructField("recoveries", T.IntegerType()), T.StructField("age_group", T.StringType()),
    T.StructField("gender", T.StringType()),
])
#: The same with the types that the rows have in the end, for checked reads.
CASE_READ_WHOLE = T.StructType([T.StructField(f.name, T.IntegerType() if f.name in ("new_cases", "deaths") else f.dataType) for f in CASE_READ])

_T = T.StructField
GEOGRAPHY_READ = T.StructType([
    _T("geography_id", T.StringType()), _T("n_nationkey", T.IntegerType()), _T("country_code", T.StringType()),
    _T("country_name", T.StringType()), _T("region_name", T.StringType()), _T("district_name", T.StringType()),
    _T("population", T.DoubleType()), _T("urban_rural", T.StringType()), _T("latitude", T.DoubleType()),
    _T("longitude", T.DoubleType()), _T("population_density", T.DoubleType()),
])
FACILITY_READ = T.StructType([
    _T("facility_id", T.StringType()), _T("facility_name", T.StringType()), _T("geography_id", T.StringType()),
    _T("country_code", T.StringType()), _T("region_name", T.StringType()), _T("district_name", T.StringType()),
    _T("facility_level", T.IntegerType()), _T("facility_type", T.StringType()), _T("capacity", T.DoubleType()),
    _T("staff_count", T.DoubleType()), _T("has_lab", T.BooleanType()), _T("has_isolation_ward", T.BooleanType()),
    _T("has_xray", T.BooleanType()), _T("ambulance_count", T.IntegerType()), _T("latitude", T.DoubleType()),
    _T("longitude", T.DoubleType()), _T("operational_status", T.StringType()), _T("established_year", T.IntegerType()),
    _T("s_suppkey", T.LongType()),
])
CLIMATE_READ = T.StructType([
    _T("obs_date", T.DateType()), _T("geography_id", T.StringType()), _T("temperature_min_c", T.DoubleType()),
    _T("temperature_max_c", T.DoubleType()), _T("rainfall_mm", T.DoubleType()), _T("humidity_pct", T.DoubleType()),
])


def write_csv(df: DataFrame, path: str, compress: bool = False, sort_cols: list[str] | None = None) -> str:
    """Header, no index, overwrite; the writer creates the folder.
    K3: rows of each output file in `sort_cols` order (sorted within partitions,
    no shuffle)."""
    if sort_cols:
        df = df.sortWithinPartitions(*sort_cols)
    w = df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd")
    if compress:
        w = w.option("compression", "gzip")
    w.csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header under an explicit schema (no inference pass)."""
    return (spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd")
            .option("mode", "FAILFAST").csv(path))


def cast_counts(cases: DataFrame) -> DataFrame:
    """Counts read as double -> int; a fractional or huge value becomes null, not an error."""
    return cases.withColumns({c: whole_number(F.col(c), "int") for c in ("new_cases", "deaths")})


def whole_number(value: F.Column, kind: str) -> F.Column:
    """A double as an integer; null if it is fractional or out of range (a plain cast would cut 1.5 to 1)."""
    return F.when(value == F.floor(value), value.try_cast(kind))


# ---------------------------------------------------------------- dirty files
_INTEGERS = {"int", "bigint", "smallint", "tinyint"}
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _typed(text: F.Column, number: F.Column, kind: str) -> F.Column:
    """The typed value of a text field; `number` holds it as a double if the field is a whole number."""
    if kind == "string":
        return text
    if kind == "date":
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    if kind == "boolean":
        return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
    if kind not in _INTEGERS:
        return F.when(text.rlike(_NUMBER), text.try_cast("double")).cast(kind)
    # digits alone are read as they are; 12.0 is a count that was printed as a float
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast(kind)), whole_number(number, kind))


def _violation(number: F.Column, c: str, kind: str) -> F.Column:
    """The name of what makes a given field null."""
    if kind not in _INTEGERS:
        return F.lit(f"bad_{c}")
    return (F.when(number.isNull(), F.lit(f"bad_{c}")).when(number != F.floor(number), F.lit(f"fractional_{c}"))
            .otherwise(F.lit(f"out_of_range_{c}")))


def _with_step(rows: DataFrame, columns: list[F.Column]) -> DataFrame:
    """`rows` with `columns`, which later steps read and do not evaluate again: projections that follow each other
    become one, in which a value stands as often as it is used, and so large a method is not compiled."""
    return rows.select("*", F.inline(F.array(F.struct(*columns)))) if columns else rows


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every line of the CSV files below `path`, typed, with the violations that it has (an empty array: a good line).

    Columns: those of `schema`, `violations`, `line`, `file`. A violation names its field: `bad_<c>` (not a date,
    number or flag), `fractional_<c>` and `out_of_range_<c>` for whole numbers; `corrupt_line` is one whose fields do
    not match the schema in number or quoting. Fields with a violation are null; an empty field is null without
    one. Lines that equal the schema's header are headers and blank lines are none, so good and bad lines are
    all lines, and no line ends the job. The scan reads text fields, so one narrow pass is enough; `line` is the
    line as it was read if it is corrupt, else its fields as CSV.
    """
    names, at = [f.name for f in schema.fields], [f"_text_{i}" for i in range(len(schema))]
    texts = T.StructType([T.StructField(c, T.StringType()) for c in [*at, "_corrupt"]])
    rows = spark.read.schema(texts).options(mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", header=False,
                                            recursiveFileLookup=True).csv(path)
    header = F.lit(True)
    for t, c in zip(at, names):
        header = header & F.col(t).eqNullSafe(F.lit(c))
    corrupt = F.col("_corrupt").isNotNull()
    kinds = [f.dataType.simpleString() for f in schema.fields]
    rows = rows.where(~header).select(*at, "_corrupt", F.col("_metadata.file_path").alias("file"))
    rows = _with_step(rows, [F.when(F.col(t).rlike(_NUMBER), F.col(t).try_cast("double")).alias(f"_number_{i}")
                             for i, (t, kind) in enumerate(zip(at, kinds)) if kind in _INTEGERS])
    rows = _with_step(rows, [F.when(~corrupt, _typed(F.col(t), F.col(f"_number_{i}"), kind)).alias(f"_value_{i}")
                             for i, (t, kind) in enumerate(zip(at, kinds))])
    found = [F.when(corrupt, F.lit("corrupt_line"))]
    for i, (t, c, kind) in enumerate(zip(at, names, kinds)):
        if kind != "string":
            wrong = ~corrupt & F.col(t).isNotNull() & F.col(f"_value_{i}").isNull()
            found.append(F.when(wrong, _violation(F.col(f"_number_{i}"), c, kind)))
    # nulls go by array_except: array_compact would leave generated code, and with it all that the array is made of
    none = F.array().cast("array<string>")
    violations = F.when(F.coalesce(*found).isNull(), none).otherwise(F.array_except(F.array(*found), F.array(F.lit(None).cast("string"))))
    line = F.coalesce("_corrupt", F.to_csv(F.struct(*at)))
    return rows.select(*[F.col(f"_value_{i}").alias(c) for i, c in enumerate(names)], violations.alias("violations"), line.alias("line"), "file")


def split_checked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows (columns of the schema), and the quarantine: line, file, reasons."""
    bad = F.size("violations") > 0
    good = rows.where(~bad).drop("violations", "line", "file")
    return good, rows.where(bad).select("line", "file", F.array_join("violations", ",").alias("reasons"))


# ---------------------------------------------------------------- globally ordered files (K3)
#: Rows of a task and file of `write_csv_sorted`, and (as a power of two) of a piece that `sorted_manifest` looks at.
SORTED_FILE_ROWS, PIECE_BITS = 500_000, 16


def write_csv_sorted(df: DataFrame, path: str, order: list[str], file_rows: int = SORTED_FILE_ROWS) -> str:
    """CSV files in `order` over the whole table: file k holds smaller keys than file k + 1, rows in each are sorted.

    Ranges come from sampled split points, so one task and one file hold about the same number of rows, and rows of
    equal keys are in one file. Their number grows with the rows, so that what a task sorts does not.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // file_rows))
    return write_csv(df.repartitionByRange(parts, *order), path, sort_cols=order)


def sorted_manifest(spark: SparkSession, path: str, schema: T.StructType, order: list[str], piece_bits: int = PIECE_BITS) -> DataFrame:
    """file_no, n_rows, first and last key (structs) of the files of `write_csv_sorted`, and whether the rows of the
    file come in order: read from the files themselves, so it proves what was written.

    Rows are compared inside pieces of consecutive rows, which go to as many tasks as the scan has, and pieces (one
    row each) with the one before in their file: no task holds a file.
    """
    file_no = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    rows = read_csv(spark, path, schema).select(F.struct(*order).alias("key"), file_no.alias("file_no"), F.col("_metadata.file_block_start").alias("block"))
    rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("piece", F.shiftright("at", piece_bits))
    of_piece = ["file_no", "block", "piece"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    before = F.lag("key").over(Window.partitionBy(*of_piece).orderBy("at"))
    rows = rows.repartition(tasks, *of_piece).withColumn("ok", F.coalesce(before <= F.col("key"), F.lit(True)))
    pieces = rows.groupBy(*of_piece).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("key").alias("first"), F.max("key").alias("last"), F.bool_and("ok").alias("ok"))
    before = F.lag("last").over(Window.partitionBy("file_no").orderBy("block", "piece"))
    pieces = pieces.withColumn("ok", F.col("ok") & F.coalesce(before <= F.col("first"), F.lit(True)))
    return pieces.groupBy("file_no").agg(
        F.sum("n_rows").alias("n_rows"), F.min("first").alias("first"), F.max("last").alias("last"), F.bool_and("ok").alias("in_order"))


def prove_order(manifest: DataFrame) -> DataFrame:
    """One row: n_rows, first and last key, in_order (inside all files and over them)."""
    before = F.lag("last").over(Window.orderBy("file_no"))  # one row a file
    rows = manifest.withColumn("follows", F.coalesce(before <= F.col("first"), F.lit(True)))
    return rows.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.min("first").alias("first"), F.max("last").alias("last"),
                    F.coalesce(F.bool_and(F.col("follows") & F.col("in_order")), F.lit(True)).alias("in_order"))


def write_partitioned(df: DataFrame, path: str, partition_cols: list[str], dealt: bool = False) -> str:
    """L1/L2: Parquet partitioned by `partition_cols`, rebalanced by AQE before the write if its tasks are not
    `dealt` by them already."""
    ((df if dealt else df.hint("rebalance", *partition_cols))
     .write.mode("overwrite").partitionBy(*partition_cols).parquet(path))
    return path


def tagged_path(spark: SparkSession, sf_dir: str, *parts: str) -> str:
    """Work-folder path unique to the input folder."""
    tag = sf_dir.rstrip("/").replace("/", "_").strip("_")
    return work_path(spark, "out", tag, *parts)
