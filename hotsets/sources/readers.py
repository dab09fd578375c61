"""File readers with fixed schemas (never inferred).

* CSV without header, columns by position (``mode`` FAILFAST by default:
  a malformed number stops the job instead of turning into NULL).
* JSON lines, PERMISSIVE, with malformed lines kept whole in
  ``_corrupt_record`` so the cleaning job can drop them by predicate;
  numbers in any JSON form.
* Avro through ``format('avro')``; the Avro data source must be on the
  classpath (``spark.jars.packages``), otherwise an explanatory error.
* Parquet, the internal format (keeps NULL vs empty text apart).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import DataType, IntegralType, NumericType, StructType

from hotsets import schemas
from hotsets.schemas import ddl

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType, mode: str = "FAILFAST",
             header: bool = False, base_path: str | None = None, **options) -> DataFrame:
    r = spark.read.schema(ddl(schema)).option("header", header).option("mode", mode)
    if base_path:
        r = r.option("basePath", base_path)
    for k, v in options.items():
        r = r.option(k, v)
    return r.csv(path)


def read_json_lines(spark: SparkSession, path: str | list[str], schema: StructType,
                    base_path: str | None = None, observation: Observation | None = None) -> DataFrame:
    """JSON lines with the schema's types.

    Every field is read as text, so that only a malformed line sets
    ``_corrupt_record``; numbers are then converted: ``100``, ``100.0``,
    ``100.5`` and ``"100"`` are all numbers.  In an integer field a fraction
    is cut off, and what is no number becomes NULL (``unreadable_numbers``
    finds such rows, an ``observation`` counts them).  The result does not depend
    on the columns used later.
    """
    text = read_json_text(spark, path, schema, base_path)
    return typed_numbers(text if observation is None else observed_json(text, schema, observation), schema)


def read_json_text(spark: SparkSession, path: str | list[str], schema: StructType,
                   base_path: str | None = None) -> DataFrame:
    """The same lines with every field as text."""
    if CORRUPT not in schema.fieldNames():
        raise ValueError(f"schema needs a {CORRUPT} string column to keep malformed lines")
    r = (spark.read.schema(", ".join(f"`{f.name}` string" for f in schema.fields)).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", CORRUPT))
    if base_path:
        r = r.option("basePath", base_path)
    return r.json(path)


def to_number(text: Column, kind: DataType) -> Column:
    """Text as a number of ``kind``; NULL if it is none."""
    if isinstance(kind, IntegralType):
        return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
    return text.try_cast(kind)


def typed_numbers(text: DataFrame, schema: StructType) -> DataFrame:
    fields = {f.name: f.dataType for f in schema.fields}
    return text.select(*[to_number(F.col(f"`{c}`"), fields[c]).alias(c) if isinstance(fields.get(c), NumericType) else F.col(f"`{c}`")
                         for c in text.columns])


def unreadable_counters(schema: StructType) -> list[Column]:
    """For each numeric field, how often its text is no number (columns named after the fields)."""
    return [F.count_if(F.col(f"`{f.name}`").isNotNull() & to_number(F.col(f"`{f.name}`"), f.dataType).isNull()).alias(f.name)
            for f in schema.fields if isinstance(f.dataType, NumericType)]


def unreadable_numbers(text: DataFrame, schema: StructType) -> DataFrame:
    """``field``, ``n_rows``: how often a numeric field holds something that is
    no number, for the fields where that happens."""
    bad = unreadable_counters(schema)
    names = [f.name for f in schema.fields if isinstance(f.dataType, NumericType)]
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return text.agg(*bad).selectExpr(f"stack({len(names)}, {pairs}) AS (field, n_rows)").where("n_rows > 0")


#: names of the observed counts that are not fields
OBSERVED_ROWS, OBSERVED_CORRUPT = "rows read", "corrupt rows"


def observed_json(text: DataFrame, schema: StructType, observation: Observation) -> DataFrame:
    """``text`` with its rows, its malformed lines and its unreadable numbers counted on the way,
    by whatever job reads it next: no scan of its own.  ``observation.get`` has the counts then."""
    return text.observe(observation, F.count(F.lit(1)).alias(OBSERVED_ROWS), F.count(F.col(CORRUPT)).alias(OBSERVED_CORRUPT), *unreadable_counters(schema))


def read_avro(spark: SparkSession, path: str | list[str], schema: StructType | None = None,
              base_path: str | None = None) -> DataFrame:
    r = spark.read.format("avro")
    if schema is not None:
        r = r.schema(ddl(schema))
    if base_path:
        r = r.option("basePath", base_path)
    try:
        return r.load(path)
    except Exception as e:  # noqa: BLE001
        if "avro" in str(e).lower() and ("not find" in str(e).lower() or "failed to find" in str(e).lower()):
            raise RuntimeError("the Avro data source is not on the classpath; add the spark-avro "
                               "package matching this Spark version (spark.jars.packages)") from e
        raise


def read_parquet(spark: SparkSession, path: str | list[str], base_path: str | None = None) -> DataFrame:
    r = spark.read
    if base_path:
        r = r.option("basePath", base_path)
    return r.parquet(path)


def read(spark: SparkSession, fmt: str, path: str | list[str], schema: StructType,
         **options) -> DataFrame:
    """Dispatch on format: csv | json | avro | parquet."""
    if fmt == "csv":
        return read_csv(spark, path, schema, **options)
    if fmt == "json":
        return read_json_lines(spark, path, schema, options.get("base_path"))
    if fmt == "avro":
        return read_avro(spark, path, schema, options.get("base_path"))
    if fmt == "parquet":
        return read_parquet(spark, path, options.get("base_path"))
    raise ValueError(f"unknown format {fmt!r}")


# Convenience readers for the domain tables.

def read_access_log(spark, path, fmt: str = "json") -> DataFrame:
    """The 48-column access log (for logs stored as few unsplittable files,
    such as gzip, ``repartition`` the result)."""
    if fmt == "csv":
        # In the CSV form, ``_corrupt_record`` is a data column (the JSON
        # parser's flag, saved with the rest); the CSV reader must not claim
        # that name for its own malformed-line slot.
        return read_csv(spark, path, schemas.ACCESS_RAW, columnNameOfCorruptRecord="_malformed_csv_line")
    return read(spark, fmt, path, schemas.ACCESS_RAW)


def read_access_clean(spark, path, legacy: bool = False) -> DataFrame:
    return read_csv(spark, path, schemas.ACCESS_CLEAN_V1 if legacy else schemas.ACCESS_CLEAN)


def read_file_catalog(spark, path) -> DataFrame:
    return read_csv(spark, path, schemas.FILE_CATALOG)


def read_replica_snapshots(spark, path, base_path: str | None = None) -> DataFrame:
    return read_csv(spark, path, schemas.REPLICA_SNAPSHOTS, base_path=base_path)


def read_jobs(spark, path, fmt: str = "avro") -> DataFrame:
    return read(spark, fmt, path, schemas.JOBS)


def read_analyses(spark, path) -> DataFrame:
    return read_json_lines(spark, path, _with_corrupt(schemas.ANALYSES))


def read_dataset_catalog(spark, path, fmt: str = "csv") -> DataFrame:
    return read(spark, fmt, path, schemas.DATASET_CATALOG)


def read_popularity(spark, path, fmt: str = "csv", mode: str = "FAILFAST") -> DataFrame:
    """The 16-column weekly table (training year or a new week)."""
    if fmt == "csv":
        return read_csv(spark, path, schemas.POPULARITY, mode=mode)
    return read(spark, fmt, path, schemas.POPULARITY)


def _with_corrupt(schema: StructType) -> StructType:
    from pyspark.sql.types import StringType, StructField
    return StructType(list(schema.fields) + [StructField(CORRUPT, StringType(), True)])
