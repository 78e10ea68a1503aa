"""Reading and writing plain tables, and small facts about the file system."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloop.operators.project import build_features


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def child_dirs(spark: SparkSession, path: str, before: int | None = -1) -> list[str]:
    """Sorted names of the directories directly under ``path``.

    With ``before`` (milliseconds since 1970; None: a day ago) only those last modified earlier.
    """
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return []
    if before is None:
        before = int((time.time() - 86_400) * 1000)
    found = [s for s in fs.listStatus(p) if s.isDirectory() and (before < 0 or s.getModificationTime() < before)]
    return sorted(s.getPath().getName() for s in found)


def child_files(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of the visible files directly under ``path``."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(n for s in fs.listStatus(p) if s.isFile() and not (n := s.getPath().getName()).startswith((".", "_")))


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """A small text file that appears whole and at once; False, and nothing changed, if ``path`` is there already.

    Written beside and renamed without replacing: atomic where the file system's rename is.
    """
    fs, target = _path(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(beside)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(target), options)
    except Py4JJavaError as e:
        fs.delete(beside, False)
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        return False
    return True


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    """A small sidecar document as a one-line text data set."""
    text = json.dumps(document, ensure_ascii=False)
    spark.range(0, 1, 1, 1).select(F.lit(text).alias("value")).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; pass a schema to avoid the extra inference pass."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


# Types that an inferred column may have, narrowest first.
INFERRED = ("int", "bigint", "double", "boolean", "date", "timestamp")
# Texts that casts read but that mean more, or less, than the type holds.
SHAPES = {"boolean": r"^(?i)(true|false)$", "date": r"^\d{4}-\d{1,2}-\d{1,2}$"}
CORRUPT = "_corrupt_record"
# Rows that teach a schema.
SCHEMA_ROWS = 10_000


def infer_csv_schema(spark: SparkSession, path: str, rows: int = SCHEMA_ROWS) -> T.StructType:
    """The narrowest type per column that reads every value of the first ``rows`` rows.

    All columns and types are tried in one aggregate; a column without a value is text. Rows
    beyond may not fit: ``split_csv`` sets them aside.
    """
    texts = read_csv(spark, path, _all_text(spark, path)).limit(rows)

    def misfits(v: Column, kind: str) -> Column:
        fits = v.try_cast(kind).isNotNull()
        return F.count_if(v.isNotNull() & ~(fits & v.rlike(SHAPES[kind]) if kind in SHAPES else fits)).alias(kind)

    values = [F.trim(F.col(f"`{c}`")) for c in texts.columns]
    fits = [F.struct(F.count(v).alias("n"), *[misfits(v, t) for t in INFERRED]).alias(f"c{i}") for i, v in enumerate(values)]
    found = texts.agg(*fits).first()
    kinds = [next((t for t in INFERRED if own["n"] and not own[t]), "string") for own in found]
    return T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in zip(texts.columns, kinds)])


def _all_text(spark: SparkSession, path: str) -> T.StructType:
    """Every column of the header as text."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    header = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return T.StructType([T.StructField(c, T.StringType()) for c in header.columns])


def split_csv(
    spark: SparkSession, path: str, quarantine: str, schema: T.StructType | str | None = None, rows: int = SCHEMA_ROWS
) -> DataFrame:
    """Rows of a CSV with a header that fit its schema; all other lines go to ``quarantine``, whole.

    Without a schema one is inferred. A line does not fit when a value has another type or
    the number of fields is wrong. ``quarantine`` gets the line as ``line`` and what could
    be read of it; it is written when this is called.
    """
    if schema is None:
        schema = infer_csv_schema(spark, path, rows)
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    known = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    # Whether a line fits depends on all its fields, whichever a query wants later.
    every = reader.option("columnPruning", "false").schema(known).csv(path)
    # Spark refuses to read the whole line alone, so a field goes with it.
    field = F.length(F.coalesce(F.col(f"`{schema.fieldNames()[0]}`").cast("string"), F.lit(""))) >= 0
    bad = every.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), *[f"`{n}`" for n in schema.fieldNames()])
    bad.write.mode("overwrite").parquet(quarantine)
    return every.filter(F.col(CORRUPT).isNull() & field).drop(CORRUPT)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite with a header in every part file and no index column."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a Parquet log of fixed schema."""
    spark = df.sparkSession
    if exists(spark, path):
        known = spark.read.parquet(path).schema
        have = {f.name: f.dataType for f in df.schema.fields}
        if have != {f.name: f.dataType for f in known.fields}:
            raise ValueError("log schema differs from the rows to append")
        df = df.select(*[f"`{n}`" for n in known.fieldNames()])
    df.write.mode("append").parquet(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table read with this schema; empty when it does not exist."""
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def make_dataset(
    spark: SparkSession, source: str, target: str, schema: T.StructType | str | None = None, **features
) -> DataFrame:
    """CSV in, engineered features added, Parquet out."""
    build_features(read_csv(spark, source, schema), **features).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
