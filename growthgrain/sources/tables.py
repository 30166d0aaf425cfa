"""Reading input tables and writing results, as Parquet or CSV."""

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthgrain.operators.keys import KEY

NULL_TEXT = "NA"


def _text(field: T.StructField) -> Column:
    return F.nullif(F.col(field.name), F.lit(""))


def _parsed(field: T.StructField) -> Column:
    return _text(field).try_cast(field.dataType)


def _unreadable(field: T.StructField) -> Column:
    return _text(field).isNotNull() & _parsed(field).isNull()


def _parsed_or_error(field: T.StructField) -> Column:
    message = F.concat(F.lit(f"{field.name} is not a {field.dataType.simpleString()}: "), _text(field))
    return F.when(_unreadable(field), F.raise_error(message)).otherwise(_parsed(field))


def _raw_csv(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    return spark.read.csv(
        path,
        header=True,
        inferSchema=False,
        nullValue=NULL_TEXT,
        mode=mode,
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` from CSV with a header, in any order and among others.

    Empty and ``NA`` fields are NULL; blanks around fields are dropped. A field that is
    not of its type fails the query that reads it. Nothing is guessed from the data, so
    ids keep their leading zeros.
    """
    raw = _raw_csv(spark, path)
    return raw.select(*[_parsed_or_error(field).alias(field.name) for field in schema])


def read_csv_with_rejects(
    spark: SparkSession, path: str, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """The rows whose fields are all of their type, and the others.

    The others hold their fields as text, and in ``unreadable`` the names of those that
    are not of their type. Each of the two reads the file; ``read_csv_counted`` counts the
    others on the way.
    """
    marked = _marked(spark, path, schema)
    return _readable(marked, schema), marked.where(F.size("unreadable") > 0)


def _marked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    raw = _raw_csv(spark, path).select(*[_text(field).alias(field.name) for field in schema])
    names = [F.when(_unreadable(field), F.lit(field.name)) for field in schema]
    return raw.withColumn("unreadable", F.array_compact(F.array(*names)))


def _readable(marked: DataFrame, schema: T.StructType) -> DataFrame:
    good = marked.where(F.size("unreadable") == 0)
    return good.select(*[_parsed(field).alias(field.name) for field in schema])


def read_csv_counted(
    spark: SparkSession, path: str, schema: T.StructType
) -> tuple[DataFrame, Observation]:
    """The rows whose fields are all of their type, and what was left out: ``rows`` read,
    ``rejected`` rows, and for each column the unreadable fields in ``unreadable_<column>``.

    The counts come with the rows, from the first action that reads them all; asking for
    them before waits for it.
    """
    marked, counts = _marked(spark, path, schema), Observation()
    each = [
        F.count_if(F.array_contains("unreadable", f.name)).alias(f"unreadable_{f.name}") for f in schema
    ]
    rejected = F.count_if(F.size("unreadable") > 0).alias("rejected")
    observed = marked.observe(counts, F.count("*").alias("rows"), rejected, *each)
    return _readable(observed, schema), counts


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet cut to the columns of ``schema``, each cast to its type."""
    raw = spark.read.parquet(path)
    return raw.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def read_optional_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """CSV table, or ``None`` if there is nothing at ``path``."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def table_kind(path: str, kind: str | None = None) -> str:
    """``kind``, or else ``csv`` if the path ends in ``.csv`` or a compressed form of it."""
    return kind or ("csv" if re.search(r"\.csv(\.\w+)?/?$", path) else "parquet")


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, kind: str | None = None
) -> DataFrame:
    """A table of the given ``kind``, ``csv`` or ``parquet``, or of that its path tells."""
    return {"csv": read_csv, "parquet": read_parquet}[table_kind(path, kind)](spark, path, schema)


def _save(writer, table: str, path: str | None, append: bool) -> None:
    writer = writer.mode("append" if append else "overwrite").format("parquet")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def save_bucketed(
    df: DataFrame,
    table: str,
    buckets: int,
    path: str | None = None,
    append: bool = False,
    period: str | None = None,
) -> None:
    """A table bucketed by profile, in folders by ``period`` if that column is given, at
    ``path`` if given, else in the warehouse."""
    writer = df.repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(KEY)
    _save(writer.partitionBy(period) if period else writer, table, path, append)


def save_small(df: DataFrame, table: str, path: str | None = None, append: bool = False) -> None:
    """A table of few rows, each time in one file."""
    _save(df.coalesce(1).write, table, path, append)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and NULL as ``NA``; a folder with one or more part files.

    Each part file holds a stretch of the table's order, and part names follow it.
    """
    df.write.mode("overwrite").csv(path, header=True, nullValue=NULL_TEXT, emptyValue="")
