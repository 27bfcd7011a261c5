"""Readers and writers of texts, tables and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """value: each file whole."""
    return spark.read.text(path, wholetext=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: lines without white space around them; blank lines are dropped."""
    line = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return spark.read.text(path).select(line.alias("value")).where("value <> ''")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, comment: str | None = None) -> DataFrame:
    """A JSON object a line; rows with the comment field are skipped."""
    df = spark.read.schema(schema).json(path)
    return df.where(F.col(comment).isNull()).drop(comment) if comment else df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed table, all text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_catalogue(spark: SparkSession, paths: list[str], names: dict[str, list[str]]) -> DataFrame:
    """Tables of differing heads as one: each field is the first non-empty of its possible columns; null without any."""
    out = None
    for p in paths:
        df = read_csv(spark, p)
        pick = [F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in cs if c in df.columns], F.lit(None).cast("string")).alias(n) for n, cs in names.items()]
        one = df.select(*pick, F.lit(p).alias("source_file"))
        out = one if out is None else out.unionByName(one)
    return out


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, separator: str = "; ") -> None:
    """A headed table; arrays are joined."""
    cols = [F.array_join(F.transform(c, lambda x: x.cast("string")), separator).alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c) for c in df.columns]
    df.select(*cols).write.mode("overwrite").csv(path, header=True)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one pretty JSON line file; for reports, not for data."""
    df.coalesce(1).write.mode("overwrite").json(path)
