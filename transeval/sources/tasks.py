"""Task tables: scan with the language filter pushed into the parquet reader, the
language -> extension map, and the Java class rename applied before compiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from transeval import constants as K
from transeval.functions.text import lit_col

TASK_SCHEMA = StructType([
    StructField("dataset", StringType()),
    StructField("task_id", StringType()),
    StructField("language", StringType()),
    StructField("code", StringType()),
    StructField("test_io", ArrayType(StructType([StructField("input", StringType()),
                                                 StructField("output", StringType())]))),
])


def read_tasks(spark: SparkSession, path: str, dataset: str | None = None, language: str | None = None) -> DataFrame:
    """Tasks stored as parquet (optionally partitioned by ``dataset``); the dataset and
    language filters reach the scan (partition pruning / pushed filters)."""
    df = spark.read.parquet(path)
    if dataset is not None:
        if dataset not in K.DATASETS:
            raise ValueError(f"unknown dataset {dataset!r}")
        df = df.filter(F.col("dataset") == dataset)
    if language is not None:
        if language not in K.LANGUAGES:
            raise ValueError(f"unknown language {language!r}")
        df = df.filter(F.col("language") == language)
    return df


def extension(language) -> Column:
    """Language -> file extension (NULL for an unknown language)."""
    m = F.create_map(*[x for lang, ext in K.EXTENSIONS.items() for x in (F.lit(lang), F.lit(ext))])
    return F.try_element_at(m, lit_col(language))


def java_class_rename(code, task_id) -> Column:
    """Every ``class <Name>`` becomes ``class <task_id>`` (the file is named after the
    task, so the public class must be too). Unicode word/space classes as in Python."""
    # the replacement is a regex replacement string: quote backslash and dollar
    repl = F.regexp_replace(F.regexp_replace(lit_col(task_id), r"\\", r"\\\\"), r"\$", r"\\\$")
    return F.regexp_replace(lit_col(code), F.lit(r"(?U)\bclass\s+\w+"), F.concat(F.lit("class "), repl))
