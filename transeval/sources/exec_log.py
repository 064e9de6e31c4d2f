"""Execution logs as the program-running harness writes them.

One record per attempted (sample, test): configuration columns, ``task_id``,
``completion_id``, ``test_idx`` (null for a compile-only record), ``compile_ok``,
``timed_out``, ``elapsed_s``, ``stdout``, ``stderr``. Program output is bytes that need not
be UTF-8, so JSON-lines logs carry it base64-encoded (``stdout_b64``/``stderr_b64``);
parquet logs carry binary columns. Schemas are explicit (no inference pass).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BinaryType, BooleanType, DoubleType, IntegerType, StringType, StructField,
                               StructType)

CFG = ["dataset", "model", "source_lang", "target_lang", "temperature", "stage"]
_COMMON = [StructField("task_id", StringType()), StructField("completion_id", StringType()),
           StructField("test_idx", IntegerType()), StructField("compile_ok", BooleanType()),
           StructField("timed_out", BooleanType()), StructField("elapsed_s", DoubleType())]


def _schema(cfg: Sequence[str], output_fields) -> StructType:
    return StructType([StructField(c, StringType()) for c in cfg] + _COMMON + output_fields)


def read_exec_log(spark: SparkSession, path: str, fmt: str = "parquet", cfg: Sequence[str] = CFG) -> DataFrame:
    """Read an execution log; stdout/stderr come back as binary columns either way."""
    if fmt == "parquet":
        schema = _schema(cfg, [StructField("stdout", BinaryType()), StructField("stderr", BinaryType())])
        return spark.read.schema(schema).parquet(path)
    if fmt == "json":
        schema = _schema(cfg, [StructField("stdout_b64", StringType()), StructField("stderr_b64", StringType())])
        raw = spark.read.schema(schema).json(path)
        return (raw.withColumn("stdout", F.unbase64("stdout_b64")).withColumn("stderr", F.unbase64("stderr_b64"))
                   .drop("stdout_b64", "stderr_b64"))
    raise ValueError(f"unknown format {fmt!r}")
