"""Run metadata: one row per generation run (model settings, arguments, start/finish)."""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

RUN_SCHEMA = StructType([
    StructField("dataset", StringType()), StructField("model", StringType()),
    StructField("source_lang", StringType()), StructField("target_lang", StringType()),
    StructField("temperature", StringType()), StructField("event", StringType()),
    StructField("at", TimestampType()), StructField("model_settings", StringType()),
    StructField("arguments", StringType()),
])


def record_run(spark: SparkSession, path: str, cfg: dict, event: str, model_settings: dict | None = None,
               arguments: dict | None = None) -> DataFrame:
    """Append a ``started`` / ``finished`` row for one run to the ``runs`` table."""
    row = (cfg.get("dataset"), cfg.get("model"), cfg.get("source_lang"), cfg.get("target_lang"),
           str(cfg.get("temperature")), event, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None),
           json.dumps(model_settings or {}, sort_keys=True, default=str),
           json.dumps(arguments or {}, sort_keys=True, default=str))
    df = spark.createDataFrame([row], RUN_SCHEMA)
    df.write.mode("append").parquet(path)
    return df
