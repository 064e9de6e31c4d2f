"""Sample trees: ``root/<dataset>/<model>/<src>/<trg>/temperature_<T>[-sanitized]/<task>/<idx><ext>``.

Reading keeps every sample file as one row (whole text) with its configuration parsed
from the path; writing keeps samples as parquet partitioned by configuration, which is
the form later jobs read. Zero-byte sample files are samples too (empty solution). Trees are
read and written through the data source of ``tree``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transeval import constants as K
from transeval.functions.text import lit_col
from transeval.sources import commits, tree

CFG = tree.CFG
PATH_PATTERN = (r"([^/]+)/([^/]+)/([^/]+)/([^/]+)/temperature_([^/]+?)(-sanitized)?/([^/]+)/([^/]+)$")


def parse_path(path) -> list[Column]:
    """Configuration columns, task id and completion id (file stem before the first '.')."""
    p = lit_col(path)
    g = [F.regexp_extract(p, PATH_PATTERN, i) for i in range(1, 9)]
    return [
        g[0].alias("dataset"), g[1].alias("model"), g[2].alias("source_lang"), g[3].alias("target_lang"),
        g[4].alias("temperature"),
        F.when(g[5] == "", F.lit("raw")).otherwise(F.lit("sanitized")).alias("stage"),
        g[6].alias("task_id"),
        F.substring_index(g[7], ".", 1).alias("completion_id"),
    ]


def sample_path(root, dataset, model, src, trg, temperature, stage, task_id, idx, ext) -> Column:
    suffix = F.when(lit_col(stage) == "sanitized", F.lit(K.SANITIZED_SUFFIX)).otherwise(F.lit(""))
    return F.concat_ws("/", lit_col(root), lit_col(dataset), lit_col(model), lit_col(src), lit_col(trg),
                       F.concat(F.lit("temperature_"), lit_col(temperature), suffix),
                       F.replace(lit_col(task_id), F.lit("/"), F.lit("_")),
                       F.concat(lit_col(idx).cast("string"), lit_col(ext)))


def _address(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark understands it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString())


def _tree(spark: SparkSession, root: str, target_lang: str, level: str, slices: int) -> DataFrame:
    spark.dataSource.register(tree.SampleTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return (spark.read.format(tree.NAME).option("ext", K.EXTENSIONS[target_lang]).option("level", level)
            .option("slices", slices).load(_address(spark, root)))


def read_samples(spark: SparkSession, root: str, target_lang: str, slices: int = tree.SLICES) -> DataFrame:
    """All sample files of one target language under a configuration directory
    ``root`` (``.../temperature_T[-sanitized]``); sub-directories are tasks and only files
    directly inside a task directory with the target extension count, empty ones too."""
    return _tree(spark, root, target_lang, "configuration", slices).select("identifier", "task_id", "completion_id", "solution")


def read_sample_tree(spark: SparkSession, root: str, target_lang: str, slices: int = tree.SLICES) -> DataFrame:
    """All sample files of one target language under ``root``, whose folders are
    ``<dataset>/<model>/<source>/<target>/temperature_T[-sanitized]``, with the configuration
    columns of each. Filters on these choose the folders that are listed (see ``tree``)."""
    return _tree(spark, root, target_lang, "tree", slices).filter(F.col("target_lang") == target_lang)


def write_samples(samples: DataFrame, path: str, cfg=CFG, mode: str = "append") -> None:
    """Samples as parquet partitioned by configuration (``task_id`` ``/`` -> ``_``)."""
    out = samples.withColumn("task_id", F.replace(F.col("task_id"), F.lit("/"), F.lit("_")))
    out.write.mode(mode).partitionBy(*[c for c in cfg if c in out.columns]).parquet(path)


def append_samples(samples: DataFrame, path: str, cfg=CFG, text: str = "solution") -> DataFrame:
    """Add generated samples to a keyed store: a (config, task_id, idx) that is stored already
    keeps its text, so a batch written twice, by a retry or by two jobs, changes nothing, and
    only the buckets of tasks that get rows are written (see ``commits.merge``). A reply that
    is not valid UTF-8 cannot be written as a sample file: it is skipped without taking an
    index, so the next resume plans that index again. Returns the skipped rows."""
    valid = F.coalesce(F.is_valid_utf8(F.col(text)), F.lit(False))
    named = samples.filter(valid).withColumn("task_id", F.replace(F.col("task_id"), F.lit("/"), F.lit("_")))
    commits.merge(named, path, [c for c in cfg if c in samples.columns], ["task_id", "idx"])
    return samples.filter(~valid)


def stored_samples(spark: SparkSession, path: str) -> DataFrame | None:
    """What ``append_samples`` has stored, with the types it was written with; None where
    there is nothing."""
    return commits.read_newest(spark, path, None)


def export_sample_tree(samples: DataFrame, root: str, ext_col: str = "ext", shared_mount: bool = False) -> None:
    """One file per sample, ``<root>/<task_id>/<idx><ext>`` (the layout compile-and-run
    harnesses read), below its configuration's folders where ``samples`` has all columns of
    ``CFG``. Files appear once all tasks have written theirs (see ``tree``). Tasks write, so a
    local path must be one that all machines see; off local mode the caller says so with
    ``shared_mount=True``. Needs ``task_id``, ``idx``, ``solution`` and ``ext``."""
    spark = samples.sparkSession
    address = _address(spark, root)
    if address.startswith("file:") and not shared_mount and not spark.sparkContext.master.startswith("local"):
        raise ValueError("each executor would write to a folder of its own; export to a shared mount")
    if all(c in samples.columns for c in CFG):
        cfg = [F.col(c) for c in CFG if c != "stage"]
        file = F.substring_index(sample_path(F.lit(""), *cfg, F.col("stage"), F.col("task_id"), F.col("idx"), F.col(ext_col)), "/", -7)
    else:
        file = F.concat_ws("/", F.replace(F.col("task_id"), F.lit("/"), F.lit("_")), F.concat(F.col("idx").cast("string"), F.col(ext_col)))
    spark.dataSource.register(tree.SampleTree)
    samples.select(file.alias("file"), "solution").write.format(tree.NAME).mode("append").save(address)
