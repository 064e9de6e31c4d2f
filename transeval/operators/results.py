"""Result records: ordered verdict lists, result documents, cached results, versions.

The original tool stores, per configuration, one JSON document
``{"date": "YYYY-MM-DD HH:MM", "eval": {task_id: {"nfiles": n, "base": [verdict, ...]}}}``
with the verdicts of a task ordered by completion id *as a string* (``"10" < "2"``).

Here the verdict rows stay flat (``verdict_positions``: one row per sample with its
position in that order), which is the form that scales. Stored documents are lines of at
most ``PART_VERDICTS`` verdicts of one task, numbered in order, so no task of any size has to
fit into one value; the reader takes these lines as well as the original documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, MapType, StringType, StructField, StructType

from transeval.functions.metrics import date_label
from transeval.operators.ordered import position_in_group
from transeval.session import partitions_as_text
from transeval.sources import commits

TASK_RESULT = StructType([
    StructField("nfiles", IntegerType()),
    StructField("files", ArrayType(StringType())),
    StructField("base", ArrayType(StringType())),
])
DOCUMENT_SCHEMA = StructType([
    StructField("date", StringType()),
    StructField("eval", MapType(StringType(), TASK_RESULT)),
])
LINE_SCHEMA = StructType([
    StructField("task_id", StringType()),
    StructField("part", LongType()),
    StructField("nfiles", LongType()),
    StructField("base", ArrayType(StringType())),
    StructField("date", StringType()),
])
# verdicts of one document line; a larger task has several lines
PART_VERDICTS = 10_000


def verdict_positions(verdicts: DataFrame, cfg: Sequence[str] = (), task: str = "task_id") -> DataFrame:
    """Each verdict row with ``pos`` (order of completion id as text) and ``nfiles``."""
    text = verdicts.withColumn("completion_id", F.col("completion_id").cast("string"))
    return position_in_group(text, [*cfg, task], ["completion_id"], pos_col="pos", size_col="nfiles")


def task_records(verdicts: DataFrame, cfg: Sequence[str] = (), task: str = "task_id",
                 part_verdicts: int = PART_VERDICTS) -> DataFrame:
    """Per task and part: ``nfiles`` of the whole task and ``base``, the part's verdicts in
    order (a NULL verdict keeps its place)."""
    placed = verdict_positions(verdicts, cfg, task).withColumn("part", F.floor(F.col("pos") / part_verdicts).cast("long"))
    recs = placed.groupBy(*cfg, task, "part").agg(
        F.max("nfiles").alias("nfiles"), F.array_sort(F.collect_list(F.struct("pos", F.col("verdict").alias("v")))).alias("_r"))
    return recs.select(*cfg, task, "part", "nfiles", F.transform("_r", lambda r: r["v"]).alias("base"))


def result_documents(verdicts: DataFrame, cfg: Sequence[str], date_col=None, task: str = "task_id",
                     part_verdicts: int = PART_VERDICTS) -> DataFrame:
    """JSON lines ``{"task_id":…, "part":…, "nfiles":…, "base":[…], "date":…}`` per config,
    task and part, so writing never funnels a configuration, or a large task, through one
    value."""
    recs = task_records(verdicts, cfg, task, part_verdicts)
    date = date_label(date_col) if date_col is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm")
    return recs.withColumn("date", date).select(
        *cfg, F.to_json(F.struct(F.col(task).alias("task_id"), "part", "nfiles", "base", "date")).alias("document"))


def write_result_documents(docs: DataFrame, path: str, cfg: Sequence[str], again: bool = False) -> None:
    """Write documents partitioned by config; refuses to overwrite (like the evaluator,
    which never replaces an existing result file) unless ``again`` adds newer ones beside
    those that are there, told apart by their date."""
    writer = docs.write.mode("append" if again else "errorifexists")
    if cfg:
        writer = writer.partitionBy(*cfg)
    writer.text(path)


def parse_documents(docs: DataFrame, text: str = "value") -> DataFrame:
    """Evaluator-format documents (one per row) -> flat task rows ``(date, task_id,
    nfiles, base)``; old documents with a ``files`` list get ``nfiles = len(files)``."""
    parsed = docs.select(F.from_json(F.col(text), DOCUMENT_SCHEMA).alias("d"))
    rows = parsed.select(F.col("d.date").alias("date"), F.explode("d.eval").alias("task_id", "r"))
    return rows.select("date", "task_id", migrate_nfiles(F.col("r")).alias("nfiles"), F.col("r.base").alias("base"))


def migrate_nfiles(result):
    """``nfiles`` when present, else the length of the legacy ``files`` list."""
    return F.coalesce(result["nfiles"], F.size(result["files"]))


def read_result_documents(spark, path: str) -> DataFrame:
    """Read evaluator-format result files (each file one JSON document)."""
    return parse_documents(spark.read.text(path, wholetext=True))


def read_result_lines(spark, path: str) -> DataFrame:
    """What ``write_result_documents`` wrote, as verdict rows: the config columns (as text),
    date, task_id, nfiles, the position in the task's order and the verdict."""
    with partitions_as_text(spark):
        lines = spark.read.text(path)
    cfg = [c for c in lines.columns if c != "value"]
    parsed = lines.select(*cfg, F.from_json("value", LINE_SCHEMA).alias("d"))
    flat = parsed.select(*cfg, "d.date", "d.task_id", "d.nfiles", "d.part", F.posexplode("d.base").alias("_i", "verdict"))
    # every part but the last is full, so a part starts where the sizes of those before end
    sizes = parsed.select(*cfg, "d.date", "d.task_id", "d.part", F.size("d.base").alias("_n"))
    before = Window.partitionBy(*cfg, "date", "task_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = flat.join(starts, on=[*cfg, "date", "task_id", "part"])
    return placed.select(*cfg, "date", "task_id", "nfiles", (F.col("_start") + F.col("_i")).alias("pos"), "verdict")


def plan_evaluation(samples: DataFrame, cached: DataFrame, cfg: Sequence[str], rerun: bool = False,
                    keys: Sequence[str] = ("task_id", "completion_id")) -> DataFrame:
    """Use stored verdicts for configurations that already have results (unless
    ``rerun``); every sample of the other configurations is ``pending``."""
    if rerun:
        return samples.select(*cfg, *keys).withColumn("state", F.lit("pending")).withColumn("verdict", F.lit(None).cast("string"))
    done_cfg = cached.select(*cfg).distinct()
    from_cache = cached.select(*cfg, *keys, "verdict").withColumn("state", F.lit("cached"))
    todo = (samples.select(*cfg, *keys).join(done_cfg, on=list(cfg), how="left_anti")
            .withColumn("state", F.lit("pending")).withColumn("verdict", F.lit(None).cast("string")))
    return from_cache.unionByName(todo)


def latest_versions(results: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Several stored versions of a result: keep the newest per key (the evaluator moves
    older files aside as ``.bak``, ``.bak.bak``, …). Rows of one version that differ are told
    apart by their values, the largest stays."""
    payload = [c for c in results.columns if c not in keys and c != version]
    newest = F.max(F.struct(F.col(version), *payload))
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_versions"), newest.alias("_l")).select(
        *keys, "n_versions", *[f"_l.{c}" for c in payload], f"_l.{version}")


def write_versioned(results: DataFrame, path: str, cfg: Sequence[str], version: str = "version") -> DataFrame:
    """Store a re-run as the next version of each config (older versions stay, like the
    evaluator's ``.bak`` files); returns the stored rows with their version. A version counts
    once its commit record is written (see ``sources.commits``)."""
    stored, _ = commits.write_version(results, path, cfg, version)
    return stored if stored is not None else results.limit(0).withColumn(version, F.lit(0).cast("long"))


def read_latest(spark, path: str, cfg: Sequence[str], version: str = "version") -> DataFrame:
    """Rows of the newest committed version of each config, with the types they were written
    with."""
    found = read_latest_or_none(spark, path, cfg, version)
    if found is None:
        raise FileNotFoundError(f"no committed version below {path}")
    return found


def read_latest_or_none(spark, path: str, cfg: Sequence[str], version: str = "version") -> DataFrame | None:
    """``read_latest``, or None where nothing has been stored yet."""
    return commits.read_newest(spark, path, version)
