"""Tables kept as versions per configuration, with a commit log.

    <root>/write=w…/part=c…/version=2/*.parquet    rows, with the columns of the configuration
    <root>/_log/c…/00000002.json                   one record for each version

A configuration is the values of some columns; its digest names its folders. A write puts its
rows into a folder of its own and then, configuration by configuration, creates the record of
the next version, which names the folders the version consists of and the schema of its rows.
A record is created whole and never replaced, so

* a version exists when its record does: rows of a write that crashed are never read;
* of two writers of one version one is first, and the other one stores its rows as the next
  version, or merges anew with what the first has stored;
* types come back as written, whatever the values look like in a path.

Readers take the folders that the newest records name. What the driver holds is one record for
each configuration and bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from transeval.sources import files

LOG = "_log"
RECORD = "config string, version long, write string, folders map<string,string>, schema string, rows long"
#: Attempts of a write that others are ahead of.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another write committed the version first."""


class Record(NamedTuple):
    """``folders``: of each bucket (one, named '', where a version is written whole) the folder
    below the root."""
    config: str
    version: int
    write: str
    folders: dict[str, str]
    schema: str
    rows: int


def digest(cfg: Sequence[str]) -> Column:
    """A configuration's name: values of other types, and nulls, are other configurations."""
    if not cfg:
        return F.lit("call")
    return F.concat(F.lit("c"), F.md5(F.to_json(F.struct(*[F.col(c) for c in cfg]), {"ignoreNullFields": "false"})))


def records(spark: SparkSession, root: str) -> DataFrame:
    """All committed versions, one row each."""
    if not files.exists(spark, f"{root}/{LOG}"):
        return spark.createDataFrame([], RECORD)
    text = spark.read.text(f"{root}/{LOG}/*/*.json", wholetext=True)
    return text.select(F.from_json("value", RECORD).alias("r")).select("r.*")


def newest(spark: SparkSession, root: str) -> dict[str, Record]:
    """The newest record of each configuration."""
    rows = [x.name for x in StructType.fromDDL(RECORD).fields]
    last = records(spark, root).groupBy("config").agg(F.max_by(F.struct(*rows), "version").alias("r")).select("r.*")
    return {r.config: Record(*r) for r in last.collect()}


def commit(spark: SparkSession, root: str, record: Record) -> bool:
    """Create the record; False where the version has one."""
    return files.create_only(spark, f"{root}/{LOG}/{record.config}/{record.version:08d}.json", json.dumps(record._asdict()))


def read(spark: SparkSession, root: str, chosen: Sequence[Record], version: str | None = "version") -> DataFrame | None:
    """The rows of some versions, with the version's number; None where there are none. A
    column that has several types in them is read as text."""
    chosen = [r for r in chosen if r.folders]
    if not chosen:
        return None
    by_schema: dict[tuple[str, int], list[str]] = {}
    for r in chosen:
        by_schema.setdefault((r.schema, r.version), []).extend(f"{root}/{f}" for f in r.folders.values())
    parts = []
    for (schema, number), folders in sorted(by_schema.items()):
        part = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*folders)
        parts.append(part if version is None else part.withColumn(version, F.lit(number).cast("long")))
    types: dict[str, set[str]] = {}
    for p in parts:
        for f in p.schema:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    several = {c for c, t in types.items() if len(t) > 1}
    same = [p.select(*[F.col(c).cast("string").alias(c) if c in several else F.col(c) for c in p.columns]) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)


def put(rows: DataFrame, root: str, cfg: Sequence[str], bucket: Column, name: str = "bucket") -> tuple[str, DataFrame]:
    """Write rows aside, by configuration and ``bucket`` (folders of that ``name``); returns the
    write's name, and the folders with their numbers of rows: config, bucket, n. Nothing is
    committed."""
    write = f"w{uuid.uuid4().hex}"
    path = f"{root}/write={write}"
    kept = [c for c in rows.columns if c != "_next"]
    named = rows.select(*kept, digest(cfg).alias("part"), bucket.alias(name))
    # a few files for each folder rather than one from each task; large folders are split
    named.hint("rebalance", F.col("part"), F.col(name)).write.partitionBy("part", name).parquet(path)
    spark = rows.sparkSession
    try:
        back = spark.read.parquet(path).withColumn("_file", F.col("_metadata.file_path"))
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # no rows, so no folders
            return write, spark.createDataFrame([], "config string, bucket string, n long")
        raise
    found = back.groupBy(F.regexp_extract("_file", "/part=([^/]+)/", 1).alias("config"),
                         F.regexp_extract("_file", f"/{name}=([^/]+)/", 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return write, found


def folder(write: str, config: str, bucket: str, name: str = "bucket") -> str:
    return f"write={write}/part={config}/{name}={bucket}"


def write_version(rows: DataFrame, root: str, cfg: Sequence[str], version: str = "version") -> tuple[DataFrame | None, list[Record]]:
    """Store ``rows`` as the next version of each of their configurations; returns the stored
    rows with their version, and the records. Where another writer takes a number first, the
    rows are stored again, from what was written, under the next one."""
    spark = rows.sparkSession
    pending = rows.drop(version)
    schema = json.dumps(pending.schema.jsonValue())
    done: list[Record] = []
    for _ in range(ATTEMPTS):
        last = newest(spark, root)
        numbers = spark.createDataFrame([(c, r.version + 1) for c, r in last.items()], "_config string, _next long")
        numbered = (pending.withColumn("_at", digest(cfg)).join(numbers, F.col("_at") == F.col("_config"), "left")
                    .withColumn("_next", F.coalesce("_next", F.lit(1).cast("long"))).drop("_at", "_config"))
        write, found = put(numbered, root, cfg, F.col("_next"), version)
        missed = []
        for r in found.collect():
            where = folder(write, r.config, r.bucket, version)
            record = Record(r.config, int(r.bucket), write, {"": where}, schema, r.n)
            (done if commit(spark, root, record) else missed).append(record)
        if not missed:
            return read(spark, root, done, version), done
        pending = read(spark, root, missed, None)
    raise Conflict(f"others were ahead {ATTEMPTS} times: {[r.config for r in missed]}")


def read_newest(spark: SparkSession, root: str, version: str | None = "version") -> DataFrame | None:
    """Rows of the newest version of each configuration; None where nothing is stored."""
    return read(spark, root, list(newest(spark, root).values()), version)


def merge(batch: DataFrame, root: str, cfg: Sequence[str], keys: Sequence[str], buckets: int = 16,
          deal: Sequence[str] | None = None) -> int:
    """Add the rows of ``batch`` whose key (configuration and ``keys``) is not stored yet;
    returns how many rows were added. A stored row stays as it is, so a batch that is written
    again, after a retry or by two jobs, changes nothing; of rows of one key in the batch one
    stays, chosen by their values.

    Each configuration's rows lie in buckets by a hash of ``deal`` (by default the first key).
    Only buckets that get rows are written again; the new version takes the others' folders
    over. A writer that finds another one ahead merges anew with what that one stored.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in (deal or keys[:1])]), F.lit(buckets)).cast("string")
    names, everything = batch.columns, [*cfg, *keys]
    payload = [c for c in names if c not in everything]
    single = (batch.groupBy(*everything).agg(F.min(F.struct(*payload)).alias("_v")).select(*everything, "_v.*") if payload
              else batch.distinct()).select(*names)
    schema = json.dumps(batch.schema.jsonValue())
    # the batch is computed once, and put aside; buckets that are new consist of what lies there
    aside, found = put(single, root, cfg, bucket)
    asked = {(r.config, r.bucket): r.n for r in found.collect()}
    for _ in range(ATTEMPTS):
        last = newest(spark, root)
        there = [k for k in asked if k[0] in last and k[1] in last[k[0]].folders]
        fresh = {k: (folder(aside, *k), n) for k, n in asked.items() if k not in there}
        if there:
            old = {(c, b): Record(c, last[c].version, last[c].write, {b: last[c].folders[b]}, last[c].schema, 0) for c, b in there}
            stored = read(spark, root, list(old.values()), None)
            mine = spark.read.schema(batch.schema).parquet(*[f"{root}/{folder(aside, *k)}" for k in there])
            known = stored.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(everything)])
            same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(everything)])
            added = mine.join(known, same, "left_anti")
            got = {(r.config, r.bucket): r.n for r in added.groupBy(digest(cfg).alias("config"), bucket.alias("bucket")).agg(
                F.count(F.lit(1)).alias("n")).collect()}
            if got:
                before = read(spark, root, [old[k] for k in got], None)
                whole, _ = put(before.select(*names).unionByName(added), root, cfg, bucket)
                fresh |= {k: (folder(whole, *k), n) for k, n in got.items()}
        if not fresh:
            files.delete(spark, f"{root}/write={aside}")
            return 0
        if _commit_all(spark, root, last, aside, fresh, schema):
            return sum(n for _, n in fresh.values())
    raise Conflict(f"others were ahead {ATTEMPTS} times")


def _commit_all(spark: SparkSession, root: str, last: dict[str, Record], write: str, fresh: dict[tuple[str, str], tuple[str, int]], schema: str) -> bool:
    """Records of all configurations; False from the first that another writer is ahead at. Those
    committed before stay: a merge that is tried again finds their rows stored."""
    configs: dict[str, dict[str, tuple[str, int]]] = {}
    for (c, b), x in fresh.items():
        configs.setdefault(c, {})[b] = x
    for c, got in sorted(configs.items()):
        known = last.get(c)
        folders = {**(known.folders if known else {}), **{b: f for b, (f, _) in got.items()}}
        rows = (known.rows if known else 0) + sum(n for _, n in got.values())
        if not commit(spark, root, Record(c, known.version + 1 if known else 1, write, folders, schema, rows)):
            return False
    return True


def unreferenced(spark: SparkSession, root: str) -> list[str]:
    """Writes that no record names: of writers that crashed, or are still at work."""
    named = {r.f for r in records(spark, root).select(F.explode(F.map_values("folders")).alias("f")).select(
        F.regexp_extract("f", "^(write=[^/]+)", 1).alias("f")).distinct().collect()}
    return [x for x in files.children(spark, root) if x.startswith("write=") and x not in named]
