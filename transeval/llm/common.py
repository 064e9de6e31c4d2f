"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import tempfile
import unicodedata
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to a Python worker: whole texts are long, so batches
#: stay small enough for a worker's memory.
ARROW_ROWS = 512

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of the contracts: runs of digits, lower-case ASCII letters and everything
#: beyond ASCII, taken after lower-casing A-Z.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between such words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``ARROW_ROWS`` (never raise it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def buckets_for(spark: SparkSession, per_partition: int = 4, least: int = 64) -> int:
    """A power of two of at least ``per_partition`` buckets for each shuffle partition."""
    n = max(least, per_partition * shuffle_partitions(spark))
    return 1 << (n - 1).bit_length()


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, as ``spark.checkpoint.dir`` names it. Only a local
    session without that setting gets a scratch folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
    path = tempfile.mkdtemp(prefix="corpus-shared-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str, instead_of: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: the lineage ends
    here, and every machine can read the rows after others are lost. ``instead_of`` lists the
    folders of the tables before, which nothing needs once this one is whole: they are
    removed, and the list is the new folder's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if instead_of is not None:
        for old in instead_of:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        instead_of[:] = [path]
    return spark.read.schema(df.schema).parquet(path)


#: Code points up to which a pattern's classes reach: the regular-expression engine tests
#: classes of Latin-1 or of the basic plane by table, wider ones range by range.
LATIN, BASIC, ALL = 0xFF, 0xFFFF, sys.maxunicode


def reach(text: str) -> int:
    """The smallest of LATIN, BASIC and ALL that covers the text."""
    try:
        text.encode("latin-1")
        return LATIN
    except UnicodeEncodeError:
        return BASIC if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else ALL


def category_ranges(category: str, limit: int = ALL) -> str:
    """Character-class text of all code points up to ``limit`` whose general category starts
    so."""
    out, start = [], None
    for c in range(limit + 2):
        inside = c <= limit and unicodedata.category(chr(c)).startswith(category)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. A text of ASCII alone needs no table."""
    some = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(some) == F.length(some), F.lower(some)).otherwise(F.translate(some, UPPER, LOWER))


def words_of(norm: Column) -> Column:
    """The words of an already lower-cased text: splitting at what lies between is cheaper
    than collecting matches, and leaves empty strings only at the ends."""
    return F.array_remove(F.split(norm, BETWEEN_WORDS, -1), "")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the document id as text, modulo ``folds`` (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def training_sample(rows: DataFrame, text: str, columns: list[str], max_rows: int, max_chars: int) -> list:
    """At most ``max_rows`` rows of ``rows`` and ``max_chars`` characters of text in all,
    in the order of a hash of the row, on the driver: the bounded sample a classifier is
    fitted on. Rows whose text no longer fits are passed over, never cut."""
    order = F.xxhash64(*[F.col(c) for c in [*columns, text]])
    named = rows.filter(F.col(text).isNotNull()).select(*columns, text, order.alias("_order"))
    slim = named.select("_order", F.length(text).alias("_n")).orderBy("_order", "_n").limit(max_rows).collect()
    total, chosen = 0, []
    for r in slim:
        if total + r["_n"] <= max_chars:
            total += r["_n"]
            chosen.append((r["_order"],))
    if not chosen:
        return []
    spark = rows.sparkSession
    keys = F.broadcast(spark.createDataFrame(sorted(set(chosen)), "_order long"))
    return named.join(keys, "_order", "left_semi").dropDuplicates(["_order"]).orderBy("_order").limit(max_rows).collect()
