"""Command line over the end-to-end jobs (parquet in, parquet out).

    python -m transeval clean     --samples ROOT --target_lang Python --out OUT [--remove_prompt] [--debug_task ID]
                                  [--eofs MARK ...] [--rm-prefix-lines PREFIX ...] [--inplace] [--tree]
    python -m transeval check     --tasks T.parquet --samples S.parquet --compiled C.parquet --out OUT [--nsample N]
    python -m transeval evaluate  --exec_log L.parquet --samples S.parquet --tasks T.parquet --out OUT
                                  [--budget watchdog|strict] [--rerun] [--once]

``clean`` reads one configuration folder (``.../temperature_T/<task>/<idx><ext>``), or with
``--tree`` all that lie below ROOT; the other jobs read parquet tables with the configuration
columns. ``evaluate`` scores every run at once. It keeps verdicts as versions below OUT and
uses those of configurations that have some, unless ``--rerun`` asks for a new version. All
that is printed is stored as well: ``summary`` and ``compile_report`` by the other jobs;
``scores``, ``board``, ``problems`` and result documents beside the verdicts.

``SPARK_MASTER`` names a master for local use, ``--input_gb`` and ``--cores`` size partitions.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transeval import constants as K
from transeval import jobs
from transeval.operators.sanitize import sanitize_summary
from transeval.operators.verdict import tests_from_tasks
from transeval.session import get_session, partitions_as_text, scale_settings
from transeval.sources import samples as sm


def show(df: DataFrame) -> None:
    """All rows: a report has one for each configuration, or so."""
    df.show(df.count(), truncate=False)


def keep_and_show(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)
    show(df.sparkSession.read.schema(df.schema).parquet(path))


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="transeval")
    sub = ap.add_subparsers(dest="job", required=True)
    ap.add_argument("--input_gb", type=float, help="size of the input, from which partitions are sized")
    ap.add_argument("--cores", type=int, default=8)
    c = sub.add_parser("clean")
    c.add_argument("--samples", required=True)
    c.add_argument("--target_lang", required=True, choices=K.LANGUAGES)
    c.add_argument("--out", required=True)
    c.add_argument("--remove_prompt", action="store_true")
    c.add_argument("--debug_task", "--debug-task")
    c.add_argument("--eofs", nargs="+", default=K.DEFAULT_EOFS)
    c.add_argument("--rm-prefix-lines", dest="prefixes", nargs="+", default=K.DEFAULT_PREFIXES)
    c.add_argument("--inplace", action="store_true", help="keep the stage and path of the input")
    c.add_argument("--tree", action="store_true", help="ROOT holds many configurations")
    k = sub.add_parser("check")
    for a in ("--tasks", "--samples", "--compiled", "--out"):
        k.add_argument(a, required=True)
    k.add_argument("--nsample", type=int, default=1)
    e = sub.add_parser("evaluate")
    for a in ("--exec_log", "--samples", "--tasks", "--out"):
        e.add_argument(a, required=True)
    e.add_argument("--budget", choices=["watchdog", "strict"])
    e.add_argument("--rerun", "--re-run", action="store_true")
    e.add_argument("--once", action="store_true", help="compare equal outputs of a test once")
    args = ap.parse_args(argv)

    conf = scale_settings(int(args.input_gb * 2**30), args.cores) if args.input_gb else {}
    spark = get_session(master=os.environ.get("SPARK_MASTER"), conf=conf)
    cfg = sm.CFG
    if args.job == "clean":
        if args.tree:
            raw = sm.read_sample_tree(spark, args.samples, args.target_lang)
        else:
            raw = sm.read_samples(spark, args.samples, args.target_lang)
            raw = raw.select(*sm.parse_path(F.col("identifier"))[:len(cfg)], "identifier", "task_id", "completion_id", "solution")
        raw = raw.withColumn("path", F.regexp_extract("identifier", r"^(.*)/[^/]+/[^/]+$", 1))
        if args.debug_task:
            raw = raw.filter(F.col("task_id") == args.debug_task)
        cleaned, _ = jobs.clean(raw, cfg, remove_prompt=args.remove_prompt, eofs=args.eofs, prefixes=args.prefixes,
                                      inplace=args.inplace)
        if not args.inplace:
            cleaned = cleaned.withColumn("stage", F.lit("sanitized"))
        cleaned.write.mode("errorifexists").parquet(args.out)
        # the counts are those of what has been written
        counted = sanitize_summary(spark.read.schema(cleaned.schema).parquet(args.out), [x for x in cfg if x in cleaned.columns])
        keep_and_show(counted, args.out.rstrip("/") + "_summary")
    elif args.job == "check":
        with partitions_as_text(spark):
            tasks, samples, compiled = (spark.read.parquet(p) for p in (args.tasks, args.samples, args.compiled))
        rep, summary, comp = jobs.check(tasks, samples, compiled, cfg, args.nsample)
        rep.write.mode("errorifexists").parquet(os.path.join(args.out, "completeness"))
        keep_and_show(summary, os.path.join(args.out, "summary"))
        keep_and_show(comp, os.path.join(args.out, "compile_report"))
    else:
        with partitions_as_text(spark):
            tasks, samples, log = (spark.read.parquet(p) for p in (args.tasks, args.samples, args.exec_log))
        tests = tests_from_tasks(tasks, ("dataset", "task_id") if "dataset" in tasks.columns else ("task_id",))
        if "language" in tasks.columns:
            tasks = tasks.withColumnRenamed("language", "source_lang")
        run_cfg = [c for c in cfg if c in samples.columns]
        found = jobs.evaluate_into(args.out, samples, tasks, tests, log, run_cfg, budget=args.budget,
                                   rerun=args.rerun, once=args.once)
        show(found.problems)
        show(found.board)
    spark.stop()


if __name__ == "__main__":
    main()
