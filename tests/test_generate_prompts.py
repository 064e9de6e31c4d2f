import pytest
from pyspark.sql import functions as F

from transeval import constants as K
from transeval.operators import generate as gn
from transeval.operators import prompts as pr
from transeval.operators import registry as rg


def test_resume_golden(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "task_id string")
    existing = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 2), ("b", 3), ("c", 0), ("c", 2)],
                                     "task_id string, idx int")
    plan = gn.work_plan(tasks, existing, [], n_samples=4, batch_size=1)
    got = sorted((r.task_id, r.idx) for r in plan.collect())
    assert got == [("a", 2), ("a", 3), ("c", 2), ("c", 3)]        # count-based: c rewrites 2
    gap = gn.work_plan(tasks, existing, [], n_samples=4, batch_size=1, gap_fill=True)
    assert sorted((r.task_id, r.idx) for r in gap.collect()) == [("a", 2), ("a", 3), ("c", 1), ("c", 3)]
    batches = gn.work_plan(tasks.limit(1), existing.limit(0), [], n_samples=5, batch_size=2)
    assert sorted((r.idx, r.batch_no) for r in batches.collect()) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]


def test_stop_truncation_golden(spark):
    df = spark.createDataFrame([("ab</s>c<|endoftext|>",), ("x" * 12000,)], "s string")
    stops = F.array(F.lit("</s>"), F.lit("<|endoftext|>"))
    got = [r.o for r in df.select(pr.stop_truncate(F.col("s"), stops).alias("o")).collect()]
    assert got == ["ab", "x" * 10000]


def test_prompt_golden(spark):
    df = spark.createDataFrame([("base",), ("no-such",), ("gpt",)], "t string")
    got = [r.p for r in df.select(pr.compose_prompt(F.col("t"), F.lit("Java"), F.lit("Python"), F.lit("X")).alias("p")).collect()]
    base = 'Java:\nX\n\nTranslate the above Java code to Python and end with comment "<END-OF-CODE>".\n\nPython:\n'
    assert got[0] == base and got[1] == base
    assert got[2] == "You are a code translation expert. Translate the Java code below to Python\n\nJava\nX\n\nPython\n"
    assert K.PROMPT_TEMPLATES["dolphin"].endswith("```{trg}\n" + " " * 16)


def test_registry_lookup(spark):
    aliases = ["deepseek-coder-6.7b-instruct", "deepseek-coder-33.0b-base", "code-llama-13b", "code-llama-7",
               "GPT-4-turbo", "starcoder2-15b", "dolphin-2.6", "nope", "claude-3-opus"]
    df = spark.createDataFrame([(a,) for a in aliases], "model string")
    got = {r.model: (r.family, r.hub_name, r.conversational, r.registry_error) for r in rg.registry_lookup(df).collect()}
    assert got["deepseek-coder-6.7b-instruct"] == ("deepseek_instruct", "deepseek-ai/deepseek-coder-6.7b-instruct", True, None)
    assert got["deepseek-coder-33.0b-base"] == ("vllm", "deepseek-ai/deepseek-coder-33b-base", False, None)
    assert got["code-llama-13b"] == ("vllm", "codellama/CodeLlama-13b-Instruct-hf", False, None)
    assert got["code-llama-7"][3] == "Invalid model name: code-llama-7"
    assert got["GPT-4-turbo"] == ("openai", "gpt-4-turbo", True, None)
    assert got["starcoder2-15b"] == ("vllm", "bigcode/starcoder2-15b", False, None)
    assert got["dolphin-2.6"][0] == "chatml" and got["dolphin-2.6"][2] is True
    assert got["claude-3-opus"] == ("anthropic", "claude-3-opus", False, None)
    assert got["nope"] == (None, None, None, "Invalid model name: nope")


def test_greedy_and_validation(spark):
    runs = spark.createDataFrame([(True, 0.8, 4, 10, "codenet", "Java", "Python"), (False, 0.2, 4, 10, "x", "Java", "Rust")],
                                 "greedy boolean, temperature double, batch_size int, n_samples int, dataset string, "
                                 "source_lang string, target_lang string")
    g = rg.greedy_normalise(runs).orderBy(F.col("greedy").desc()).collect()
    assert (g[0].temperature, g[0].batch_size, g[0].n_samples, g[0].greedy_forced) == (0.0, 1, 1, True)
    assert (g[1].temperature, g[1].greedy_forced) == (0.2, False)
    errs = [r.run_error for r in rg.validate_runs(runs).orderBy(F.col("greedy").desc()).collect()]
    assert errs == [None, "invalid dataset: x"]


def test_generate_with_a_text_function(spark):
    plan = spark.createDataFrame([("t1", 0, "P1:"), ("t2", 0, "P2:")], "task_id string, idx int, prompt string")
    out = gn.generate(plan, lambda prompts: [p.lower() + "\tx</s>tail" for p in prompts])
    fam = out.withColumn("family", F.lit("hf")).withColumn("conversational", F.lit(False))
    got = {r.task_id: r.solution for r in gn.finish_outputs(fam).collect()}
    assert got == {"t1": "P1:p1:\tx", "t2": "P2:p2:\tx"}
    vl = gn.finish_outputs(out.withColumn("family", F.lit("vllm")).withColumn("conversational", F.lit(True)))
    assert sorted(r.solution for r in vl.collect()) == ["p1:    x", "p2:    x"]

    def broken(_):
        raise RuntimeError("down")
    sent = gn.generate(plan, broken, sentinel=K.GEMINI_ERROR)
    assert {r.output for r in sent.collect()} == {K.GEMINI_ERROR}
    with pytest.raises(Exception):
        gn.generate(plan, lambda p: [], materialise=False).collect()


def test_budget_rules(spark):
    df = spark.createDataFrame([("vllm", 100000, 1000), ("hf", 2048, 1500), ("santacoder", 2048, 1000),
                                ("santacoder", 2048, 2048)], "family string, tok int, ptok int")
    ctx = gn.context_window(F.col("family"), F.col("tok"), F.lit(None), F.lit(8192))
    got = df.select(ctx.alias("ctx"), gn.token_budget(F.col("family"), F.lit(1024), ctx, F.col("ptok")).alias("b"),
                    gn.over_length(F.col("family"), ctx, F.col("ptok")).alias("o")).collect()
    assert [(r.ctx, r.b, r.o) for r in got] == [(8192, 1024, False), (2048, 548, False), (2048, 943, False), (2048, 0, True)]


def test_chat_and_json(spark):
    df = spark.createDataFrame([('{"code": "y=2"}', "P"), ("not json", "P"), ('{"other": 1}', "P")], "c string, p string")
    got = [r.o for r in df.select(pr.json_reply(F.col("c"), F.col("p")).alias("o")).collect()]
    assert got == ["P\ny=2", "not json", '{"other": 1}']
    m = spark.range(1).select(pr.chat_messages(F.lit("hi"), F.lit(True)).alias("m")).first().m
    assert [(x.role, x.content) for x in m] == [("system", K.ASSISTANT_SYSTEM_JSON), ("user", "hi")]


def test_every_registry_rule(spark):
    probes = []
    for kind, pattern, family, hub, conv in K.REGISTRY_RULES:
        alias = pattern if kind == "exact" else {"gpt-3.5-": "gpt-3.5-turbo", "gpt-4": "gpt-4", "claude": "claude-3",
                                                 "gemini": "gemini-pro", "starcoder": "starcoder2-3b",
                                                 "code-llama-": "code-llama-34b",
                                                 "deepseek-coder": "deepseek-coder-1.3b-base"}[pattern]
        probes.append((alias, kind, pattern, family, hub, conv))
    df = spark.createDataFrame([(p[0],) for p in probes], "model string")
    got = {r.model: r for r in rg.registry_lookup(df).collect()}
    for alias, kind, pattern, family, hub, conv in probes:
        r = got[alias]
        assert r.registry_error is None, alias
        if family == "deepseek":
            assert (r.family, r.hub_name, r.conversational) == ("vllm", "deepseek-ai/deepseek-coder-1.3b-base", False)
            continue
        assert r.family == family and r.conversational == conv, alias
        if hub is None:
            assert r.hub_name == alias
        elif "{alias}" in hub:
            assert r.hub_name == "bigcode/" + alias
        elif "{last}" in hub:
            assert r.hub_name == "codellama/CodeLlama-34b-Instruct-hf"
        else:
            assert r.hub_name == hub
