"""DuckDB SQL twins of the registered queries (same tables, same column names).

The SQL is written out per query; small Python helpers only paste in shared pieces
(the table bindings of ``transeval.sources.bindings`` and Python-exact string helpers).
"""

from __future__ import annotations

import re as _re

from transeval import constants as K
from transeval.functions.text import LINE_BREAK_CHARS, PY_WHITESPACE
from transeval.sources.bindings import (ALIASES, BUDGET_FAMILIES, LANG_MAP, REPLY_MODELS, TEST_ORDER,
                                        TOKENIZER_LIMITS, VERDICT_OF_EVENT)

ORACLE: dict[str, str] = {}


def chars(s: str) -> str:
    """SQL expression for an arbitrary string: printable runs quoted, others via chr()."""
    parts, run = [], ""
    for ch in s:
        if ch.isprintable() and ch != "'" and ord(ch) < 0x80:
            run += ch
        else:
            if run:
                parts.append(f"'{run}'")
                run = ""
            parts.append(f"chr({ord(ch)})")
    if run:
        parts.append(f"'{run}'")
    return "(" + " || ".join(parts) + ")" if parts else "''"


WS = chars(PY_WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def lit(s: str) -> str:
    return chars(s)


# ------------------------------------------------------------------ bindings
def lang_case(col: str) -> str:
    whens = " ".join(f"when '{a}' then '{b}'" for a, b in LANG_MAP)
    return f"(case {col} {whens} else 'C' end)"


BT = f"""bt as (select cast(doc_id as varchar) as task_id, {lang_case('lang')} as language,
                text as code, source, doc_id from documents)"""

BS = """bs as (select cast(conv_id as varchar) as task_id, cast(turn as varchar) as completion_id,
                cast(turn as integer) as completion_idx,
                cast(conv_id as varchar) || '/' || cast(turn as varchar) || '.py' as identifier,
                text as solution, conv_id
         from conversations where role = 'assistant')"""

BS_TASKS = "bs_tasks as (select distinct cast(conv_id as varchar) as task_id from conversations)"

_EV = " ".join(f"when '{a}' then '{b}'" for a, b in VERDICT_OF_EVENT)
BV = f"""bv as (select cast(user_id as varchar) as task_id, cast(event_id as varchar) as completion_id,
                case when value < 1.0 then null else (case event_type {_EV} end) end as verdict,
                event_id, user_id, ts, props, value from events)"""

BC = """bc as (select c.c_mktsegment as model, cast(o.o_custkey as varchar) as task_id,
                cast(o.o_orderkey as varchar) as completion_id,
                case when o.o_orderstatus = 'F' then 'success' else 'test_failed' end as verdict
         from orders o join customer c on o.o_custkey = c.c_custkey)"""


def _expected(key: str, idx: str) -> str:
    v = f"(({key} * 31 + {idx} * 17) % 100000)"
    return (f"(case when {key} % 10 = 3 then '0.000000000000000000000' || lpad(cast({v} as varchar), 5, '0') "
            f"else cast(cast(floor({v} / 100) as bigint) as varchar) || '.' || lpad(cast({v} % 100 as varchar), 2, '0') end)")


_ORDER = ", ".join(f"l.{c}" for c in TEST_ORDER)
BX_ROWS = f"""bx_rows as (
  select o.o_custkey, l.l_orderkey,
         cast(o.o_custkey as varchar) as task_id, cast(l.l_orderkey as varchar) as completion_id,
         cast(row_number() over (partition by l.l_orderkey order by {_ORDER}) - 1 as integer) as test_idx,
         o.o_orderpriority <> '5-LOW' as compile_ok, l.l_tax = 0.08 as timed_out, l.l_quantity as elapsed_s,
         case when l.l_linestatus = 'F' then '' else 'Traceback: error' end as stderr,
         cast(round(l.l_discount * 100) as integer) as variant
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey)"""

_EXP = _expected("o_custkey", "test_idx")
_WHOLE = "cast(floor(((o_custkey * 31 + test_idx * 17) % 100000) / 100) as bigint)"
BX_LOG = f"""bx_log as (
  select *, case variant
      when 1 then {_EXP} || chr(10)
      when 2 then {_EXP} || '3'
      when 3 then cast({_WHOLE} as varchar)
      when 4 then cast({_WHOLE} + 1 as varchar)
      when 5 then {_EXP} || '9'
      when 6 then 'Error: ' || {_EXP}
      when 7 then '  ' || {_EXP} || '  '
      when 8 then '-' || {_EXP}
      when 9 then replace({_EXP}, '.', ',')
      when 10 then left({_EXP}, length({_EXP}) - 1)
      else case when test_idx % 2 = 0 then {_EXP} || '5' else {_EXP} end end as stdout
  from bx_rows)"""
BX_TESTS = f"""bx_tests as (select cast(o_custkey as varchar) as task_id, cast(i as integer) as test_idx, '' as input,
  {_expected("o_custkey", "i")} as expected
  from (select o_custkey, unnest(range(max(test_idx) + 1)) as i from bx_rows group by o_custkey))"""
BX_CMP = """bx_cmp as (select l.*, t.expected from bx_log l left join bx_tests t
  on l.task_id = t.task_id and l.test_idx = t.test_idx)"""

_DIG = "[0-9](?:_?[0-9])*"
_NUM = f"^[+-]?(?:{_DIG}(?:\\.(?:{_DIG})?)?|\\.{_DIG})(?:[eE][+-]?{_DIG})?$"


def parse_number(x: str) -> str:
    s = strip(x)
    v = f"try_cast(replace({s}, '_', '') as double)"
    return f"(case when regexp_matches({s}, '{_NUM}') and isfinite({v}) then {v} end)"


def decimals(x: str) -> str:
    s = strip(x)
    return f"(case when strpos({s}, '.') > 0 then length(split_part({s}, '.', 2)) end)"


def outputs_match(a: str, b: str) -> str:
    """Rounding is by the text that the correctly rounding formatter writes."""
    x, y = parse_number(a), parse_number(b)
    da, db = decimals(a), decimals(b)
    m = f"least({da}, {db})"
    return f"""(case when {x} is not null and {x} % 1 = 0 then coalesce({x} = {y} - {y} % 1, false)
       when {x} is not null and {y} is not null and {da} is not null and {db} is not null
         then format('{{:.{{}}f}}', {x}, {m}) = format('{{:.{{}}f}}', {y}, {m})
       else coalesce({strip(a)} = {strip(b)}, false) end)"""


OUTCOME = f"""(case when not compile_ok then 'compile_failed'
       when timed_out then 'infinite_loop'
       when {outputs_match('stdout', 'expected')} then 'success'
       when stderr = '' then 'test_failed' else 'runtime_failed' end)"""

BX_OUT = f"bx_out as (select *, {OUTCOME} as outcome from bx_cmp)"
BX = ",\n".join([BX_ROWS, BX_LOG, BX_TESTS, BX_CMP, BX_OUT])


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def oracle(name: str):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


# ------------------------------------------------------------------ metrics
def _pass_at_k(n: str, c: str, k: str) -> str:
    return f"""(case when {n} - {c} < {k} then 1.0::double when {c} = 0 then 0.0::double
      else 1.0::double - list_reduce(list_prepend(1.0::double, list_transform(generate_series(0, {k} - 1),
           lambda j: ({n} - {c} - j)::double / ({n} - j)::double)), lambda a, b: a * b) end)"""


_TASK_COUNTS = """counts as (select task_id, count(*) as n,
       count(*) filter (where verdict is not distinct from 'success') as c from bv group by task_id)"""
_KS = "ks as (select unnest([1, 5]) as k)"

ORACLE["pass_at_k_task"] = with_(BV, _TASK_COUNTS, _KS) + f"""
select task_id, cast(k as integer) as k, n, c, round({_pass_at_k('n', 'c', 'k')}, 6) as pass_at_k
from counts cross join ks"""

ORACLE["pass_at_k_fixed_n"] = with_(BV, _TASK_COUNTS, _KS) + f"""
select task_id, cast(k as integer) as k, cast(100 as bigint) as n, c, round({_pass_at_k('100', 'c', 'k')}, 6) as pass_at_k
from counts cross join ks"""

ORACLE["pass_at_k"] = with_(BC, _KS) + f"""
, counts as (select model, task_id, count(*) as n,
       count(*) filter (where verdict is not distinct from 'success') as c from bc group by model, task_id),
scores as (select model, k, n, {_pass_at_k('n', 'c', 'k')} as p from counts cross join ks)
select model, cast(k as integer) as k, count(*) as n_tasks, min(n) as min_n, round(avg(p), 6) as pass_at_k
from scores group by model, k having min(n) >= k"""

ORACLE["score_label"] = with_(BV, _TASK_COUNTS, _KS) + f"""
, scores as (select k, n, {_pass_at_k('n', 'c', 'k')} as p from counts cross join ks),
board as (select k, count(*) as n_tasks, min(n) as min_n, avg(p) as p from scores group by k having min(n) >= k)
select cast(k as integer) as k, n_tasks, min_n, 'pass @ ' || k || ' :' || chr(9) || format('{{:.3f}}', p) as label from board"""

ORACLE["date_label"] = with_(BV) + """
select task_id, strftime(max(ts), '%Y-%m-%d %H:%M') as date from bv group by task_id"""

ORACLE["verdict_label"] = with_(BV) + """
select completion_id, cast(event_id % 7 as integer) as code,
       case cast(event_id % 7 as integer) when 0 then 'success' when 1 then 'runtime_failed'
            when 2 then 'compile_failed' when 3 then 'infinite_loop' when 4 then 'test_failed' end as label
from bv"""

# ------------------------------------------------------------------ verdicts
ORACLE["test_compare"] = with_(BX) + "select task_id, completion_id, test_idx, stdout, expected from bx_cmp"
ORACLE["numeric_match"] = with_(BX) + f"select completion_id, test_idx, {outputs_match('stdout', 'expected')} as matched from bx_cmp"
ORACLE["text_match"] = with_(BX) + f"select completion_id, test_idx, {strip('stdout')} = {strip('expected')} as text_equal from bx_cmp"
ORACLE["test_outcome"] = ORACLE["test_outcome_once"] = with_(BX) + "select completion_id, test_idx, outcome from bx_out"

_SAMPLE = """sv as (select task_id, completion_id, max(case when not compile_ok then 1 else 0 end) as cfail,
       count(test_idx) as n_tests,
       min(test_idx) filter (where outcome <> 'success') as first_fail_idx,
       arg_min(outcome, test_idx) filter (where outcome <> 'success') as ff
  from bx_out group by task_id, completion_id)"""
_IDX = "case when cfail = 0 then cast(first_fail_idx as integer) end"
_VERDICT = "case when cfail = 1 then 'compile_failed' when n_tests = 0 then null else coalesce(ff, 'success') end"

ORACLE["first_failure"] = with_(BX, _SAMPLE) + f"select completion_id, {_IDX} as first_fail_idx, {_VERDICT} as verdict from sv"
ORACLE["sample_verdict"] = with_(BX, _SAMPLE) + f"select task_id, completion_id, n_tests, {_VERDICT} as verdict from sv"
ORACLE["attempted_tests"] = with_(BX) + """
, ff as (select task_id, completion_id, min(test_idx) filter (where outcome <> 'success') as fi, bool_and(compile_ok) as compiled
         from bx_out group by task_id, completion_id)
select o.completion_id, o.test_idx, o.outcome from bx_out o join ff using (task_id, completion_id)
where ff.compiled and o.test_idx is not null and (ff.fi is null or o.test_idx <= ff.fi)"""

ORACLE["budget_verdict"] = with_(BX) + f"""
, z as (select *, sum(cast(elapsed_s as decimal(28, 9))) over (partition by task_id, completion_id order by test_idx
                  rows between unbounded preceding and current row) as el from bx_out),
a as (select completion_id, max(case when not compile_ok then 1 else 0 end) as cfail,
        arg_min(outcome, test_idx) filter (where outcome <> 'success') as ff,
        count(*) filter (where el <= {K.SAMPLE_BUDGET_S}) as n_within,
        arg_min(outcome, test_idx) filter (where outcome <> 'success' and el <= {K.SAMPLE_BUDGET_S}) as ffw,
        arg_min(case when el > {K.SAMPLE_BUDGET_S} then 'infinite_loop' else outcome end, test_idx)
            filter (where outcome <> 'success' or el > {K.SAMPLE_BUDGET_S}) as ffs
      from z group by task_id, completion_id)
select completion_id,
       case when cfail = 1 then 'compile_failed' else coalesce(ff, 'success') end as verdict,
       case when cfail = 1 then 'compile_failed' when n_within = 0 then null else coalesce(ffw, 'success') end as verdict_watchdog,
       case when cfail = 1 then 'compile_failed' else coalesce(ffs, 'success') end as verdict_strict
from a"""


# ------------------------------------------------------------------ sanitizer

_TAG = "(case when lower(language) = 'c++' then 'cpp' else lower(language) end)"
_MODELS = "[" + ", ".join(f"'{m}'" for m in REPLY_MODELS) + "]"
REPLIES = f"""replies as (select task_id, doc_id, language as target_lang,
    case when doc_id % 2 = 0 then 'Here is the code.' || chr(10) || language || ':' || chr(10) || language
         || chr(10) || '@@ Response' || chr(10) || 'Answer:' || chr(10) || 'Output:' || chr(10) || '```' || {_TAG}
         || chr(10) || code || chr(10) || '```' || chr(10) || 'Note: end' else code end as solution,
    'translations/codenet/' || {_MODELS}[cast(doc_id % 10 as integer) + 1] || '/Java/' || language || '/temperature_0.2' as path
  from bt)"""
NL = "chr(10)"
BREAKS = "'\\r\\n|[" + "".join("\\x{%x}" % ord(c) for c in LINE_BREAK_CHARS) + "]'"
BREAKS = BREAKS.replace("\\r\\n", "' || chr(13) || chr(10) || '")


def lstrip_(x):
    return f"ltrim({x}, {WS})"


def find_(s, m):
    return f"(strpos({s}, {m}) - 1)"


def after_first_(s, m):
    return f"substring({s}, {find_(s, m)} + length({m}) + 1)"


def before_first_(s, m):
    return f"(case when strpos({s}, {m}) > 0 then left({s}, strpos({s}, {m}) - 1) else left({s}, greatest(length({s}) - 1, 0)) end)"


def strip_marker_(s, lang):
    m, p = f"({lang} || ':' || {NL})", f"({lang} || ':')"
    first = after_first_(s, m)
    n = f"greatest(cast((length({first}) - length(replace({first}, {p}, ''))) // length({p}) as integer), 1)"
    ws = f"(length(acc) - length({lstrip_('acc')}))"
    chop = f"((cast(floor({ws} / length({p})) as bigint) + 1) * length({p}))"
    cut = f"(case when strpos(acc, {m}) > 0 then {after_first_('acc', m)} else substring(acc, {chop} + 1) end)"
    step = f"(case when starts_with({strip('acc')}, {p}) then {cut} else acc end)"
    return f"list_reduce(list_prepend({first}, list_transform(range({n}), lambda i: '')), lambda acc, x: {step})"


def second_part_(s, d):
    return strip(f"split_part({s}, {d}, 2)")


def deepseek_marker_(s, lang):
    return (f"('```' || (case when lower({lang}) = 'c++' and contains({s}, '```c++') then 'c++' "
            f"when lower({lang}) = 'c++' and contains({s}, '```cpp') then 'cpp' else lower({lang}) end))")


def fence_extract_(s, marker):
    return before_first_(after_first_(s, marker), "'```'")


def line_pos_(s, lang):
    hit = f"(strpos({NL} || {s} || {NL}, {NL} || {lang} || {NL}) - 1)"
    return f"(case when {hit} >= 0 then {hit} + length({lang}) + 1 else -1 end)"


def after_line_(s, lang):
    return strip(f"substring({s}, {line_pos_(s, lang)} + 1)")


def fence_remove_(s, lang):
    return strip(f"replace(replace({s}, '```' || lower({lang}), ''), '```', '')")


def drop_prefixes_(s, prefixes):
    start = strip(f"regexp_replace({s}, {BREAKS}, {NL}, 'g')")
    plist = "[" + ", ".join(lit(p) for p in prefixes) + "]"
    drop = f"array_to_string(list_filter(string_split(acc, {NL}), lambda l: not starts_with(l, p)), {NL})"
    step = f"(case when starts_with(acc, p) or contains(acc, {NL} || p) then {strip(drop)} else acc end)"
    return f"list_reduce(list_prepend({start}, {plist}), lambda acc, p: {step})"


def truncate_(s, eofs):
    elist = "[" + ", ".join(lit(e) for e in eofs) + "]"
    return f"list_reduce(list_prepend({s}, {elist}), lambda acc, e: {strip('split_part(acc, e, 1)')})"


_DELIM = "(case when doc_id % 3 = 0 then '@@ Response' when doc_id % 3 = 1 then 'Answer:' else target_lang || ':' end)"
ORACLE["strip_marker"] = with_(BT, REPLIES) + f"select task_id, {strip_marker_('solution', 'target_lang')} as solution from replies"
ORACLE["strip_second_part"] = with_(BT, REPLIES) + f"""
select task_id, case when strpos(solution, {_DELIM}) > 0 then {second_part_('solution', _DELIM)} end as solution,
       case when strpos(solution, {_DELIM}) = 0 then 'IndexError' end as sanitize_error from replies"""
ORACLE["strip_optional_part"] = with_(BT, REPLIES) + f"""
select task_id, case when strpos(solution, 'Output:') > 0 then {second_part_('solution', "'Output:'")} else solution end as solution
from replies"""
_FM = f"(case when doc_id % 4 < 2 then '```' || {_TAG.replace('language', 'target_lang')} else {deepseek_marker_('solution', 'target_lang')} end)"
ORACLE["fence_extract"] = with_(BT, REPLIES) + f"select task_id, {fence_extract_('solution', _FM)} as solution from replies"
ORACLE["after_language_line"] = with_(BT, REPLIES) + f"""
select task_id, case when {line_pos_('solution', 'target_lang')} >= 0 then {after_line_('solution', 'target_lang')} end as solution,
       case when {line_pos_('solution', 'target_lang')} < 0 then 'ValueError' end as sanitize_error from replies"""
ORACLE["fence_remove"] = with_(BT, REPLIES) + f"select task_id, {fence_remove_('solution', 'target_lang')} as solution from replies"
ORACLE["drop_prefix_lines"] = with_(BT, REPLIES) + f"select task_id, {drop_prefixes_(strip('solution'), K.DEFAULT_PREFIXES)} as solution from replies"
ORACLE["truncate_at_marker"] = with_(BT, REPLIES) + f"select task_id, {truncate_(strip('solution'), K.DEFAULT_EOFS)} as solution from replies"


def _sanitize_sql(source: str) -> str:
    """The cleaning job as a chain of CTEs (one per stage, as in the Spark job)."""
    trig = dict(K.SANITIZE_TRIGGERS)

    def on(rule):
        return "(" + " or ".join(f"contains(p, '{n}')" for n in trig[rule]) + ")"

    steps = [f"s0 as (select task_id, doc_id, target_lang as lang, path || '{K.SANITIZED_SUFFIX}' as p, solution as s, "
             f"cast(null as varchar) as err from {source})"]

    def stage(i, cond, value, err=None, label="IndexError"):
        if err is None:
            steps.append(f"s{i} as (select task_id, doc_id, lang, p, case when err is null and {cond} then {value} else s end as s, err from s{i-1})")
        else:
            steps.append(f"s{i} as (select task_id, doc_id, lang, p, "
                         f"case when err is null and {cond} and not ({err}) then {value} else s end as s, "
                         f"case when err is null and {cond} and ({err}) then '{label}' else err end as err from s{i-1})")

    stage(1, on("strip_marker"), strip_marker_("s", "lang"))
    stage(2, on("magicoder"), second_part_("s", "'@@ Response'"), "strpos(s, '@@ Response') = 0")
    stage(3, on("octocoder"), second_part_("s", "'Answer:'"), "strpos(s, 'Answer:') = 0")
    stage(4, on("mixtral"), second_part_("s", "lang || ':'"), "strpos(s, lang || ':') = 0")
    stage(5, on("phi2") + " and strpos(s, 'Output:') > 0", second_part_("s", "'Output:'"))
    stage(6, on("gpt_fence"), fence_extract_("s", "'```' || " + _TAG.replace("language", "lang")))
    stage(7, on("gemini"), after_line_("s", "lang"), f"{line_pos_('s', 'lang')} < 0", "ValueError")
    stage(8, on("claude"), after_line_("s", "lang"), f"{line_pos_('s', 'lang')} < 0", "ValueError")
    stage(9, on("deepseek_fence"), fence_extract_("s", deepseek_marker_("s", "lang")))
    steps.append(f"s10 as (select task_id, doc_id, lang, p, {fence_remove_('s', 'lang')} as s, err from s9)")
    steps.append(f"s11 as (select task_id, doc_id, lang, p, {drop_prefixes_('s', K.DEFAULT_PREFIXES)} as s, err from s10)")
    steps.append(f"s12 as (select task_id, doc_id, lang, p, {truncate_('s', K.DEFAULT_EOFS)} as s, err from s11)")
    return ",\n".join(steps)


ORACLE["sanitize_full"] = with_(BT, REPLIES, _sanitize_sql("replies")) + f"""
select task_id, case when err is null then {strip('s')} end as solution, err as sanitize_error, p as out_path from s12"""
ORACLE["sanitize_one_task"] = with_(BT, REPLIES) + """, pick as (select arg_max(task_id, struct_pack(a := length(solution), b := doc_id)) as task_id from replies),
one as (select * from replies where task_id in (select task_id from pick)),
""" + _sanitize_sql("one") + f"""
select task_id, case when err is null then {strip('s')} end as solution, err as sanitize_error from s12"""


# ------------------------------------------------------------------ checker and integrity
ORACLE["samples_per_task"] = with_(BS) + "select task_id, count(*) as n_files from bs group by task_id"
ORACLE["sample_reindex"] = with_(BS) + """
select task_id, completion_id, row_number() over (partition by task_id order by completion_idx) - 1 as idx,
       cast(row_number() over (partition by task_id order by completion_idx) - 1 as varchar) || '.py' as file_name
from bs"""
ORACLE["integrity_checks"] = with_(BV) + """
, s as (select count(*) as n_rows, count(distinct completion_id) as n_identifiers, count(distinct task_id) as n_sampled_tasks from bv),
t as (select count(distinct task_id) as n_tasks from bv),
u as (select count(*) as n_unfinished from (select completion_id from bv except all select completion_id from bv where verdict is not null))
select n_rows, n_identifiers, n_sampled_tasks, n_tasks, n_unfinished,
       n_rows = n_identifiers as no_duplicates, n_sampled_tasks = n_tasks as all_tasks_sampled, n_unfinished = 0 as all_finished
from s, t, u"""
ORACLE["sample_task_join"] = with_(BS, BT) + """
select bs.task_id, bs.completion_id, bt.language, cast(length(bt.code) as integer) as code_chars from bs join bt on bs.task_id = bt.task_id"""
ORACLE["missing_tasks"] = with_(BS, BT) + "select task_id, language from bt where task_id not in (select task_id from bs)"
ORACLE["solution_fallback"] = with_(BS, BT) + """
select bs.task_id, bs.completion_id, coalesce(case when bs.completion_idx = 1 then null else bs.solution end, bt.code) as solution
from bs left join bt on bs.task_id = bt.task_id"""
_COMPLETE = """counts as (select task_id, count(*) as n_files from bs group by task_id),
exp as (select greatest(cast(2 as bigint), max(n_files)) as expected from counts),
rep as (select t.task_id, coalesce(c.n_files, 0) as n_files, exp.expected,
          case when coalesce(c.n_files, 0) = 0 then 'missing' when c.n_files = exp.expected then 'complete' else 'short' end as status
        from bs_tasks t left join counts c on t.task_id = c.task_id, exp)"""
ORACLE["completeness"] = with_(BS, BS_TASKS, _COMPLETE) + "select task_id, n_files, expected, status from rep"
ORACLE["completeness_summary"] = with_(BS, BS_TASKS, _COMPLETE) + """
select count(*) as n_tasks, count(*) filter (where status = 'complete') as n_done,
       count(*) filter (where status <> 'complete') as n_incomplete,
       count(*) filter (where status = 'missing') as n_missing, count(*) filter (where status = 'short') as n_short
from rep"""
ORACLE["compile_report"] = with_(BT) + f"""
, j as (select bt.language, case when bt.doc_id % 17 <> 0 then bt.code end as code, l.quality = 1 as ok from bt left join labels l on bt.doc_id = l.doc_id),
f as (select language, code is null or {strip('code')} = '' as empty, ok from j),
n as (select language, count(*) as n_code, count(*) filter (where empty or ok is false) as n_wrong,
             count(*) filter (where not empty and ok is null) as n_unchecked from f group by language)
select language, n_code, n_wrong, n_unchecked, cast(format('{{:.2f}}', n_wrong / n_code * 100) as double) as pct_wrong from n"""
ORACLE["evaluate_run"] = with_(BX) + f"""
, s as (select c.c_mktsegment as model, cast(o.o_custkey as varchar) as task_id, cast(o.o_orderkey as varchar) as completion_id, o.o_orderkey
        from orders o join customer c on o.o_custkey = c.c_custkey),
z as (select b.*, sum(cast(elapsed_s as decimal(28, 9))) over (partition by b.task_id, b.completion_id order by test_idx
                  rows between unbounded preceding and current row) as el
      from bx_out b join s on b.task_id = s.task_id and b.completion_id = s.completion_id and s.o_orderkey % 11 <> 0),
a as (select task_id, completion_id, not bool_and(compile_ok) as cfail, count(*) as n, max(el) as total,
        arg_min(outcome, test_idx) filter (where outcome <> 'success' and el <= {K.SAMPLE_BUDGET_S}) as ff,
        count(*) filter (where el <= {K.SAMPLE_BUDGET_S}) as n_within from z group by task_id, completion_id),
planned as (select task_id, count(*) as n from bx_tests group by task_id),
v as (select s.model, s.task_id, s.completion_id,
        case when a.n is null then null when cfail then 'compile_failed' when ff is not null then ff when n_within = 0 then null
             when a.n < planned.n and a.total <= {K.SAMPLE_BUDGET_S} then null else 'success' end as verdict
      from s left join a using (task_id, completion_id) left join planned on planned.task_id = s.task_id),
missing as (select c_mktsegment as model, count(*) as n_problems from customer
            where c_mktsegment in ('BUILDING', 'MACHINERY') and c_custkey not in (select o_custkey from orders) group by c_mktsegment),
t as (select model, task_id, count(*) as n, count(*) filter (where verdict = 'success') as c from v group by model, task_id),
b as (select model, round(avg(c / n), 6) as p from t where model not in (select model from missing) group by model)
select v.model, count(*) as n_samples, count(*) filter (where verdict is null) as n_unknown, count(*) filter (where verdict = 'success') as n_success,
       coalesce(any_value(missing.n_problems), 0) as n_problems, any_value(b.p) as pass_at_1
from v left join missing on v.model = missing.model left join b on v.model = b.model group by v.model"""

# ------------------------------------------------------------------ result records
ORACLE["verdict_array"] = with_(BV) + """
select task_id, completion_id, row_number() over (partition by task_id order by completion_id) - 1 as pos,
       count(*) over (partition by task_id) as nfiles, verdict from bv"""
ORACLE["result_document"] = with_(BV) + """
, p as (select task_id, completion_id, verdict, row_number() over (partition by task_id order by completion_id) - 1 as pos,
               count(*) over (partition by task_id) as nfiles from bv)
select task_id, pos // 10000 as part, any_value(nfiles) as nfiles, string_agg(coalesce(verdict, 'null'), ',' order by pos) as base
from p group by task_id, pos // 10000"""
ORACLE["cached_eval"] = with_(BV) + """
, v as (select *, cast(cast(ts as date) as varchar) as run_day from bv),
cached as (select * from v where ts < timestamp '2024-01-16 00:00:00')
select run_day, task_id, completion_id, 'cached' as state, verdict from cached
union all
select run_day, task_id, completion_id, 'pending' as state, cast(null as varchar) as verdict from v
where run_day not in (select distinct run_day from cached)"""
ORACLE["legacy_results"] = with_(BV) + "select task_id, cast(count(*) as integer) as nfiles from bv group by task_id"
ORACLE["latest_version"] = with_(BV) + """
, l as (select task_id, json_extract_string(props, '$.k') as k, case when event_id % 13 = 0 then 'flaky' else verdict end as verdict,
               event_id + 1152921504606846976 as version from bv)
select task_id, k, count(*) as n_versions, arg_max({'v': verdict}, version).v as verdict, max(version) as version
from l group by task_id, k"""

# ------------------------------------------------------------------ scans and paths
ORACLE["task_scan"] = with_(BT) + "select task_id, language from bt where language = 'Python'"
_EXT = " ".join(f"when '{a}' then '{b}'" for a, b in K.EXTENSIONS.items())
ORACLE["extension_map"] = with_(BT) + f"select task_id, language, case language {_EXT} end as ext from bt"
ORACLE["class_rename"] = with_(BT) + """
select task_id, regexp_replace('public class Main {' || chr(10) || code || chr(10) || '}' || chr(10) || 'class  Helper_2 {}',
       '\\bclass\\s+\\w+', 'class ' || task_id, 'g') as code from bt"""
_PMODELS = "[" + ", ".join(f"'{m}'" for m in REPLY_MODELS) + "]"
ORACLE["path_parse"] = with_(BS) + f"""
, p as (select 'translations/' || case when conv_id % 2 = 0 then 'codenet' else 'avatar' end || '/'
          || {_PMODELS}[cast(conv_id % 10 as integer) + 1] || '/Java/Python/temperature_0.2'
          || case when completion_idx % 4 = 3 then '-sanitized' else '' end || '/' || replace(task_id, '/', '_') || '/'
          || cast(completion_idx as varchar) || '.py' as identifier from bs)
select identifier, split_part(identifier, '/', 2) as dataset, split_part(identifier, '/', 3) as model,
       split_part(identifier, '/', 4) as source_lang, split_part(identifier, '/', 5) as target_lang,
       regexp_extract(split_part(identifier, '/', 6), 'temperature_(.+?)(-sanitized)?$', 1) as temperature,
       case when ends_with(split_part(identifier, '/', 6), '-sanitized') then 'sanitized' else 'raw' end as stage,
       split_part(identifier, '/', 7) as task_id, split_part(split_part(identifier, '/', 8), '.', 1) as completion_id
from p"""


# ------------------------------------------------------------------ prompts, registry, generation


_PTYPES = [*K.PROMPT_TEMPLATES, "no-such-type"]
_FIMF = ["incoder", "codegen2", "santacoder", "starcoder_infill", "hf"]


def pick_(values, idx):
    arr = "[" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + "]"
    return f"{arr}[cast(({idx}) % {len(values)} as integer) + 1]"


def fill_(template, src, trg, code):
    cols = {"src": src, "trg": trg, "code": code}
    parts, pos = [], 0
    for m in _re.finditer(r"\{(src|trg|code)\}", template):
        if m.start() > pos:
            parts.append(lit(template[pos:m.start()]))
        parts.append(cols[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(lit(template[pos:]))
    return "(" + " || ".join(parts) + ")"


def compose_(ptype, src, trg, code):
    whens = " ".join(f"when {ptype} = '{n}' then {fill_(t, src, trg, code)}"
                     for n, t in K.PROMPT_TEMPLATES.items() if n != "base")
    return f"(case {whens} else {fill_(K.PROMPT_TEMPLATES['base'], src, trg, code)} end)"


ORACLE["compose_prompt"] = with_(BT) + f"""
, t as (select *, {pick_(_PTYPES, 'doc_id')} as prompt_type from bt)
select task_id, prompt_type, {compose_('prompt_type', "'Java'", 'language', 'code')} as prompt from t"""

_FIMW = " ".join(f"when family = '{f}' then {lit(pre)} || p || {lit(suf)}" for f, (pre, suf) in K.FIM_WRAPPERS.items())
ORACLE["fim_wrap"] = with_(BT) + f"""
, t as (select task_id, {pick_(_FIMF, 'doc_id')} as family, {fill_(K.PROMPT_TEMPLATES['base'], "'Java'", 'language', 'code')} as p from bt)
select task_id, family, case {_FIMW} else p end as model_input from t"""

ORACLE["prompt_echo"] = with_(BS) + """
select task_id, completion_id, case when completion_idx % 2 = 1 then solution
       else 'Translate ' || task_id || ':' || chr(10) || solution end as stored from bs"""


def stops_sql(fam):
    whens = " ".join(f"when {fam} = '{n}' then [{', '.join(lit(s) for s in K.BASE_STOPS + list(e))}]"
                     for n, (e, _r, _t, _f) in K.FAMILIES.items() if e)
    return f"(case {whens} else [{', '.join(lit(s) for s in K.BASE_STOPS)}] end)"


def stop_truncate_(s, stops, cap=K.STOP_CAP_CHARS):
    hits = f"list_filter(list_transform({stops}, lambda st: strpos({s}, st) - 1), lambda i: i >= 0)"
    return f"left({s}, least(coalesce(list_min({hits}), {cap}), {cap}))"


ORACLE["stop_truncate"] = with_(BT) + f"""
, t as (select task_id, code || {pick_(['</s>', '<|endoftext|>', ''], 'doc_id')} || 'tail' as o,
               case when doc_id % 2 = 0 then 'incoder' else 'hf' end as fam from bt)
select task_id, {stop_truncate_('o', stops_sql('fam'))} as solution from t"""

ORACLE["tab_expand"] = with_(BT) + """
select task_id, replace(chr(9) || 'def f():' || chr(10) || chr(9) || chr(9) || 'return 1' || chr(10) || code, chr(9), '    ') as solution from bt"""

ORACLE["sentinel_flag"] = with_(BT) + f"""
, t as (select task_id, code, {pick_(_FIMF, 'doc_id')} in ('santacoder', 'starcoder_infill')
               and floor(length(code) / 4) >= 1024 as over_length from bt)
select task_id, over_length, (case when over_length then '{K.MAX_LENGTH_EXCEEDED}' else code end)
       in ('{K.GEMINI_ERROR}', '{K.MAX_LENGTH_EXCEEDED}') as is_sentinel from t"""

ORACLE["json_reply"] = with_(BV) + """
select completion_id, coalesce(verdict || chr(10) || json_extract_string(props, '$.k'), props) as reply from bv"""

ORACLE["chat_messages"] = with_(BS) + f"""
select task_id, completion_id, 'system,user' as roles,
       case when completion_idx % 2 = 0 then '{K.ASSISTANT_SYSTEM_JSON}' else '{K.ASSISTANT_SYSTEM_TEXT}' end as system_content,
       solution as user_content from bs"""


def ctx_sql(fam, tok, npos, maxpos):
    thr = " ".join(f"when {fam} = '{n}' then {t}" for n, (_e, _r, t, _f) in K.FAMILIES.items() if t is not None)
    return f"(case when {tok} > (case {thr} end) then coalesce({npos}, {maxpos}, {K.DEFAULT_CONTEXT}) else {tok} end)"


def budget_sql(fam, maxlen, ctx, ptok):
    parts = []
    for n, (_e, rule, _t, _f) in K.FAMILIES.items():
        if rule == "ctx":
            v = f"least({maxlen}, {ctx})"
        elif rule == "left":
            v = f"least({maxlen}, {ctx} - {ptok})"
        elif rule == "left90":
            v = f"least({maxlen}, cast(floor(({ctx} - {ptok}) * 0.9) as integer))"
        else:
            continue
        parts.append(f"when {fam} = '{n}' then {v}")
    return f"(case {' '.join(parts)} else {maxlen} end)"


ORACLE["token_budget"] = with_(BS) + f"""
, t as (select task_id, completion_id, {pick_(BUDGET_FAMILIES, 'conv_id')} as family,
               {pick_(TOKENIZER_LIMITS, 'conv_id')} as tok,
               case when conv_id % 2 = 0 then 4096 end as npos,
               cast(floor(length(solution) / 4) as integer) as ptok from bs),
c as (select *, {ctx_sql('family', 'tok', 'npos', '16384')} as ctx from t)
select task_id, completion_id, family, ctx, {budget_sql('family', '1024', 'ctx', 'ptok')} as budget,
       family in ('santacoder', 'starcoder_infill') and ptok >= ctx as over_length from c"""

ORACLE["greedy_normalise"] = """
with runs as (select conv_id, cast(count(*) as integer) as n_samples, cast(max(turn) as integer) as batch_size,
                     conv_id % 3 = 0 as greedy, (conv_id % 5) * 0.2::double as temperature
              from conversations where role = 'assistant' group by conv_id),
g as (select *, greedy and (temperature <> 0 or batch_size <> 1 or n_samples <> 1) as forced from runs)
select conv_id, greedy, round(case when forced then 0.0 else temperature end, 6) as temperature,
       case when forced then 1 else batch_size end as batch_size, case when forced then 1 else n_samples end as n_samples,
       forced as greedy_forced from g"""


def registry_sql(a):
    err = f"'Invalid model name: ' || {a}"
    size_raw = f"regexp_extract({a}, '{K.DEEPSEEK_SIZE_PATTERN}', 1)"
    size = (f"(case when {size_raw} = '' then null when try_cast({size_raw} as double) % 1 = 0 "
            f"then cast(cast(try_cast({size_raw} as double) as bigint) as varchar) else cast(try_cast({size_raw} as double) as varchar) end)")
    rows = []
    for kind, pat, fam, hub, conv in K.REGISTRY_RULES:
        cond = f"{a} = '{pat}'" if kind == "exact" else f"starts_with({a}, '{pat}')"
        fam_s, conv_s, err_s = f"'{fam}'", ("true" if conv else "false"), "null"
        if hub is None:
            hub_s = a
        elif hub == "bigcode/{alias}":
            hub_s = f"'bigcode/' || {a}"
        elif "{last}" in hub:
            hub_s = f"'codellama/CodeLlama-' || string_split({a}, '-')[-1] || '-Instruct-hf'"
            err_s = f"case when not ends_with({a}, 'b') then {err} end"
        elif "{size}" in hub:
            hub_s = f"'deepseek-ai/deepseek-coder-' || {size} || 'b-' || case when contains({a}, 'instruct') then 'instruct' else 'base' end"
            fam_s = f"case when contains({a}, 'instruct') then 'deepseek_instruct' else 'vllm' end"
            conv_s = f"contains({a}, 'instruct')"
            err_s = f"case when {size} is null then {err} end"
        else:
            hub_s = f"'{hub}'"
        rows.append((cond, fam_s, hub_s, conv_s, err_s))

    def chain(i, default):
        return "(case " + " ".join(f"when {r[0]} then {r[i]}" for r in rows) + f" else {default} end)"
    return chain(1, "null"), chain(2, "null"), chain(3, "null"), chain(4, err)


_RF, _RH, _RC, _RE = registry_sql("alias")
ORACLE["registry_lookup"] = with_(BT) + f"""
, t as (select task_id, {pick_(ALIASES, 'doc_id')} as alias from bt),
r as (select task_id, alias, {_RF.replace('alias', 'lower(alias)')} as family, {_RH.replace('alias', 'lower(alias)')} as hub_name,
             {_RC.replace('alias', 'lower(alias)')} as conversational, {_RE.replace('alias', 'lower(alias)')} as registry_error from t)
select task_id, alias, case when registry_error is null then family end as family,
       case when registry_error is null then hub_name end as hub_name,
       case when registry_error is null then conversational end as conversational, registry_error from r"""

ORACLE["work_plan"] = with_(BS, BS_TASKS) + """
, counts as (select task_id, count(*) as n from bs group by task_id),
t as (select t.task_id, cast(coalesce(c.n, 0) as integer) as n_existing from bs_tasks t left join counts c on t.task_id = c.task_id)
select task_id, cast(unnest(generate_series(n_existing, 2)) as integer) as idx,
       cast(floor((unnest(generate_series(n_existing, 2)) - n_existing) / 2) as integer) as batch_no, n_existing
from t where n_existing < 3"""

ORACLE["work_plan_gaps"] = with_(BS, BS_TASKS) + """
, g as (select task_id, cast(i as integer) as idx from bs_tasks, range(6) r(i)),
m as (select * from g where not exists (select 1 from bs where bs.task_id = g.task_id and bs.completion_idx = g.idx))
select task_id, idx, cast((row_number() over (partition by task_id order by idx) - 1) // 2 as integer) as batch_no from m"""

# ------------------------------------------------------------------ test-input generation
# the inputs are written here by their values, without parsing the text the job parses
POOL = f"""pool as (select task_id, cast(pos as integer) as pos, '[' || length(line) || ', ' || pos || ']' as input_text, length(line) || ', ' || pos as shown from (
    select task_id, unnest(string_split(code, chr(10))) as line, generate_subscripts(string_split(code, chr(10)), 1) - 1 as pos from bt)
  where {strip('line')} <> ''
  union all select task_id, -1, '[[' || doc_id % 5 || ']]', '[' || doc_id % 5 || ']' from bt)"""
RLINES = """rlines as (select task_id, completion_id, completion_idx as round_no, l.n as line_no, l.t as input_text from (
    select task_id, completion_id, completion_idx, unnest([
      {'n': 1, 't': '[' || completion_idx || ', ' || conv_id % 7 || ']'}, {'n': 2, 't': '[' || completion_idx || ', ' || conv_id % 7 || ']'},
      {'n': 5, 't': '[[' || conv_id % 5 || ']]'}, {'n': 6, 't': '[' || chr(39) || 't' || completion_idx || chr(39) || ']'},
      {'n': 7, 't': '[' || length(solution) || ']'}]) as l
    from bs where completion_idx % 2 = 1))"""
SEEDS = """seeds as (select * from (select task_id, pos, input_text, shown,
    row_number() over (partition by task_id order by md5(task_id || ':' || cast(pos as varchar) || ':0'), pos) - 1 as seed_rank from pool)
  where seed_rank < 5)"""
NEW = """cand as (select * from rlines where round_no <= 20 and not exists (
    select 1 from pool p where p.task_id = rlines.task_id and p.input_text = rlines.input_text)),
firsts as (select task_id, input_text, min({'r': round_no, 'l': line_no}) as f from cand group by task_id, input_text),
ranked as (select task_id, input_text, f.r as round_no, f.l as line_no,
    row_number() over (partition by task_id order by f.r, f.l) - 1 as new_rank,
    row_number() over (partition by task_id order by f.r, f.l) - row_number() over (partition by task_id, f.r order by f.l) as before from firsts),
newi as (select *, new_rank < 3 as returned from ranked where before < 3)"""

ORACLE["seed_selection"] = with_(BT, POOL, SEEDS) + "select task_id, pos, seed_rank, input_text from seeds"
ORACLE["reply_lines"] = with_(BS, RLINES) + "select task_id, completion_id, cast(line_no as integer) as line_no, input_text from rlines"
ORACLE["new_inputs"] = with_(BT, BS, POOL, RLINES, NEW) + """
select task_id, input_text, round_no, cast(line_no as integer) as line_no, new_rank, returned from newi"""
ORACLE["pool_union"] = with_(BT, BS, POOL, RLINES, NEW) + """
, u as (select task_id, 'seed' as origin from pool union all select task_id, 'generated' as origin from newi)
select task_id, count(*) filter (where origin = 'seed') as n_seed, count(*) filter (where origin = 'generated') as n_generated
from u group by task_id"""
_INSTR = "[" + ", ".join(lit(t) for t in K.TESTGEN_INSTRUCTIONS) + "]"
ORACLE["test_prompt"] = with_(BT, POOL, SEEDS) + f"""
, st as (select task_id, string_agg(shown, chr(10) order by seed_rank) as s from seeds group by task_id)
select bt.task_id, {lit(K.TESTGEN_HEADER)} || bt.code || chr(10) || '```' || {lit(K.TESTGEN_EXAMPLES)} || coalesce(st.s, '')
       || chr(10) || '```' || chr(10) || {_INSTR}[cast(('0x' || substr(md5(bt.task_id), 1, 8))::bigint % 3 as integer) + 1] as message
from bt left join st on bt.task_id = st.task_id"""


# ------------------------------------------------------------------ run checks and cleaning counters
_DS = ["codenet", "avatar", "humaneval"]
_SRC = ["Java", "Python", "C++", "Go", "C", "Rust"]
_TRG = ["Python", "Java", "Kotlin", "Go"]
_PT = [*K.CLI_PROMPT_TYPES, "phi", "magic"]


def _in(col, values):
    return f"{col} in ({', '.join(lit(v) for v in values)})"


ORACLE["run_validation"] = f"""
with runs as (select conv_id, max(turn) as last_turn from conversations where role = 'assistant' group by conv_id),
r as (select conv_id, {pick_(_DS, 'conv_id')} as dataset, {pick_(_SRC, 'conv_id')} as source_lang,
             {pick_(_TRG, 'last_turn')} as target_lang, {pick_(_PT, 'conv_id + last_turn')} as prompt_type from runs)
select conv_id, dataset, source_lang, target_lang, prompt_type,
       case when not {_in('dataset', K.DATASETS)} then 'invalid dataset: ' || dataset
            when not {_in('source_lang', K.LANGUAGES)} then 'invalid source_lang: ' || source_lang
            when not {_in('target_lang', K.LANGUAGES)} then 'invalid target_lang: ' || target_lang
            when not {_in('prompt_type', K.CLI_PROMPT_TYPES)} then 'invalid prompt_type: ' || prompt_type end as run_error
from r"""

ORACLE["sanitize_summary"] = with_(BT, REPLIES, _sanitize_sql("replies")) + """
select lang as target_lang, count(*) as n_total, count(*) filter (where err is not null) as n_failed from s12 group by lang"""
