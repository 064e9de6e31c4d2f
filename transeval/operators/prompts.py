"""Prompt texts, chat messages and reply handling as column expressions.

Templates are fixed strings (``constants.PROMPT_TEMPLATES``) with ``{src}``, ``{trg}``
and ``{code}`` slots; a prompt is a ``concat`` of the literal pieces and the columns,
chosen per row by ``CASE`` on the prompt type (unknown types use ``base``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from transeval import constants as K
from transeval.functions.text import find, lit_col

_SLOT = re.compile(r"\{(src|trg|code)\}")


def fill(template: str, src, trg, code) -> Column:
    """One template as a concat of literal pieces and columns."""
    cols = {"src": lit_col(src), "trg": lit_col(trg), "code": lit_col(code)}
    parts, pos = [], 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(cols[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def compose_prompt(prompt_type, src, trg, code) -> Column:
    """Prompt for each row; ``prompt_type`` may be a column or a literal."""
    if isinstance(prompt_type, str):
        return fill(K.PROMPT_TEMPLATES.get(prompt_type, K.PROMPT_TEMPLATES["base"]), src, trg, code)
    expr = None
    for name, tpl in K.PROMPT_TEMPLATES.items():
        if name == "base":
            continue
        cond = prompt_type == F.lit(name)
        expr = F.when(cond, fill(tpl, src, trg, code)) if expr is None else expr.when(cond, fill(tpl, src, trg, code))
    return expr.otherwise(fill(K.PROMPT_TEMPLATES["base"], src, trg, code))


def fim_wrap(prompt, family) -> Column:
    """Fill-in-the-middle decoders see ``prefix + prompt + suffix``."""
    expr = None
    for fam, (pre, suf) in K.FIM_WRAPPERS.items():
        val = F.concat(F.lit(pre), lit_col(prompt), F.lit(suf))
        cond = lit_col(family) == F.lit(fam)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(lit_col(prompt))


def prompt_echo(prompt, output, conversational) -> Column:
    """What the sample file holds: the reply alone for chat models, else prompt + reply."""
    return F.when(lit_col(conversational), lit_col(output)).otherwise(F.concat(lit_col(prompt), lit_col(output)))


def stops_for(family) -> Column:
    """Stop strings of a decoder family (base set plus the family's extras)."""
    fam = lit_col(family)
    expr = None
    for name, (extra, _rule, _thr, _fim) in K.FAMILIES.items():
        if not extra:
            continue
        arr = F.array(*[F.lit(s) for s in K.BASE_STOPS + list(extra)])
        expr = F.when(fam == name, arr) if expr is None else expr.when(fam == name, arr)
    return expr.otherwise(F.array(*[F.lit(s) for s in K.BASE_STOPS]))


def stop_truncate(text, stops, cap: int | None = K.STOP_CAP_CHARS) -> Column:
    """Cut at the earliest stop string; with ``cap`` the result is never longer than
    ``cap`` chars (the Hugging Face decoders start from index 10,000)."""
    s = lit_col(text)
    hits = F.filter(F.transform(lit_col(stops), lambda st: find(s, st)), lambda i: i >= 0)
    if cap is None:
        end = F.coalesce(F.array_min(hits), F.length(s))
    else:
        end = F.least(F.coalesce(F.array_min(hits), F.lit(cap)), F.lit(cap))
    return F.call_function("left", s, end)


def tab_expand(text) -> Column:
    return F.replace(lit_col(text), F.lit("\t"), F.lit("    "))


def tab_collapse(text) -> Column:
    return F.replace(lit_col(text), F.lit("    "), F.lit("\t"))


def json_reply(content, prompt, field: str = "code") -> Column:
    """Structured reply: ``prompt + "\\n" + $.field`` when present, else the raw content
    (invalid JSON, missing field)."""
    val = F.get_json_object(lit_col(content), f"$.{field}")
    return F.coalesce(F.concat(lit_col(prompt), F.lit("\n"), val), lit_col(content))


def chat_messages(prompt, json_format=False) -> Column:
    """Chat request: system text chosen by response format, then the user prompt."""
    system = F.when(lit_col(json_format), F.lit(K.ASSISTANT_SYSTEM_JSON)).otherwise(F.lit(K.ASSISTANT_SYSTEM_TEXT))
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                   F.struct(F.lit("user").alias("role"), lit_col(prompt).alias("content")))


def translator_messages(prompt) -> Column:
    """Request of the message-API client: fixed system text, one user message."""
    return F.struct(F.lit(K.TRANSLATOR_SYSTEM).alias("system"),
                    F.array(F.struct(F.lit("user").alias("role"), lit_col(prompt).alias("content"))).alias("messages"),
                    F.array(F.lit(K.ANTHROPIC_STOP)).alias("stop_sequences"))


def is_sentinel(text) -> Column:
    """Failed generations are stored as normal samples with a sentinel text."""
    return lit_col(text).isin(K.GEMINI_ERROR, K.MAX_LENGTH_EXCEEDED)
