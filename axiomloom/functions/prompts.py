"""Prompt rendering, context cards and fenced JSON answers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, clip_text, rstrip, strip

# Wording of the context cards and prompt blocks.
CARD_NAME, CARD_KIND, CARD_ABOUT, CARD_EXTRA = "- 名称：", "- 类型：", "- 简介：", "- 补充信息："
NO_DESCRIPTION = "No additional description is available."
CONTEXT_HEAD, CONTEXT_FIRST, CONTEXT_SECOND = "背景知识：", "条目1：", "条目2："
AXIOM_BLOCK, CONTEXT_BLOCK = "待判断公理：", "上下文信息："
INPUT_BLOCK = "**INPUT TEXT:**"


def first_text(*candidates, n: int = 240) -> Column:
    """First candidate with text left after clipping."""
    return F.coalesce(
        *[F.nullif(clip_text(c, n), F.lit("")) for c in candidates], F.lit(NO_DESCRIPTION)
    )


def context_card(name, kind, descriptions, extra=None) -> Column:
    or_unknown = lambda c: F.coalesce(F.nullif(strip(c), F.lit("")), F.lit("Unknown"))
    lines = [
        F.concat(F.lit(CARD_NAME), or_unknown(name)),
        F.concat(F.lit(CARD_KIND), or_unknown(kind)),
        F.concat(F.lit(CARD_ABOUT), first_text(*descriptions)),
    ]
    if extra is not None:
        more = clip_text(extra, 180)
        lines.append(F.when(more != "", F.concat(F.lit(CARD_EXTRA), more)))
    return F.concat_ws("\n", *lines)


def context_info(subject_card: Column, object_card: Column) -> Column:
    return F.concat(
        F.lit(f"{CONTEXT_HEAD}\n{CONTEXT_FIRST}\n"), subject_card,
        F.lit(f"\n\n{CONTEXT_SECOND}\n"), object_card,
    )


def _fill(text: Column, name: str, value: Column) -> Column:
    """Replace ``{name}`` and ``{{name}}``."""
    for mark in ("{%s}" % name, "{{%s}}" % name):
        text = F.replace(text, F.lit(mark), value)
    return text


def render_prompt(template, fields: Mapping[str, Column | str]) -> Column:
    """Fill lower and upper case placeholders; a template using none of them
    gets the axiom and context appended as blocks."""
    c = as_col(template)
    values = {k: F.coalesce(as_col(v), F.lit("")) for k, v in fields.items()}
    text, used = c, F.lit(False)
    for name, value in values.items():
        for form in (name, name.upper()):
            used = used | c.contains("{%s}" % form)
        for mark in ("{%s}" % name, "{%s}" % name.upper(), "{{%s}}" % name, "{{%s}}" % name.upper()):
            text = F.replace(text, F.lit(mark), value)
    blocks = F.concat_ws(
        "\n\n", strip(c), F.lit(AXIOM_BLOCK), values["axiom_text"],
        F.lit(CONTEXT_BLOCK), values["context_info"],
    )
    return F.when(used, text).otherwise(blocks)


def render_two_field_prompt(template, axiom_text, context) -> Column:
    c, ctx = as_col(template), F.coalesce(as_col(context), F.lit(""))
    text = F.replace(c, F.lit("{axiom_text}"), as_col(axiom_text))
    text = F.replace(text, F.lit("{context_info}"), F.coalesce(F.nullif(ctx, F.lit("")), F.lit("无")))
    return F.when(
        ~c.contains("{context_info}") & (ctx != ""),
        F.concat(text, F.lit(f"\n\n{CONTEXT_BLOCK}\n"), ctx),
    ).otherwise(text)


def assemble_prompt(template, modules: Mapping[str, tuple[Column, Column]], text) -> Column:
    """Fill slots from (switch, module text) pairs, then the input text."""
    prompt, body = as_col(template), strip(text)
    for slot, (switch, module) in modules.items():
        prompt = _fill(prompt, slot, F.when(switch, module).otherwise(F.lit("")))
    return F.when(prompt.contains("{text}"), F.replace(prompt, F.lit("{text}"), body)).otherwise(
        F.concat(rstrip(prompt), F.lit(f"\n\n{INPUT_BLOCK}\n"), body)
    )


def strip_code_fence(text) -> Column:
    c = strip(text)
    inner = F.regexp_replace(F.regexp_replace(c, r"^```[a-zA-Z0-9_-]*\n?", ""), r"\n?```$", "")
    return strip(F.when(c.startswith("```"), inner).otherwise(c))


def json_object_text(text) -> Column:
    """The JSON object inside an answer as text, or null.

    The whole fence-stripped answer is tried first, then the part from the
    first opening to the last closing brace. A valid answer that is not an
    object is an error and is not searched further.
    """
    c = strip_code_fence(text)
    start, from_end = F.locate("{", c), F.locate("}", F.reverse(c))
    end = F.length(c) - from_end + 1
    inner = F.when((start > 0) & (from_end > 0) & (end > start), F.substr(c, start, end - start + 1))
    whole_ok = F.try_parse_json(c).isNotNull()
    chosen = F.when(whole_ok, c).otherwise(inner)
    kind = F.schema_of_variant(F.try_parse_json(chosen))
    return F.when(kind.startswith("OBJECT"), chosen)


def parse_fenced_json(text, schema) -> Column:
    return F.from_json(json_object_text(text), schema)
