"""Chat conversations: nesting, conversion to pairs, whole-conversation rendering, tool calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import PAIRS, conv, table
from pairloom.functions import rendering
from pairloom.functions.templates import conversation_renderer, formatter
from pairloom.operators.dedup import deduplicate
from pairloom.operators.messages import convert_messages, nest_turns
from pairloom.operators.quality import filter_long, filter_report
from pairloom.operators.vision import unified_messages


def _pairs(spark, d):
    return convert_messages(conv(spark, d), on_error="drop")


@query("chat_training_rows", f"""
WITH {PAIRS}, kept AS (
  SELECT * FROM pairs WHERE prompt <> '' AND chosen <> ''
  QUALIFY row_number() OVER (PARTITION BY prompt, chosen ORDER BY conv_id) = 1)
SELECT conv_id, system,
       CASE WHEN system <> '' THEN '<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10) ELSE '' END
         || '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt,
       chosen || '<|im_end|>' || chr(10) AS chosen, '<|im_end|>' || chr(10) AS rejected
FROM kept""")
def chat_training_rows(spark, d):
    """Conversations to deduplicated, formatted training rows."""
    nested = nest_turns(table(spark, d, "conversations"), staged=True)   # read twice: for keys, then for rows
    return formatter("chatml")(deduplicate(convert_messages(nested, on_error="drop"), ord="conv_id"))


@query("nest_turns_staged", """
SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles, string_agg(text, '|' ORDER BY turn) AS texts
FROM conversations GROUP BY conv_id""")
def nested_staged(spark, d):
    """Conversations from written blocks of two turns, most of them of several blocks."""
    rows = nest_turns(table(spark, d, "conversations"), block=2, staged=True)
    return rows.select("conv_id", F.size("messages").cast("long").alias("turns"),
                       F.array_join("messages.role", ",").alias("roles"), F.array_join("messages.content", "|").alias("texts"))


@query("messages_to_pairs", f"""
WITH {PAIRS} SELECT conv_id, system, prompt, chosen FROM pairs WHERE prompt <> '' AND chosen <> ''""")
def messages_to_pairs(spark, d):
    return _pairs(spark, d)


@query("messages_quarantine", f"""
WITH {PAIRS}
SELECT conv_id, prompt, chosen,
       CASE WHEN prompt = '' THEN 'nothing was said by the user'
            WHEN chosen = '' THEN 'nothing was said by the assistant' END AS reason
FROM pairs""")
def messages_quarantine(spark, d):
    return convert_messages(conv(spark, d), on_error="quarantine").select(
        "conv_id", "prompt", "chosen", F.col("_error").alias("reason"))


@query("nest_turns", """
SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles, string_agg(text, '|' ORDER BY turn) AS texts
FROM conversations GROUP BY conv_id""")
def nested(spark, d):
    return conv(spark, d).select("conv_id", F.size("messages").cast("long").alias("turns"),
                                 F.array_join("messages.role", ",").alias("roles"),
                                 F.array_join("messages.content", "|").alias("texts"))


@query("nest_turns_blocked", """
SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, string_agg(text, '|' ORDER BY turn) AS texts
FROM conversations GROUP BY conv_id""")
def nested_blocked(spark, d):
    """The same with every conversation of more than three turns assembled in blocks."""
    return nest_turns(table(spark, d, "conversations"), block=3).select(
        "conv_id", F.array_join("messages.role", ",").alias("roles"), F.array_join("messages.content", "|").alias("texts"))


def _render(name, fmt, sql, **kw):
    @query(name, sql)
    def run(spark, d):
        return conv(spark, d).select("conv_id", conversation_renderer(fmt)(F.col("messages"), **kw).alias("text"))


_CHATML = "string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)"
_LLAMA3 = "string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>', '' ORDER BY turn)"
_render("render_chatml", "chatml", f"SELECT conv_id, {_CHATML} AS text FROM conversations GROUP BY conv_id")
_render("render_qwen3_prompt", "qwen3",
        f"SELECT conv_id, {_CHATML} || '<|im_start|>assistant' || chr(10) AS text FROM conversations GROUP BY conv_id",
        add_generation_prompt=True)
_render("render_llama3", "llama3", f"SELECT conv_id, '<|begin_of_text|>' || {_LLAMA3} AS text FROM conversations GROUP BY conv_id")
_render("render_mistral", "mistral", """
SELECT conv_id, '<s>' || coalesce(max(text) FILTER (WHERE lead_turn AND role = 'system') || chr(10) || chr(10), '')
       || coalesce(string_agg(CASE role WHEN 'user' THEN '[INST] ' || text || ' [/INST]'
                                        WHEN 'assistant' THEN ' ' || text || '</s>' ELSE '' END, '' ORDER BY turn), '') AS text
FROM (SELECT *, turn = min(turn) OVER (PARTITION BY conv_id) AS lead_turn FROM conversations) GROUP BY conv_id""")


_AS_JSON = ("string_agg('{\"role\":\"' || role || '\",\"content\":' || CAST(to_json(text) AS VARCHAR) || '}', ',' ORDER BY turn)")


def _unified(spark, d):
    """Conversations as a mixed corpus: messages as JSON text, conversations with a system turn carry an image."""
    nested_rows = conv(spark, d)
    image = F.when(F.array_contains("messages.role", "system"), F.encode(F.col("conv_id").cast("string"), "UTF-8"))
    return nested_rows.select("conv_id", F.to_json("messages").alias("messages"), image.alias("image"))


@query("long_filter", f"""
SELECT conv_id, length('[' || {_AS_JSON} || ']') AS chars FROM conversations GROUP BY conv_id
HAVING length('[' || {_AS_JSON} || ']') <= 1024""")
def long_filter(spark, d):
    return filter_long(_unified(spark, d), max_seq_length=256).select("conv_id", F.length("messages").cast("long").alias("chars"))


@query("long_filter_report", f"""
SELECT count(*) AS before, count(*) FILTER (WHERE n <= 1024) AS after, count(*) FILTER (WHERE n > 1024) AS dropped
FROM (SELECT length('[' || {_AS_JSON} || ']') AS n FROM conversations GROUP BY conv_id)""")
def long_filter_report(spark, d):
    return filter_report(_unified(spark, d), max_seq_length=256)


@query("unified_messages", """
SELECT conv_id, CAST(count(*) FILTER (WHERE role = 'system') > 0 AS INTEGER) AS images, count(*) AS turns,
       string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS texts
FROM conversations GROUP BY conv_id""")
def unified(spark, d):
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), F.variant_get(m["content"], "$", "string")))
    return unified_messages(_unified(spark, d)).select(
        "conv_id", F.size("images").alias("images"), F.size("messages").cast("long").alias("turns"),
        F.array_join(line, "\n").alias("texts"))


# ---- tool calls ----------------------------------------------------------------------------------------

def tool_renderer(messages, tools=None, add_generation_prompt=False, enable_thinking=None):
    """A small chat template: calls are written into the assistant turn, schemas into the system turn."""
    if not any(m["role"] in ("user", "tool") for m in messages):
        raise ValueError("no user turn")
    out = []
    for m in messages:
        role, text = m["role"], m.get("content") or ""
        if role == "system" and tools:
            text = f"[{' '.join(t['name'] for t in tools)}] {text}"
        if role == "tool":
            role, text = "user", f"<result>{text}</result>"
        for call in m.get("tool_calls") or []:
            text += f"<call {call['function']['name']}>{call['function']['arguments']['text']}</call>"
        out.append(f"<{role}>{text}</{role}>\n")
    return "".join(out) + ("<assistant>" if add_generation_prompt else "")


def _tool_rows(spark, d):
    """Conversations whose assistant turns are calls; every second kind of row keeps plain text."""
    call = "array<struct<type:string,function:struct<name:string,arguments:string>>>"

    def as_call(m):
        args = F.to_json(F.struct(m["content"].alias("text")))
        fn = F.struct(F.lit("reply").alias("name"), args.alias("arguments"))
        mine = m["role"] == "assistant"
        return F.struct(m["role"].alias("role"), F.when(~mine, m["content"]).alias("content"),
                        F.when(mine, F.array(F.struct(F.lit("function").alias("type"), fn.alias("function"))).cast(call)).alias("tool_calls"))

    tools = F.array(F.struct(F.lit("reply").alias("name")))
    has_system = F.array_contains("messages.role", "system")
    return conv(spark, d).select("conv_id", F.transform("messages", as_call).alias("messages"), F.when(has_system, tools).alias("tools"))


_ASKED = "string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'user')"


@query("flatten_tools", f"""
SELECT conv_id, CASE WHEN count(*) FILTER (WHERE role = 'system') > 0
                     THEN '[reply] ' || string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'system')
                     ELSE '' END AS system,
       {_ASKED} AS prompt,
       string_agg('<call reply>' || text || '</call>', chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant') AS chosen
FROM conversations GROUP BY conv_id
HAVING {_ASKED} <> '' AND count(*) FILTER (WHERE role = 'assistant') > 0""")
def flatten_tools(spark, d):
    return convert_messages(_tool_rows(spark, d), tool_renderer, on_error="drop")


@query("audit_tools", """
WITH shape AS (
  SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id)
SELECT roles IN ('user,assistant', 'system,user,assistant') AS survives, count(*) AS rows
FROM shape WHERE roles LIKE '%assistant%' OR roles LIKE '%system%' GROUP BY 1""")
def audit_tools(spark, d):
    return rendering.audit_report(_tool_rows(spark, d), tool_renderer)


@query("normalise_calls", """
SELECT conv_id, turn, 'reply' AS name, text FROM conversations WHERE role = 'assistant'""")
def normalise_calls(spark, d):
    df = _tool_rows(spark, d)
    element = df.schema["messages"].dataType.elementType["tool_calls"].dataType.elementType
    calls = (df.select("conv_id", F.posexplode("messages").alias("turn", "m"))
             .select("conv_id", F.col("turn").cast("long").alias("turn"),
                     F.explode(rendering.normalise_calls(F.col("m.tool_calls"), element)).alias("c")))
    return calls.select("conv_id", "turn", "c.name", F.variant_get("c.arguments", "$.text", "string").alias("text"))


@query("tool_rows", """
SELECT conv_id, count(*) FILTER (WHERE role IN ('assistant', 'system')) > 0 AS has_tools FROM conversations GROUP BY conv_id""")
def tool_rows(spark, d):
    df = _tool_rows(spark, d)
    return df.select("conv_id", rendering.row_has_tools(df).alias("has_tools"))
